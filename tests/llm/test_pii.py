from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from touchline.llm import pii, queries

from .fixtures import awkward_texts, docs, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    """The base as stated: each kind's leftmost matches, failing ones dropped."""
    n = lambda m: [int(c) for c in m.group() if c in "0123456789"]

    def card_ok(m):
        d = n(m)
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0

    checks = [("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split("."))),
              ("card", CARD, card_ok), ("phone", PHONE, lambda m: 9 <= len(n(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, rx, ok in checks for m in rx.finditer(text) if ok(m)]


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.examples())


def tricky():
    rnd = random.Random(11)
    out = ["a@b.c@d.e", "@x.y", "x@y", "x@y.", "a.b@c-d.e-f.g.", "é.a@b.c", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.255", "01.002.0003.4",
           "4" * 13, "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111", "0" * 16, "+1 (234) 555-0199", "++12345678 9", "+1 2345678901234567",
           "+123456789 4111111111111111", "1.1.1.1.1@2.3", "9" * 60000 + ".1.1.1", "a" * 60000 + "@b.c", "x" * 50000, "1 " * 30000]
    for _ in range(400):
        out.append("".join(rnd.choice("0123456789.@+-() ab%_é\n") for _ in range(rnd.randint(1, 40))))
    for _ in range(100):
        out.append(pii._example(rnd)[0])
    return out


def test_base_is_the_stated_patterns():
    for t in tricky():
        assert pii.base_spans(t) == base(t), t[:80]


def test_held_out_accuracy(field):
    right = wanted = found = 0
    for text, spans in pii.examples(300, seed=99):
        start, end, shapes = pii.tokens(text)
        flat, at = pii._padded([shapes])
        got = pii.spans_of(pii.decode(field, flat)[at[0]:at[0] + len(start)], start, end)
        right, wanted, found = right + len(set(got) & set(spans)), wanted + len(spans), found + len(got)
    assert right / wanted > 0.95 and right / found > 0.95


def test_viterbi_is_the_best_path(field):
    """Against all paths of short sequences; far tokens outside by rule."""
    rng = np.random.default_rng(4)
    used = np.unique(np.concatenate([pii.tokens(t)[2] for t, _ in pii.examples(50)]))
    for _ in range(60):
        shapes = rng.choice(used, rng.integers(1, 5))
        flat, at = pii._padded([shapes])
        near = pii.near_trigger(flat)
        score = field.emissions(flat, np.arange(at[0], at[0] + len(shapes)))
        paths = itertools.product(*(range(pii.LABELS) if near[at[0] + i] else (0,) for i in range(len(shapes))))

        def value(p, score=score):
            return sum(score[i, y] for i, y in enumerate(p)) + sum(field.step[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))

        assert tuple(pii.decode(field, flat)[at[0]:at[0] + len(shapes)]) == max(paths, key=value)


def test_likelihood_gradient():
    """Marginals are the derivatives of the log partition by enumeration."""
    rng = np.random.default_rng(1)
    f = pii.Field(np.zeros((1, 1, 1)), np.zeros((1, 1, 1)), rng.normal(size=(pii.LABELS, pii.LABELS)))
    scores, lengths = rng.normal(size=(2, 3, pii.LABELS)), np.array([3, 2])
    token, pairs = pii._marginals(f, scores, lengths)
    want, want_pairs = np.zeros_like(token), np.zeros_like(pairs)
    for n, m in enumerate(lengths):
        paths = list(itertools.product(range(pii.LABELS), repeat=int(m)))
        w = np.exp([sum(scores[n, i, y] for i, y in enumerate(p)) + sum(f.step[a, b] for a, b in zip((0, *p), (*p, 0), strict=True)) for p in paths])
        for p, x in zip(paths, w / w.sum(), strict=True):
            for i, y in enumerate(p):
                want[n, i, y] += x
            for a, b in zip((0, *p), (*p, 0), strict=True):
                want_pairs[a, b] += x
    for n, m in enumerate(lengths):
        assert np.allclose(token[n, :m], want[n, :m])
    assert np.allclose(pairs, want_pairs)


def test_added_spans(field):
    text = "anat +1 (314) 555-6532 4663622617512349 inger. La (212) 555-0147, mi. Am 2024-05-17 um 12:30 re 3.14, §5"
    found = pii.added_spans(field, [text], [pii.base_spans(text)])[0]
    assert {(k, text[a:b]) for k, a, b in found} == {("phone", "+1 (314) 555-6532"), ("card", "4663622617512349"), ("phone", "(212) 555-0147")}


def test_query_columns(spark, monkeypatch, field):
    rows = awkward_texts() + [(500 + i, t) for i, t in enumerate(tricky())]
    monkeypatch.setattr(queries, "table", lambda s, d, n: docs(s, rows))
    got = {str(r) for r in queries.op13(spark, "").collect()}
    assert len(queries.op13(spark, "").columns) == 7
    by_row = queries.op13(spark, "").collect()
    assert len(by_row) == len(rows) and len(got) <= len(rows)
    want = {}
    for doc, text in rows:
        spans = base(text or "")
        key = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.setdefault(doc, []).append((*(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(key.encode()).hexdigest(), set(key.split(",")) - {""}))
    for r in by_row:
        assert any(tuple(r)[1:6] == w[:5] and w[5] <= set(r["spans"].split(",")) for w in want[r["doc_id"]]), r


def test_batches_do_not_matter(spark):
    rows = docs(spark, [(i, pii.examples(40, 5)[i][0]) for i in range(40)])
    sizes = [sorted(map(str, pii.find_personal_data(rows, pii.labelled_examples(spark, 150), group=g).collect())) for g in (50, 1 << 20)]
    assert sizes[0] == sizes[1]


def test_empty(spark):
    assert pii.find_personal_data(empty(spark), pii.labelled_examples(spark, 60)).count() == 0
    with pytest.raises(ValueError):
        pii.find_personal_data(empty(spark), pii.labelled_examples(spark, 60).where("false"))

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from touchline.llm import maxent_lm, words
from tests.llm.fixtures import WORD, awkward_texts, docs, empty

SF = "/root/testdata/sf0.001"


def base(rows):
    count, toks = Counter(), []
    for i, t in rows:
        w = [*WORD.findall((t or "").encode().lower()), "end"]
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
        toks.append((i, held, w))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return [(str(i), held, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            for i, held, w in toks]


def compare(got, rows):
    a = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    b = sorted(base(rows))
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert all(math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(a, b, strict=True))


def test_base_score_and_gain_on_held_out_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = maxent_lm.score_texts(d).collect()
    compare(got, [(r.doc_id, r.text) for r in d.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_awkward_rows_and_fetched_counts(spark, monkeypatch):
    """With hardly any cached words, nearly all counts come by bucket."""
    monkeypatch.setattr(maxent_lm, "CACHED", 2)
    rows = awkward_texts()
    got = maxent_lm.score_texts(docs(spark, rows)).collect()
    compare(got, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table_and_no_training_texts(spark):
    assert maxent_lm.score_texts(empty(spark)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "a few words") for i in held]
    got = maxent_lm.score_texts(docs(spark, rows)).collect()
    compare(got, rows)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w = maxent_lm.Weights(rng.normal(size=maxent_lm.CLASSES), rng.normal(size=(maxent_lm.TEMPLATES, maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32))
    f = rng.integers(0, maxent_lm.ROWS, (maxent_lm.TEMPLATES, 50))
    assert np.allclose(np.exp(w.log_softmax(f)).sum(axis=1), 1, atol=1e-5)


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(2)
    f, y = rng.integers(0, 20, (maxent_lm.TEMPLATES, 4000)), None
    y = (f[0] % 5).astype(np.int64)
    w = maxent_lm.Weights(np.zeros(maxent_lm.CLASSES))
    squares, seen = np.zeros((maxent_lm.TEMPLATES, maxent_lm.ROWS), np.float32), np.zeros((maxent_lm.TEMPLATES, maxent_lm.ROWS), np.int64)
    before = w.log10_class(f, y).sum()
    for _ in range(20):
        w.learn(f, y, squares, seen)
    assert w.log10_class(f, y).sum() > before * 0.5


def test_tokens_and_features_stay_inside_rows():
    texts = [b"a b c d", b"", b"A b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, row = maxent_lm.tokens(data, np.cumsum([0, *map(len, texts)]))
    assert row.tolist() == [0] * 5 + [1] + [2] * 3
    assert h[0] == h[6] and h[4] == h[5] == h[8]
    f = maxent_lm.features(h, row)
    assert (f[:, 0] == f[:, 5]).all() and (f[:, 0] == f[:, 6]).all()
    assert words.hashes(data, np.array([0]), np.array([1]))[0] != words.hashes(data, np.array([2]), np.array([3]))[0]


def test_hash_is_the_polynomial_of_the_bytes_wherever_the_span_lies():
    data = np.random.default_rng(3).integers(0, 256, 500).astype(np.uint8)
    start = np.array([0, 3, 3, 490, 77])
    end = np.array([1, 40, 400, 500, 78])
    plain = [sum(int(words._BYTE[b]) * int(words._BASE) ** i for i, b in enumerate(data[x:y].tolist())) % 2**64 for x, y in zip(start, end, strict=True)]
    mixed = words.mix64(np.array(plain, np.uint64) ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    assert words.hashes(data, start, end).tolist() == mixed.tolist()
    power, inverse = words._powers(words.GROUP + 7)  # a text longer than a group
    assert len(power) > words.GROUP + 6
    with np.errstate(over="ignore"):
        assert (power[-9:] * inverse[-9:] == 1).all()


def test_group_sums_add_the_members_in_their_order():
    rng = np.random.default_rng(4)
    size = np.array([40, 17, 16, 5, 5, 2, 1, 1])
    g, order = rng.normal(size=(size.sum(), 8)).astype(np.float32), rng.permutation(size.sum())
    first = np.cumsum(size) - size
    for few in (1, 4, 16, 50):
        got = maxent_lm._group_sums(g, order, first, size, few)
        for i, (a, n) in enumerate(zip(first, size, strict=True)):
            want = g[order[a]].copy()
            for j in order[a + 1:a + n]:
                want += g[j]
            assert (got[i] == want).all()


def test_class_scores_do_not_depend_on_the_slices():
    rng = np.random.default_rng(5)
    w = maxent_lm.Weights(rng.normal(size=maxent_lm.CLASSES), rng.normal(size=(maxent_lm.TEMPLATES, maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32))
    n = 2 * maxent_lm.SLICE + 5
    f, y = rng.integers(0, maxent_lm.ROWS, (maxent_lm.TEMPLATES, n)), rng.integers(0, maxent_lm.CLASSES, n)
    z = sum(w.table[t][f[t]] for t in range(maxent_lm.TEMPLATES)) + w.bias
    assert np.allclose(z - z.max(axis=1, keepdims=True), w.centred(f), atol=1e-5)
    assert (w.log10_class(f, y) == w.log_softmax(f)[np.arange(n), y].astype(float) / np.log(10)).all()

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import periodic_runs, queries

from .fixtures import WORD, awkward_texts, docs, empty


def brute(w, min_words, min_periods):
    """Every stretch of one period that cannot be extended, smallest period first."""
    out = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_periods * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_strings():
    rnd = random.Random(3)
    for _ in range(150):
        held = []
        for _ in range(rnd.randint(1, 4)):
            n, k = rnd.choice([0, 1, 5, 30, 100, 200]), rnd.choice([1, 2, 3, 10])
            d = [b"%d" % rnd.randint(0, k) for _ in range(n)]
            if n > 5 and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + (n - a) // (3 + rnd.randint(0, 7))
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
            held.append(d)
        s, offsets = periodic_runs._numbered(held)
        got = [[] for _ in held]
        for start, length, q in periodic_runs.runs_of(s, 6, 3):
            k = int(np.searchsorted(offsets, start, "right")) - 1
            got[k].append((start - int(offsets[k]), length, q))
        assert [sorted(g) for g in got] == [brute(d, 6, 3) for d in held]


def test_suffix_array():
    rnd = random.Random(8)
    for n in (1, 2, 50, 300):
        s = np.array([rnd.randint(1, 3) for _ in range(n - 1)] + [0])
        sa, isa, lcp = periodic_runs.suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist()) and (isa[sa] == np.arange(n)).all()
        for k in range(1, n):
            a, b = s[sa[k - 1]:], s[sa[k]:]
            m = min(len(a), len(b))
            same = (a[:m] == b[:m]).tolist()
            assert lcp[k] == (same.index(False) if False in same else m)


def loops(rows):
    """The query's rewriting: words from a on repeat p words, for every tenth crc."""
    for doc, text in rows:
        w = WORD.findall((text or "").encode())
        h = None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        yield doc, w


def test_query_columns(spark, monkeypatch):
    rnd = random.Random(2)
    rows = awkward_texts() + [(i, " ".join(rnd.choice(["x", "é", "y"]) for _ in range(rnd.randint(20, 90)))) for i in range(100, 220)]
    rows += [(300, "a b c " * 9 + "a b"), (301, "z " * 24), (302, "z " * 23), (303, "u v " * 11 + "w " + "k l m n " * 7)]
    monkeypatch.setattr(queries, "table", lambda s, d, n: docs(s, rows))
    got = sorted((tuple(r) for r in queries.op12(spark, "").collect()), key=str)
    want = []
    for doc, w in loops(rows):
        runs = brute(w, 24, 3)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs)).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 10 and any(r[1] > 1 for r in got)


def test_groups_do_not_matter(spark):
    d = docs(spark, awkward_texts() + [(300, "a b c " * 9)])
    big, small = (periodic_runs.find_runs(d, group=g).select("doc_id", "n_words", "runs", F.hash("kept").alias("kept")) for g in (1 << 18, 40))
    assert sorted(map(str, big.collect())) == sorted(map(str, small.collect()))


def test_empty(spark):
    assert periodic_runs.find_runs(empty(spark)).count() == 0
    got = periodic_runs.find_runs(docs(spark, [(1, None), (2, ""), (3, " \n")])).collect()
    assert [(r["n_words"], r["runs"], r["kept"]) for r in got] == [(0, [], "")] * 3

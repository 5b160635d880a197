from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import simhash
from tests.llm.fixtures import WORD, awkward_texts, docs, empty


def fingerprint(text):
    w = WORD.findall((text or "").encode().lower())
    s = [b" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits=3):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    return {f: root(f) for f in distinct}


def test_matches_brute_force(spark):
    rows = awkward_texts()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    root = groups(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted(
        (str(i), f"{f:016x}", str(least.get(root[f]))) for (i, _), f in zip(rows, fps, strict=True))


@pytest.mark.parametrize("tile", [5, 4096])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, tile):
    """Clusters, long chains and cells larger than a tile."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist()) | {0, (1 << 64) - 1}
    for b in base[:12].tolist():
        x = b
        for _ in range(15):
            for bit in rnd.integers(0, 64, rnd.integers(1, 5)).tolist():
                x ^= 1 << bit
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "TILE", tile)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = groups(fps)
    mask = (1 << 64) - 1
    same = {}
    for s in signed:
        same.setdefault(want[s & mask], set()).add(found.get(s, s))
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


def test_embedding_bounds_the_hamming_distance(spark):
    rnd = np.random.default_rng(6)
    a = rnd.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64))
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in np.concatenate((a, b))], "fp long")
    e = np.array([r[0] for r in df.select(simhash.embedding(F.col("fp"))).collect()], np.int64).view(np.uint64)
    assert (simhash._manhattan(e[:500], e[500:]) <= np.bitwise_count(a ^ b)).all()


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0

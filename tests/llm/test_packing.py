from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import packing
from tests.llm.fixtures import awkward_texts, docs, empty


def naive(size, source, cluster, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for s, f, c in zip(size, source, cluster, strict=True):
        ok = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= s and b["source"][f] < per_source and c not in b["cluster"]]
        i = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append({"left": capacity, "source": Counter(), "cluster": set()})
        bins[i]["left"] -= s
        bins[i]["source"][f] += 1
        bins[i]["cluster"].add(c)
        out.append((bins[i]["left"], i))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 3), st.integers(0, 12)), min_size=1, max_size=60), st.integers(1, 3))
def test_same_residuals_as_looking_at_every_bin(items, per_source):
    items.sort(key=lambda x: -x[0])
    size, source, cluster = (np.array(x) for x in zip(*items, strict=True))
    got = packing.pack_block(size, source, cluster, 40, per_source)
    left, seen = {}, defaultdict(list)
    for b, s, f, c in zip(got, size, source, cluster, strict=True):
        # No tighter compatible bin stood open when the piece was placed.
        fits = [x for k, x in left.items() if x >= s and sum(g == f for g, _ in seen[k]) < per_source and c not in [d for _, d in seen[k]]]
        assert (left[b] == min(fits)) if b in left else not fits
        left[b] = left.get(b, 40) - s
        seen[b].append((f, c))
    assert min(left.values()) >= 0


def test_every_byte_once_and_no_conflict(spark):
    rows = awkward_texts()
    capacity, per_source = 2_000, 2
    got = packing.pack(docs(spark, rows), capacity, per_source).collect()
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)
    whole = Counter()
    for r in got:
        whole[str(r.doc_id)] += r["size"]
        assert r.byte_offset == r.piece * capacity and 1 <= r["size"] <= capacity
    want = Counter()
    for i, t in rows:
        want[str(i)] += len((t or "").encode()) + 1
    assert whole == want
    by_id = defaultdict(set)
    for i, t in rows:
        by_id[str(i)].add(hashlib.md5((t or "").encode()).hexdigest())
    used, sources, clusters = Counter(), Counter(), Counter()
    for r in got:
        used[r.bin_id] += r["size"]
        sources[r.bin_id, None if (r.doc_id or 0) % 7 == 3 else (r.doc_id or 0) % 3] += 1
        if len(by_id[str(r.doc_id)]) == 1:
            clusters[r.bin_id, min(by_id[str(r.doc_id)])] += 1
    assert max(used.values()) <= capacity and max(sources.values()) <= per_source and max(clusters.values()) == 1


def test_a_third_of_the_rows_alike_share_no_large_block(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20)
    rows = [(None if i % 3 == 0 else i, "same text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    got = packing.pack(docs(spark, rows).repartition(4), 400, 4).collect()
    assert len(got) == 900
    blocks = Counter(r.bin_id >> 32 for r in got)
    assert max(blocks.values()) <= 4 * 20
    alike = Counter(r.bin_id for r in got if r.doc_id is None)
    assert len(alike) == 300 and max(alike.values()) == 1


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import pytest

from touchline.llm import sharding
from tests.llm.fixtures import awkward_texts, docs, empty


def place(key, weights):
    def score(s):
        u = (int(hashlib.md5(f"{'' if key is None else key}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -weights[s] / math.log(u)

    return max(range(len(weights)), key=lambda s: (score(s), -s))


def test_matches_brute_force_on_awkward_rows(spark):
    rows, weights = awkward_texts(), [1.0, 2.0, 0.5, 1.0]
    got = sharding.assign_shards(docs(spark, rows), weights, 1.5).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), place(i, weights), place(i, [*weights, 1.5])) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, len(weights))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_are_gapless_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_BLOCK", 40)
    df = docs(spark, [(i, f"t{i % 50}") for i in range(1500)])
    slots = defaultdict(list)
    for r in sharding.assign_shards(df, [1.0] * 5).collect():
        slots[r.shard].append(r.slot)
    assert len(slots) == 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_third_of_the_rows_alike(spark, monkeypatch):
    """Slots stay gapless, and no group that is numbered together holds all of them."""
    monkeypatch.setattr(sharding, "SLOT_BLOCK", 40)
    df = docs(spark, [(None if i % 3 == 0 else i, "same" if i % 3 == 0 else f"t{i}") for i in range(1500)]).repartition(4)
    seen, inner = [], sharding.split_hot_blocks
    monkeypatch.setattr(sharding, "split_hot_blocks", lambda *a: seen.append(inner(*a)) or seen[-1])
    slots = defaultdict(list)
    for r in sharding.assign_shards(df, [1.0] * 5).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 1500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(r["count"] for r in seen[0].groupBy("shard", "block", "sub").count().collect()) <= 3 * 40


def test_weights_share_out_rows(spark):
    df = docs(spark, [(i, "t") for i in range(6000)])
    n = {r.shard: r["count"] for r in sharding.assign_shards(df, [3.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(n[0] / 6000 - 0.75) < 0.03


def test_empty_table_and_bad_weights(spark):
    assert sharding.assign_shards(empty(spark), [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(empty(spark), [1.0, 0.0])

"""Operator 1: rendezvous hashing of stable record keys over weighted shards (built-in functions only).

Every (key, shard) pair gets a uniform u in (0, 1) from an MD5 of both; the
shard with the largest ``-weight / ln(u)`` takes the record.  A record's score
on one shard never depends on the other shards, so an added shard only takes
records and no record moves between old shards.

Defined results: a null key hashes as the empty text; a null text has no bytes
and CRC 0; rows that repeat a key share its shard and get slots of their own;
an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, split_hot_blocks

#: Rows numbered together by one window group.
SLOT_BLOCK = 50_000


def rendezvous_score(key: Column, shard: Column, weight: Column) -> Column:
    """Weighted rendezvous score of one key on one shard; larger wins."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit("#"), shard.cast("string")).cast("binary")), 1, 13), 16, 10)
    u = (h.cast("double") + 0.5) / float(1 << 52)
    return -weight / F.log(u)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Index of the winning shard among ``len(weights)`` shards (equal scores: the smaller index)."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scored = F.transform(
        F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]),
        lambda x: F.struct(rendezvous_score(key, x["s"], x["w"]).alias("score"), (-x["s"]).alias("neg")),
    )
    return -F.array_max(scored)["neg"]


def assign_shards(df: DataFrame, weights: Sequence[float], added_weight: float = 1.0, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Shard, slot within the shard (gapless from 0) and the shard after one more shard is added.

    The text is reduced to its size and CRC at the scan, so only narrow rows
    move.  Slots are numbered in two steps: inside hashed blocks of about
    ``SLOT_BLOCK`` rows, then by the running total of the block counts, so no
    shard is ever sorted in one task.  Rows alike in key, size and CRC share a
    block; where they are many, the block is cut by the number of the written row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    n, rows = len(weights), df.count()
    blocks = max(1, -(-rows // (SLOT_BLOCK * n)))
    scored = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), rendezvous_shard(key, weights).alias("shard"), key.alias("key"))
    # The added shard changes a record's place only if its own score beats the winner's.
    won = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard") + 1)
    newer = rendezvous_score(F.col("key"), F.lit(n), F.lit(float(added_weight)))
    placed = materialize(scored.select(
        "doc_id", "size", "text_crc32", "shard",
        F.when(newer > rendezvous_score(F.col("key"), F.col("shard"), won), F.lit(n)).otherwise(F.col("shard")).alias("grown_shard"),
        F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(blocks)).cast("int").alias("block"),
        F.monotonically_increasing_id().alias("salt")), "shards")
    placed = split_hot_blocks(placed, ["shard", "block"], "salt", SLOT_BLOCK)
    counts = placed.groupBy("shard", "block", "sub").count()
    start = counts.select("shard", "block", "sub", (F.sum("count").over(
        Window.partitionBy("shard").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1))).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block", "sub").orderBy("doc_id", "size", "text_crc32")) - 1
    return (placed.withColumn("inside", inside).join(start, ["shard", "block", "sub"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.coalesce("start", F.lit(0)) + F.col("inside")).cast("long").alias("slot"),
                    F.col("grown_shard").cast("int").alias("grown_shard")))


__all__ = ["SLOT_BLOCK", "assign_shards", "rendezvous_score", "rendezvous_shard"]

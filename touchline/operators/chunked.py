"""Exact bounded-lookback window frames over hot keys.

A window such as "mean of a team's previous five matches" is naturally
``partitionBy(league, team)``; with one team holding a large share of all
rows that puts one enormous group in one task. Here the group is split by a
time chunk (``chunk``, e.g. the month or season of the match) so every task
holds one (key, chunk) slice. Only the first ``lookback`` rows of each slice
see rows of earlier slices; they are recomputed from a small "halo":

1. window over (key, chunk): frame values (exact for rows past the first
   ``lookback``) and the row number; a key that lies in one slice is done;
   steps 2-4 read the rows of the other keys alone;
2. tails = last ``lookback`` rows of every slice; heads = first ``lookback``;
3. the halo of slice c is the ``lookback`` tail rows immediately before c in
   the key's order — found with a window over the tails (``lookback`` rows per
   slice, tiny) that forwards each tail row to the later slices starting
   within its reach;
4. heads ∪ halo are windowed again (small), and replace the heads.

The large input is shuffled once (step 1); steps 2–4 touch
``O(lookback · slices)`` rows. Results are identical to the unsplit window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# A frame spec: output column name → function(WindowSpec) -> Column.
FrameSpecs = dict[str, Callable[[Window], Column]]


def chunked_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    specs: FrameSpecs,
    lookback: int,
    carry: Sequence[str],
    bounded: bool = False,
) -> DataFrame:
    """Apply frame columns ``specs`` (frames ending at or before the current row,
    reaching back at most ``lookback`` rows) over ``partitionBy(keys).orderBy(order)``.

    ``carry`` are the input columns the frame expressions read. ``chunk`` must
    be monotone in ``order`` (e.g. a truncation of the first order column).
    ``bounded``: the chunks are range slices (see ``mark_split``). Output: ``df``'s columns plus one column per spec.
    """
    keys, order = list(keys), list(order)
    base = df.withColumn("_chunk", chunk)
    w_slice = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    w_slice_desc = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    frames = [fn(w_slice).alias(name) for name, fn in specs.items()]
    if lookback <= 0:
        return base.select("*", *frames).drop("_chunk")

    base = mark_split(base, keys, bounded)
    step1 = base.select("*", F.row_number().over(w_slice).alias("_rn"), *frames)
    payload = list(dict.fromkeys([*keys, *order, *carry]))
    split = base.where("_split")
    tails = split.withColumn("_rn_desc", F.row_number().over(w_slice_desc)).where(F.col("_rn_desc") <= lookback).select(*payload, "_chunk")
    heads = split.withColumn("_rn", F.row_number().over(w_slice)).where(F.col("_rn") <= lookback)

    # Halo: each tail row is forwarded to every later slice that starts within
    # `lookback` tail rows after it (at most `lookback` slices).
    w_tail = Window.partitionBy(*keys).orderBy("_chunk", *order)
    ahead = F.collect_set("_chunk").over(w_tail.rowsBetween(1, lookback))
    halo = (
        tails.select("*", ahead.alias("_targets"))
        .select(*payload, "_chunk", F.explode("_targets").alias("_target"))
        .where(F.col("_target") != F.col("_chunk"))
        .select(*payload, F.col("_target").alias("_chunk"), F.lit(True).alias("_halo"))
    )
    head_rows = heads.select(*payload, "_chunk", F.lit(False).alias("_halo"), *[c for c in df.columns if c not in payload and c != "_chunk"])
    fix_in = head_rows.unionByName(halo, allowMissingColumns=True)
    fixed = fix_in.select("*", *[fn(w_slice).alias(name) for name, fn in specs.items()]).where(~F.col("_halo"))

    out_cols = [*[c for c in df.columns if c != "_chunk"], *specs.keys()]
    body = step1.where(~F.col("_split") | (F.col("_rn") > lookback)).select(*out_cols)
    return body.unionByName(fixed.select(*out_cols))


def split_slices(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``_chunk``) of the keys that lie in several chunks. Range slices cut at most one key each, so
    there are at most two such rows a slice, however many keys and rows there are."""
    parts = marked.select(*keys, "_chunk").distinct()
    return parts.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_parts > 1").drop("_parts")


def split_rows(keys: Sequence[str], found: DataFrame, bounded: bool) -> tuple[DataFrame, Column]:
    """``found`` (from ``split_slices``) under other names, and the condition that joins it, null keys included."""
    names = [*keys, "_chunk"]
    found = found.select(*[F.col(c).alias(f"_split_{i}") for i, c in enumerate(names)], F.lit(True).alias("_split"))
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_split_{i}")) for i, c in enumerate(names)])
    return (F.broadcast(found) if bounded else found), cond


def mark_split(base: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    """``base`` with ``_split``: whether the row's key lies in several chunks. With ``bounded`` the chunks are
    range slices, whose split keys are few by construction, so their list is sent to the tasks."""
    found, cond = split_rows(keys, split_slices(base, keys), bounded)
    return base.join(found, cond, "left").select(*base.columns, F.coalesce("_split", F.lit(False)).alias("_split"))


def chunked_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                       name: str = "row_number") -> DataFrame:
    """Exact ``row_number()`` over ``partitionBy(keys).orderBy(order)`` without one
    task per key: rows are numbered within (key, chunk) slices and offset by
    the row count of all earlier slices of the key (a small per-slice table
    with a running sum). ``chunk`` must be monotone in ``order``."""
    keys = list(keys)
    base = df.withColumn("_chunk", chunk)
    counts = base.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    w_prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).cast("long").alias("_offset"))
    w_slice = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = base.withColumn("_rn", F.row_number().over(w_slice).cast("long"))
    return (numbered.join(offsets, [*keys, "_chunk"])
            .withColumn(name, F.col("_offset") + F.col("_rn"))
            .drop("_chunk", "_rn", "_offset"))


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """``df`` range-partitioned by (keys, order), each row marked with its partition as ``_chunk``.

    The ranges come from a sample of the rows, so a key of any size is cut into
    slices of about equal rows, and the slice is monotone in ``order`` whatever
    the order columns hold (kick-off times, equal timestamps, hashed ids): rows
    with equal keys and order never part. The marked rows are written once to
    the shared folder, because the plans below read them several times and the
    ranges would otherwise be sampled anew for each reading."""
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "slices")
    marked = df.repartitionByRange(max(1, n), *keys, *order).withColumn("_chunk", F.spark_partition_id())
    marked.write.parquet(path)
    return spark.read.schema(marked.schema).parquet(path)


def bounded_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: FrameSpecs, lookback: int,
                   carry: Sequence[str], slices: int | None = None) -> DataFrame:
    """Frame columns over ``partitionBy(keys).orderBy(order)``, computed by range slice at every size."""
    marked = range_slices(df, keys, order, slices)
    return chunked_window(marked, keys, order, F.col("_chunk"), specs, lookback, carry, bounded=True).drop("_chunk")


def bounded_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number",
                       slices: int | None = None) -> DataFrame:
    """``row_number()`` per key, numbered by range slice at every size."""
    return chunked_row_number(range_slices(df, keys, order, slices), keys, order, F.col("_chunk"), name)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "_nth") -> DataFrame:
    """The last ``n`` rows of every key by ``order``, numbered 1 (the last) to n.

    A rank filter over a window is a group limit that Spark applies before the shuffle too, so each task
    sends at most ``n`` rows of a key, however many it holds; nothing else of the history moves."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "row_number", start: int = 0, slices: int | None = None) -> DataFrame:
    """``start`` + 1, 2, … over all rows by ``order``: numbered inside range slices, each slice offset by
    the rows of the earlier ones. The driver sees one count a slice; no task sees all rows."""
    marked = range_slices(df, [], order, slices)
    counts = {r["_chunk"]: r["count"] for r in marked.groupBy("_chunk").count().collect()}
    offsets, total = [], start
    for chunk in range(max(counts, default=0) + 1):
        offsets.append(F.lit(total).cast("long"))
        total += counts.get(chunk, 0)
    w = Window.partitionBy("_chunk").orderBy(*order)
    nth = F.element_at(F.array(*offsets), F.col("_chunk") + 1) + F.row_number().over(w)
    return marked.withColumn(name, nth.cast("long")).drop("_chunk")

"""Operator 5: best-fit packing of documents into bins, with conflicts.

A document takes its UTF-8 bytes plus one separator.  One longer than a bin is
cut into pieces of a whole bin and a rest.  Pieces are dealt by a hash into
blocks of about ``BLOCK`` pieces (pieces alike in id, text and size share one;
where they are many, it is cut by the number of the written row); inside a
block they are placed in decreasing size.  The open bins stand ordered by residual.  Bins carry two bitmaps: which
duplicate clusters they hold, and which sources are full there (``per_source``
pieces).  The successor search starts at the smallest residual that fits and
walks upwards, many bins at a time, to the tightest bin without a conflict; a
new bin is opened if there is none.

Defined results: null or empty text takes one byte; a null source is a source
of its own; equal texts form a duplicate cluster, and so do null and empty
texts; rows that repeat an id are separate pieces; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, split_hot_blocks

BLOCK = 8192


class Bins:
    """Open bins of one block, ordered by residual, with their bitmaps."""

    def __init__(self, pieces: int, sources: int, clusters: int, capacity: int, per_source: int):
        self.capacity, self.per_source, self.n = capacity, per_source, 0
        self.residual = np.empty(pieces, np.int64)  # ordered
        self.bin = np.empty(pieces, np.int32)
        self.open = 0
        self.held = np.zeros((sources, pieces), np.uint8)
        self.full = np.zeros((sources, pieces), bool)
        self.inside = np.zeros((clusters, pieces), bool)

    def _put(self, residual: int, b: int) -> None:
        at = int(np.searchsorted(self.residual[:self.open], residual))
        self.residual[at + 1:self.open + 1] = self.residual[at:self.open]
        self.bin[at + 1:self.open + 1] = self.bin[at:self.open]
        self.residual[at], self.bin[at] = residual, b
        self.open += 1

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes the piece; ``cluster`` is -1 for a text without copies in the block."""
        at = int(np.searchsorted(self.residual[:self.open], size))
        step = 32
        while at < self.open:
            near = self.bin[at:min(self.open, at + step)]
            clash = self.full[source, near]
            if cluster >= 0:
                clash = clash | self.inside[cluster, near]
            first = int(np.argmin(clash))
            if not clash[first]:
                b, left = int(near[first]), int(self.residual[at + first]) - size
                at += first
                self.residual[at:self.open - 1] = self.residual[at + 1:self.open]
                self.bin[at:self.open - 1] = self.bin[at + 1:self.open]
                self.open -= 1
                break
            at += len(near)
            step *= 4
        else:
            b, left = self.n, self.capacity - size
            self.n += 1
        if left > 0:
            self._put(left, b)
        self.held[source, b] += 1
        self.full[source, b] = self.held[source, b] >= self.per_source
        if cluster >= 0:
            self.inside[cluster, b] = True
        return b


def pack_block(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, per_source: int) -> np.ndarray:
    """Bin of each piece; the pieces come in the order in which they are placed."""
    _, source = np.unique(source, return_inverse=True)
    keys, inverse, count = np.unique(cluster, return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    bins = Bins(len(size), int(source.max()) + 1, int((count > 1).sum()), capacity, per_source)
    return np.array([bins.place(int(s), int(f), int(c)) for s, f, c in zip(size, source, number[inverse], strict=True)], np.int64)


def pack(docs: DataFrame, capacity: int = 32_768, per_source: int = 4, cluster: Column | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, piece, byte_offset, size, bin_id, place: every piece of every document in exactly one bin."""
    if not 1 <= per_source <= 255:
        raise ValueError("per_source must be 1 to 255")
    id_type = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        (cluster if cluster is not None else F.xxhash64(body)).alias("cluster"),
                        (F.octet_length(body) + F.lit(1)).cast("long").alias("total"))
    cut = F.sequence(F.lit(0), (F.ceil(F.col("total") / capacity) - 1).cast("int"))
    pieces = materialize(whole.select("*", F.explode(cut).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("byte_offset"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece").cast("long") * capacity).alias("size"),
        F.xxhash64("source").alias("source"), F.col("cluster").cast("long").alias("cluster"),
        F.monotonically_increasing_id().alias("salt")), "packing-pieces")
    blocks = max(1, -(-pieces.count() // BLOCK))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "cluster", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        b = pack_block(f["size"].to_numpy(), f["source"].to_numpy(), f["cluster"].to_numpy(), capacity, per_source)
        out = f.assign(bin_id=f["block"].astype("int64") * (1 << 32) + b)
        out["place"] = out.groupby("bin_id").cumcount().astype("int32")
        return out[["doc_id", "piece", "byte_offset", "size", "bin_id", "place"]]

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "size"), F.lit(blocks)))
    dealt = split_hot_blocks(dealt, ["block"], "salt", BLOCK).withColumn("block", F.col("block") + F.col("sub") * F.lit(blocks))
    return dealt.groupBy("block").applyInPandas(
        run, f"doc_id {id_type}, piece int, byte_offset long, size long, bin_id long, place int")

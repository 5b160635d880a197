"""Operator 9: SimHash near-duplicates through the segment-popcount embedding.

A fingerprint's embedding is its 32 two-bit segments' bit counts, packed into
one 64-bit word.  The Manhattan distance of two embeddings never exceeds the
fingerprints' Hamming distance, so it bounds from below.  The range join runs
on a grid of the embedding space: the segments form ``GROUPS`` groups, and two
fingerprints at ``max_bits`` or fewer bits differ in at most ``max_bits``
groups, so for some choice of the other groups both lie in the same unit cell.
One key per choice finds every pair; the Manhattan distance over all segments
filters, and the Hamming distance decides.

Equal fingerprints are one node from the start.  A cell returns a spanning
forest of its links, never all pairs.  A cell of more than ``TILE``
fingerprints is dealt out as pairs of tiles.  Components are found by
alternating star contraction over written tables.

Defined results: text without words has fingerprint zero and links like any
other; null text is empty; rows that repeat an id get that id's row each; rows
with a null id take part and come last when a component's smallest id is
taken; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, lower_ascii, materialize, parallelism, texts

#: Segment groups of the grid; cells of more fingerprints than TILE are split.
GROUPS, TILE = 6, 4096
SEED = 42
_ODD = 0x5555555555555555


def shingle_hashes(body: bytes, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``words`` words, as unsigned 64-bit numbers."""
    found = WORD.findall(lower_ascii(body))
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    first = np.concatenate(([0], ends[:-words])).tolist()
    last = (ends[words - 1:] - 1).tolist()
    pieces = map(line.__getitem__, map(slice, first, last))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, itertools.repeat(SEED)), np.uint64, len(first))


def simhash(body: bytes, words: int = 3, block: int = 65_536) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the shingle hashes."""
    h = shingle_hashes(body, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        bits = np.unpackbits(h[i:i + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one map pass over whole texts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        for b in frames:
            fps = np.array([simhash(x, words) for x in b.column("body").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed in place (two bits each)."""
    high = F.shiftrightunsigned(fp, 1)
    ones = fp.bitwiseXOR(high).bitwiseAND(F.lit(_ODD))
    return ones.bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(_ODD)), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(max_bits: int, groups: int = GROUPS) -> list[int]:
    """Masks of the segments that stay when ``max_bits`` of the groups are left out, as signed longs."""
    if not 0 <= max_bits < groups:
        raise ValueError("max_bits must be below the number of segment groups")
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    part = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(part[g] for g in keep)) for keep in itertools.combinations(range(groups), groups - max_bits)]


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed two-bit counts (0..2 each)."""
    low = np.uint64(_ODD)
    # |x - y| for x, y in 0..2: 1 where the low bits differ, 2 where only the high bits do.
    d = a ^ b
    one = np.bitwise_count(d & low).astype(np.int16)
    two = np.bitwise_count((d >> np.uint64(1)) & low & ~d).astype(np.int16)
    return one + 2 * two


def _cell_links(x: np.ndarray, y: np.ndarray | None, max_bits: int):
    """Spanning links of one cell: fingerprints of one tile among themselves, or of two tiles."""
    both = x if y is None else np.concatenate((x, y))
    parent = np.arange(len(both))
    emb = both - ((both >> np.uint64(1)) & np.uint64(_ODD))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(x)):
        lo = i + 1 if y is None else len(x)
        near = np.flatnonzero(_manhattan(emb[lo:], emb[i]) <= max_bits) + lo
        near = near[np.bitwise_count(both[near] ^ both[i]) <= max_bits]
        for j in near:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield both[i], both[j]


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` at ``max_bits`` or fewer bits, enough to connect them all."""
    n = parallelism(distinct.sparkSession)
    emb = embedding(F.col("fp"))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), emb.bitwiseAND(F.lit(m)).alias("cell"))
                     for i, m in enumerate(cell_masks(max_bits))])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.cell", "fp")
    hot = (keyed.groupBy("choice", "cell").count().where(F.col("count") > TILE)
           .select("choice", "cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                         lambda t: F.struct(F.least(t, tile).alias("lo"), F.greatest(t, tile).alias("hi"), tile.alias("own")))
    dealt = (keyed.join(hot, ["choice", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
             .select("choice", "cell", "fp", F.explode(spread).alias("t")).select("choice", "cell", "fp", "t.*"))

    def run(frames):
        held_key, held = None, []

        def close():
            fp = np.concatenate([h[0] for h in held])
            own = np.concatenate([h[1] for h in held])
            if len(fp) < 2:
                return None
            x, y = (fp, None) if held_key[2] == held_key[3] else (fp[own == held_key[2]], fp[own == held_key[3]])
            got = list(_cell_links(x, y, max_bits))
            return np.array(got, np.uint64).view(np.int64).reshape(-1, 2) if got else None

        for f in frames:
            k = f[["choice", "cell", "lo", "hi"]].to_numpy()
            if not len(k):
                continue
            fp, own = f["fp"].to_numpy().view(np.uint64), f["own"].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            out = []
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(k)])), strict=True):
                key = tuple(k[a].tolist())
                if key != held_key:
                    if held and (got := close()) is not None:
                        out.append(got)
                    held_key, held = key, []
                held.append((fp[a:b], own[a:b]))
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])
        if held and (got := close()) is not None:
            yield pd.DataFrame(got, columns=["a", "b"])

    cells = dealt.repartition(n, "choice", "cell", "lo", "hi").sortWithinPartitions("choice", "cell", "lo", "hi")
    return cells.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have links.

    Large-star and small-star rounds: in each, every node hands its neighbours
    the smallest node it knows.  Each half round is one grouped minimum and
    one join, written to the shared folder.  The rounds needed grow with the
    logarithm of the largest component's diameter.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                      "components")
    sign = _signature(cur)
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        after = materialize(small, "components")
        now = _signature(after)
        discard(cur)
        cur = after
        if now == sign:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now
    raise RuntimeError("components did not settle")


def _signature(df: DataFrame):
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable): one row per document."""
    marked = materialize(fingerprints(docs, words, id_col, text_col), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    best = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = grouped.join(best, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

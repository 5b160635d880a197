"""Operator 11: vectors compressed to one code a part, by Lloyd rounds that compare active entries only.

Components become integers, so every distance, sum and mean is exact and no
partitioning can change a result.  A vector's parts each have a codebook; the
state of a round is one row a vector with its integers, the entry each part is
assigned to and the exact squared distance to it, written to the shared folder.

A round's update moves some entries.  A part whose own entry stayed fixed still
knows its exact distance, and every other fixed entry is as far as before, so
only the moved entries are compared with it; a part whose entry moved rescans
the whole codebook.  Equal distances go to the lower index both ways.  Sums are
taken inside each task first: a task sends at most one row an entry component.
What reaches the driver are the codebooks, ``entries`` times the dimension.

Defined results: vectors that are null, empty or hold null or non-finite
components are dropped, and so are components whose integer needs more than 28
bits (distances would not fit 64); vectors of another length than the commonest
one (ties: the longer) are dropped.  Parts are cut as evenly as they go where
the length is no multiple.  The first entries are the smallest ids (null last,
equal ids by their vectors); fewer vectors than entries give fewer entries.
Rows that repeat an id are coded each for itself; a null id stays null; null
labels are one label.  An empty table gives an empty result with empty
codebooks; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Vectors compared with a codebook at once.
CHUNK = 4096
_EXACT, _LIMIT = 1 << 53, 1 << 28


@dataclass
class Compressed:
    """``rows``: (vec_id, label, codes, error); ``codebooks``: one integer matrix (entries by components) a part."""

    rows: DataFrame
    codebooks: list[np.ndarray]


def integers(df: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, q): floor(scale * x) of each component, for vectors of the commonest length."""
    x = F.col("vector")
    q = F.transform(x, lambda v: v.cast("double") * scale)
    bad = F.exists(q, lambda v: v.isNull() | F.isnan(v) | ~((v >= -_LIMIT) & (v < _LIMIT)))
    rows = (df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
            .where(x.isNotNull() & (F.size(x) > 0) & ~bad)
            .select("vec_id", "label", F.transform(q, lambda v: F.floor(v)).alias("q")))
    length = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("q") == (length[0]["n"] if length else 0))


def edges(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and the last one ends."""
    return [dim * p // parts for p in range(parts + 1)]


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by entries."""
    size = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * size * size * max(1, x.shape[1]) < _EXACT else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of every vector; equal distances go to the lower index."""
    d = _distances(x, book)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def active_nearest(x: np.ndarray, code: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same after some entries moved, from the codes and distances before."""
    code, dist = code.copy(), dist.copy()
    own = moved[code]
    if own.any():
        code[own], dist[own] = nearest(x[own], book)
    changed, rest = np.flatnonzero(moved), np.flatnonzero(~own)
    if len(changed) and len(rest):
        c, d = nearest(x[rest], book[changed])
        c = changed[c]
        wins = (d < dist[rest]) | ((d == dist[rest]) & (c < code[rest]))
        code[rest[wins]], dist[rest[wins]] = c[wins], d[wins]
    return code, dist


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), kind))


def _assign(books: list[np.ndarray], moved: list[np.ndarray] | None, cuts: list[int]):
    """Map of state rows to state rows: every part to its nearest entry, all entries where ``moved`` is none."""
    def run(frames):
        for f in frames:
            for at in range(0, f.num_rows, CHUNK):
                b = f.slice(at, CHUNK)
                get = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
                q = _matrix(get("q"), cuts[-1])
                codes, dists = (np.empty((len(q), len(books)), np.int64) for _ in range(2))
                if moved is not None:
                    before, known = _matrix(get("codes"), len(books)), _matrix(get("dists"), len(books))
                for p, book in enumerate(books):
                    x = q[:, cuts[p]:cuts[p + 1]]
                    codes[:, p], dists[:, p] = (nearest(x, book) if moved is None else
                                                active_nearest(x, before[:, p], known[:, p], book, moved[p]))
                yield pa.RecordBatch.from_arrays([get("vec_id"), get("label"), get("q"), _lists(codes, pa.int32()), _lists(dists, pa.int64())],
                                                 ["vec_id", "label", "q", "codes", "dists"])
    return run


def _sums(books: list[np.ndarray], cuts: list[int]):
    """Map of state rows to (part, entry, pos, total, n): one task's sums of each entry's parts."""
    def run(frames):
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for f in frames:
            q, codes = (_matrix(f.column(f.schema.get_field_index(n)), w) for n, w in (("q", cuts[-1]), ("codes", len(books))))
            for p in range(len(books)):
                np.add.at(total[p], codes[:, p], q[:, cuts[p]:cuts[p + 1]])
                count[p] += np.bincount(codes[:, p], minlength=len(count[p]))
        for p, (t, n) in enumerate(zip(total, count, strict=True)):
            used = np.flatnonzero(n)
            width = t.shape[1]
            if len(used) and width:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used) * width, p), pa.int32()), pa.array(np.repeat(used, width), pa.int32()),
                     pa.array(np.tile(np.arange(width), len(used)), pa.int32()), pa.array(t[used].ravel(), pa.int64()),
                     pa.array(np.repeat(n[used], width), pa.int64())], ["part", "entry", "pos", "total", "n"])
    return run


def _updated(state: DataFrame, books: list[np.ndarray], cuts: list[int]) -> list[np.ndarray]:
    """Codebooks with every used entry at the floored mean of its parts."""
    sums = (state.select("q", "codes").mapInArrow(_sums(books, cuts), "part int, entry int, pos int, total long, n long")
            .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most entries x dimension rows
        out[r["part"]][r["entry"], r["pos"]] = r["total"] // r["n"]
    return out


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id",
             vec_col: str = "embedding", label_col: str = "label") -> Compressed:
    """Codes of every vector after ``rounds`` Lloyd rounds and a last assignment, with the final codebooks."""
    rows = materialize(integers(df, scale, id_col, vec_col, label_col), "codes-integers")
    seeds = [r["q"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()]
    first = np.array(seeds, np.int64).reshape(len(seeds), len(seeds[0]) if seeds else 0)
    cuts = edges(first.shape[1], parts)
    books = [first[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    kept = ["vec_id", "label", "q"]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept) + ", codes array<int>, dists array<long>"
    if not seeds:
        none = rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
        return Compressed(none, books)
    state = materialize(rows.mapInArrow(_assign(books, None, cuts), schema), "codes-state")
    discard(rows)
    for _ in range(rounds):
        fresh = _updated(state, books, cuts)
        moved = [(a != b).any(axis=1) for a, b in zip(fresh, books, strict=True)]
        books, before = fresh, state
        state = materialize(before.mapInArrow(_assign(books, moved, cuts), schema), "codes-state")
        discard(before)
    error = F.aggregate("dists", F.lit(0).cast("long"), lambda a, d: a + d)
    return Compressed(state.select("vec_id", "label", "codes", error.alias("error")), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` and the error summed over equal labels (nulls together)."""
    # Written, so that its size is known: Spark broadcasts it when small and splits a hot label's join otherwise.
    total = materialize(rows.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return rows.join(total, F.col("label").eqNullSafe(F.col("same_label"))).drop("same_label")


def listing(codebooks: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position, as decimal integers joined by commas."""
    return ",".join(str(x) for book in codebooks for x in book.ravel().tolist())

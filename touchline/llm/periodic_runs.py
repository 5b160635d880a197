"""Operator 12: runs of words that repeat with a period, by a branching-tandem test on suffix arrays.

Every document is a string of word numbers; documents share no numbers, so the
suffixes of many short documents are ordered together without ever matching
across documents.  Per group of documents (one Arrow batch or less; a long
document is alone):

1. suffix array by prefix doubling, where later rounds order only suffixes not
   yet told apart; its inverse; longest common prefixes from the kept ranks;
2. LCP intervals as index ranges (next smaller values on both sides, found by
   descending a table of range minima), never as tree nodes;
3. for each interval of depth D, every suffix i outside its largest child is
   tested: if the inverse array puts i + D or i - D into the interval but in
   another child, a square of period D starts at the smaller of the two and
   cannot be moved one word to the right;
4. such squares are rotated to the left as far as the period holds.  Each run
   has one square that cannot move right for each of its periods; runs of one
   end are merged smallest period first.

The work is n log n for n words of a document, and about 150 bytes of memory a
word of the group.  Words are told apart by their bytes, not by hashes.

Defined results: a null or empty text, and one of white space alone, has no
words, no runs and the empty string; rows that repeat an id are each handled
for their own text and ids play no part in it; a null id stays null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, texts

#: Shortest run in words, and in periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words of documents handled together; a longer document is handled alone.
GROUP = 1 << 18


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, common prefix of each suffix with the one before) of numbers whose last is unique."""
    n = len(s)
    ranks = [s.astype(np.int32 if n < 2**31 else np.int64)]
    top = int(s.max()) + 1
    key = s.astype(np.int64) * top
    key[:-1] += s[1:]
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots, ordered, h = np.arange(n), key[sa], 2
    while True:
        # ``slots`` are the places just ordered; equal keys are a group, named by its first place.
        first = np.ones(len(slots), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        name = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))] if len(slots) else slots
        rank[sa[slots]] = name
        last = np.ones(len(slots), bool)
        last[:-1] = first[1:]
        slots = slots[~(first & last)]
        if not len(slots):
            break
        ranks.append(rank.astype(ranks[0].dtype))
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[at + h]
        order = np.argsort(key)
        sa[slots], ordered, h = at[order], key[order], h * 2
    return sa, rank, _common(sa, ranks)


def _common(sa: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Common prefixes of neighbours: equal ranks of level k are 2**k equal words."""
    out = np.zeros(len(sa), np.int64)
    pair = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]]) + 1
    a, b, got = sa[pair - 1], sa[pair], np.zeros(len(pair), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        got += (ranks[k][a + got] == ranks[k][b + got]).astype(np.int64) << k
    out[pair] = got
    return out


class _Minima:
    """Range minima of the common prefixes, for the nearest smaller value on either side."""

    def __init__(self, lcp: np.ndarray) -> None:
        gaps = np.diff(np.flatnonzero(np.concatenate((lcp, [0])) == 0))
        self.top = int(gaps.max() if len(gaps) else 1).bit_length()
        self.pad = 1 << self.top
        m = np.concatenate((np.zeros(self.pad, np.int64), lcp, np.zeros(self.pad, np.int64)))
        self.levels = [m]
        for j in range(self.top):
            m = np.minimum(m[:-(1 << j)], m[1 << j:])
            self.levels.append(m)

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Last index before ``at`` whose value is below ``bound``."""
        pos = at + self.pad
        for j in range(self.top, -1, -1):
            pos = pos - ((self.levels[j][pos - (1 << j)] >= bound).astype(np.int64) << j)
        return pos - 1 - self.pad

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First index after ``at`` whose value is below ``bound``."""
        pos = at + 1 + self.pad
        for j in range(self.top, -1, -1):
            pos = pos + ((self.levels[j][pos] >= bound).astype(np.int64) << j)
        return pos - self.pad


def _smaller_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, end, interval first, interval end, depth) of every child of every interval but its largest."""
    at = np.flatnonzero(lcp)
    depth, minima = lcp[at], _Minima(lcp)
    lo, hi = minima.left(at, depth), minima.right(at, depth)
    before, after = minima.left(at, depth + 1), minima.right(at, depth + 1)
    final = after == hi
    start, end = np.concatenate((before, at[final])), np.concatenate((at, hi[final]))
    lo, hi, depth = (np.concatenate((x, x[final])) for x in (lo, hi, depth))
    node = lo * (len(lcp) + 2) + hi
    order = np.lexsort((end - start, node))
    small = order[:-1][node[order[:-1]] == node[order[1:]]]
    return start[small], end[small], lo[small], hi[small], depth[small]


def squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that cannot be moved one place to the right."""
    sa, isa, lcp = suffix_array(s)
    start, end, lo, hi, depth = _smaller_children(lcp)
    size = end - start
    child = np.repeat(np.arange(len(size)), size)
    i = sa[np.arange(len(child)) - np.repeat(np.cumsum(size) - size - start, size)]
    d, found = depth[child], []
    for j in (i + d, i - d):
        inside = np.flatnonzero((j >= 0) & (j < len(s)))
        place, c = isa[j[inside]], child[inside]
        inside = inside[(place >= lo[c]) & (place < hi[c]) & ((place < start[c]) | (place >= end[c]))]
        found.append(np.stack((np.minimum(i, j)[inside], d[inside])))
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def _rotations(s: np.ndarray, i: int, d: int) -> int:
    """How many places the square of period ``d`` at ``i`` moves to the left."""
    done, step = 0, 32
    while done < i:
        a = max(0, i - done - step)
        differ = np.flatnonzero(s[a:i - done] != s[a + d:i - done + d])
        if len(differ):
            return done + (i - done - a) - 1 - int(differ[-1])
        done, step = i - a, step * 2
    return done


def runs_of(s: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the long enough runs of ``s``, by end."""
    at, period = squares(s)
    need = np.maximum(min_words, min_periods * period) - 2 * period
    # A few rotations at once for all squares; almost none survives them.
    for t in range(1, 9):
        more = (need < t) | ((at >= t) & (s[at - t] == s[at - t + period]))
        at, period, need = at[more], period[more], need[more]
    out, order, last = [], np.lexsort((period, at + 2 * period)), None
    for i, d, n in zip(at[order].tolist(), period[order].tolist(), need[order].tolist(), strict=True):
        end = i + 2 * d
        if end != last:
            here, last = [], end
        # A multiple of a shorter period inside its run is that run again.
        if any(d % q == 0 and i >= a for a, q in here):
            continue
        turned = _rotations(s, i, d)
        if turned >= n:
            here.append((i - turned, d))
            out.append((i - turned, 2 * d + turned, d))
    return out


def _grouped(frames: Iterator, size: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words) of documents of about ``size`` words together."""
    ids, held, n = [], [], 0
    for some, bodies in batches(frames, "doc_id", "body"):
        for doc, body in zip(some, bodies, strict=True):
            words = body.split()
            if held and n + len(words) > size:
                yield ids, held
                ids, held, n = [], [], 0
            ids.append(doc)
            held.append(words)
            n += len(words)
    if held:
        yield ids, held


def _numbered(held: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all documents, none shared, each document closed by a number of its own; and where each starts."""
    numbers, base, offsets = [], 0, [0]
    for words in held:
        seen: dict[bytes, int] = {}
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        numbers.append(np.array([base + len(seen)], np.int64))
        base += len(seen) + 1
        offsets.append(offsets[-1] + len(words) + 1)
    return np.concatenate(numbers), np.array(offsets)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside all runs, and of each run its first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period:start + length] = True
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return b" ".join(words).decode("utf-8", "replace")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _map(min_words: int, min_periods: int, id_type: pa.DataType, size: int):
    def run(frames):
        for ids, held in _grouped(frames, size):
            s, offsets = _numbered(held)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in ids]
            # Documents shorter than the shortest run need no order.
            if max(len(w) for w in held) >= min_words:
                for start, length, period in runs_of(s, min_words, min_periods):
                    doc = int(np.searchsorted(offsets, start, "right")) - 1
                    runs[doc].append((start - int(offsets[doc]), length, period))
            for found in runs:
                found.sort(key=lambda r: (r[0], r[2]))
            listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([len(w) for w in held], pa.int64()), pa.array(listed, pa.list_(_RUN)),
                 pa.array([_kept(w, r) for w, r in zip(held, runs, strict=True)], pa.string())],
                ["doc_id", "n_words", "runs", "kept"])
    return run


def find_runs(df: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, id_col: str = "doc_id",
              text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, runs, kept): every maximal periodic run of words, by start and period, and the text
    collapsed: each run reduced to its first period, words joined by one space."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = texts(df, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string"
    return rows.mapInArrow(_map(min_words, min_periods, to_arrow_type(id_type), group), schema)


def strongest(runs: str = "runs") -> Column:
    """The run of the greatest exact length / period (ties: smallest start, then period); null where there is none."""
    # Listed by start and period, so only a strictly greater quotient replaces the one held.
    def better(held: Column, r: Column) -> Column:
        return F.when(r["length"] * held["period"] > held["length"] * r["period"], r).otherwise(held)

    return F.when(F.size(runs) > 0, F.aggregate(F.col(runs), F.element_at(F.col(runs), 1), better))


def looped(text: Column, start: Column, period: Column) -> Column:
    """The text whose words from number ``start`` on repeat the ``period`` words that begin there."""
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    rest = F.size(words) - start
    # Whole circles side by side, cut to length: a lambda would find the words again for each of them.
    circles = F.array_repeat(F.slice(words, start + 1, period), F.ceil(rest / period).cast("int"))
    return F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(F.flatten(circles), F.lit(1), rest)), " ")

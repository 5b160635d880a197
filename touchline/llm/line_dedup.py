"""Operator 4: repeated runs of lines, found by winnowing over line hashes.

A text's units are its lines, long lines being cut after sentence ends; blank
units are skipped.  Among every ``window`` consecutive unit hashes the smallest
(the rightmost of equals) is selected, so two texts that share ``window`` or
more consecutive units share a selected fingerprint inside the run.

A selected fingerprint stands for the group of consecutive windows that hold it
as their minimum (those reach ``window - 1`` units to either side).  Groups
travel as arrays, by bucket of the fingerprint; each piece of texts sends the
first of each kind only.  A group that occurred before, in (doc_id, text hash,
unit) order, marks its units for deletion.  Groups of one fingerprint that
differ are taken apart: the texts of the first of each kind are read again, and
their windows are judged one by one in the same way.  Overlapping windows make
longer runs.  A run's first occurrence stays.

With ``words`` the same holds of words, in the same pass: every window of that
many words that occurred before is deleted, whatever lines or sentences it
begins or ends in, so a repeated run goes to its exact word ends.  Words are
the bytes between white space.  Winnowing takes the smallest hash of ``GRAM``
words in each such window.

Defined results: null text stays null, empty text stays; texts with fewer than
``window`` units are unchanged; a text whose units all go becomes empty and its
row stays; rows that share id and text are one occurrence and change alike;
null ids come last; an empty table gives an empty result; further columns are
passed through.  ``n_units_cut`` counts the units that lose any word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as word_spans
from .common import discard, free_name, materialize, mix64, parallelism

#: Words that one word fingerprint covers.
GRAM = 16
#: Words of the shortest run that is found wherever it begins.
RUN = 50
#: Bytes of text whose groups of windows are packed together.
PACK = 2 << 20

#: A unit: a stretch of one line up to and with a sentence end before a blank, or up to the line's end.
UNIT = re.compile(rb"[^\n]*?[.!?](?=[ \t\r\n]|\Z)|[^\n]+")

#: The bytes that end a sentence, and those that must follow.
SENTENCE_END, BLANK = (np.isin(np.arange(256), list(x)) for x in (b".!?", b" \t\r\n"))


def units(body: bytes) -> list[tuple[int, int]]:
    """Byte spans of the non-blank units of a text."""
    return [m.span() for m in UNIT.finditer(body) if not m.group().isspace() and m.end() > m.start()]


def unit_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the stripped units of whole rows, from the spans of their words: a unit ends with a word, since
    a line break lies between words and a sentence end is a word's last byte."""
    if not len(start):
        return start, end, row
    after = data[end[:-1]]  # between two words; at a row's end it does not matter
    breaks = SENTENCE_END[data[end[:-1] - 1]] & BLANK[after]
    breaks |= (after == 10) | (row[1:] != row[:-1])
    wide = np.flatnonzero(start[1:] - end[:-1] > 1)
    lines = np.flatnonzero(data == 10)
    breaks[wide] |= np.searchsorted(lines, end[wide]) < np.searchsorted(lines, start[wide + 1])
    first = np.concatenate(([True], breaks))
    return start[first], end[np.append(first[1:], True)], row[first]


def winnow(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each full window its minimum's position, and a hash of the whole window."""
    return minima(h, window), run_hashes(h, window)


def minima(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest hash of each full window, the rightmost of equals."""
    at, size = np.arange(len(h)), 1
    if len(h) < window:
        return np.empty(0, np.int64)
    while size < window:
        s = min(size, window - size)
        left, right = at[:-s], at[s:]
        at = np.where(h[right] <= h[left], right, left)
        size += s
    return at


def cut_units(body: bytes, starts, window: int) -> bytes:
    """The text without the units of the repeated windows; a line break goes with the last unit of its line."""
    spans = units(body)
    gone = np.zeros(len(spans), bool)
    for s in starts:
        gone[s:s + window] = True
    if gone.all():
        return b""
    out, at = [], 0
    for (a, b), g in zip(spans, gone, strict=True):
        if g:
            out.append(body[at:a])
            while b < len(body) and body[b:b + 1] in (b" ", b"\t", b"\r", b"\n"):
                b += 1
                if body[b - 1:b] == b"\n":
                    break
            at = b
    out.append(body[at:])
    return b"".join(out)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes, by doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size = [h], 1
        while 2 * size <= n:
            power.append(mix64(power[-1][:-size] * np.uint64(3) + power[-1][size:]))
            size *= 2
        out, done = power[-1], size
        for b in range(len(power) - 2, -1, -1):
            if n & (1 << b):
                m = len(h) - done - (1 << b) + 1
                out = mix64(out[:m] * np.uint64(3) + power[b][done:done + m])
                done += 1 << b
    return out


def word_groups(h: np.ndarray, row: np.ndarray, run: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first window, windows) of each selected position; windows of ``run`` units lie within one row."""
    k = min(gram, run)
    g, n = run_hashes(h, k), len(h) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.flatnonzero(row[:n] == row[run - 1:])
    at = minima(g, run - k + 1)[inside]
    # The windows of one group follow one another.
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
    return g[at[first]], inside[first], np.diff(np.append(first, len(at)))


#: One group of windows: its fingerprint (the last bit set for units), a hash of all its windows, its text's hash, its
#: first window and the number of windows (negative: known to have occurred before).
ENTRY = np.dtype([("print", np.uint64), ("whole", np.uint64), ("hash", np.int64), ("start", np.int32), ("n", np.int32)])


def _kinds(data, offsets, window: int, run: int | None):
    """(last bit, unit hashes, their rows, window, words of a fingerprint) of units and words."""
    start, end, row = word_spans.spans(data, offsets, word_spans.SPACED)
    us, ue, urow = unit_spans(data, start, end, row)
    sums = word_spans.prefix_sums(data)
    yield 1, word_spans.hashes(data, us, ue, sums), urow, window, 1
    if run is not None:
        yield 0, word_spans.hashes(data, start, end, sums), row, run, GRAM


def _marked(h: np.ndarray, bit: int) -> np.ndarray:
    return (h & ~np.uint64(1)) | np.uint64(bit)


def judge(e: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of the entries that come first of those alike in fingerprint and windows, of the later ones, and of the first
    ones whose fingerprint has several kinds of windows.  ``rank`` orders the ids; entries of one place are one."""
    lead, later, mixed = np.ones(len(e), bool), np.zeros(len(e), bool), np.zeros(len(e), bool)
    order = np.argsort(e["print"])
    p = e["print"][order]
    same = p[1:] == p[:-1]
    at = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(e) else order
    if len(at):
        x, r = e[at], rank[at]
        order = np.lexsort((x["start"], x["hash"], r, x["whole"], x["print"]))
        at, x, r = at[order], x[order], r[order]
        new = np.concatenate(([True], x["print"][1:] != x["print"][:-1]))
        kind = new | np.concatenate(([True], x["whole"][1:] != x["whole"][:-1]))
        of = np.flatnonzero(kind)[np.cumsum(kind) - 1]
        lead[at] = kind
        later[at] = (r != r[of]) | (x["hash"] != x["hash"][of]) | (x["start"] != x["start"][of])
        group = np.cumsum(new) - 1
        mixed[at] = kind & (np.bincount(group, kind)[group] > 1)
    return lead, later, mixed


def _rank(ids: pa.Array) -> np.ndarray:
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(e: np.ndarray, ids: pa.Array, bits: int):
    """Entries by bucket of their fingerprint: the first of each kind, and the others marked as settled.

    What is settled here needs no meeting, so it goes by its text and copies of one passage do not meet in one bucket."""
    lead, later, _ = judge(e, _rank(ids))
    e["n"][later] *= -1
    keep = np.flatnonzero(lead | later)
    by = np.where(later, e["hash"].view(np.uint64), e["print"])[keep] >> np.uint64(64 - bits)
    order = np.argsort(by.astype(np.uint32), kind="stable")
    keep, by = keep[order], by[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    ends = np.append(first[1:], len(by))
    body = e[keep].tobytes()
    size = ENTRY.itemsize
    return pa.RecordBatch.from_arrays(
        [pa.array(by[first]), pa.array([body[x * size:y * size] for x, y in zip(first, ends, strict=True)], pa.binary()),
         pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), ids.take(pa.array(keep)))],
        names=["bucket", "entries", "ids"])


def _entries(window: int, run: int | None, bits: int):
    """Every group of windows around a selected fingerprint, by bucket."""
    def go(frames):
        for b in frames:
            for lo, hi, data, offsets in word_spans.groups(b, size=PACK):
                made, rows = [], []
                text_hash = b.column("text_hash").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                for bit, h, row, size, gram in _kinds(data, offsets, window, run):
                    prints, first, count = word_groups(h, row, size, gram)
                    if not len(prints):
                        continue
                    ends, of = np.cumsum(count), row[first]
                    within = np.arange(int(ends[-1])) - np.repeat(ends - count, count)
                    e = np.empty(len(prints), ENTRY)
                    e["print"], e["hash"], e["n"] = _marked(prints, bit), text_hash[of], count
                    e["start"] = first - np.searchsorted(row, np.arange(hi - lo))[of]
                    with np.errstate(over="ignore"):
                        windows = run_hashes(h, size)[np.repeat(first, count) + within]
                        e["whole"] = np.add.reduceat(mix64(windows + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ends - count)
                    made.append(e)
                    rows.append(of)
                if made:
                    yield _packed(np.concatenate(made), b.column("doc_id").take(pa.array(np.concatenate(rows) + lo)), bits)
    return go


def _windows(window: int, run: int | None, bits: int):
    """The windows of the groups that a text is asked for, one by one, by bucket."""
    def go(frames):
        for b in frames:
            asked = b.column("asked")
            for lo, hi, data, offsets in word_spans.groups(b, size=PACK):
                mine = asked.slice(lo, hi - lo)
                each = mine.flatten()
                code, print_ = (each.field(c).to_numpy(zero_copy_only=False) for c in ("code", "print"))
                of = np.repeat(np.arange(hi - lo), mine.value_lengths().to_numpy(zero_copy_only=False))
                text_hash = b.column("text_hash").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                made, rows = [], []
                for bit, h, row, size, _ in _kinds(data, offsets, window, run):
                    at = np.flatnonzero((code & 1) == bit)
                    if not len(at):
                        continue
                    first, count, base = code[at] >> 32, (code[at] & 0xFFFFFFFF) >> 1, np.searchsorted(row, np.arange(hi - lo))
                    ends = np.cumsum(count)
                    within = np.arange(int(ends[-1])) - np.repeat(ends - count, count)
                    text = np.repeat(of[at], count)
                    e = np.empty(len(text), ENTRY)
                    e["start"], e["n"], e["hash"] = np.repeat(first, count) + within, 1, text_hash[text]
                    e["print"] = _marked(run_hashes(h, size)[e["start"] + base[text]], bit)
                    e["whole"] = np.repeat(print_[at].view(np.uint64), count)
                    made.append(e)
                    rows.append(text)
                if made:
                    yield _packed(np.concatenate(made), b.column("doc_id").take(pa.array(np.concatenate(rows) + lo)), bits)
    return go


def _judged(frames):
    """Per bucket, the groups that occurred before, and the first ones of fingerprints with several kinds of windows."""
    def done(entries, ids):
        e, ids = np.frombuffer(b"".join(entries), ENTRY), pa.concat_arrays(ids)
        open_ = np.flatnonzero(e["n"] > 0)
        _, later, mixed = judge(e[open_], _rank(ids.take(pa.array(open_))))
        gone, asked = np.concatenate((np.flatnonzero(e["n"] < 0), open_[later])), open_[mixed]
        at = np.concatenate((gone, asked))
        x = e[at]
        code = (x["start"].astype(np.int64) << 32) | (np.abs(x["n"]).astype(np.int64) << 1) | (x["print"] & np.uint64(1)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array(x["hash"]), pa.array(code), pa.array(x["print"].view(np.int64)), pa.array(np.arange(len(at)) >= len(gone))],
            names=["doc_id", "text_hash", "code", "print", "mixed"])

    now, entries, ids = None, [], []
    for b in frames:
        bucket, found = b.column("bucket").to_numpy(zero_copy_only=False), b.column("ids")
        body = b.column("entries").to_pylist()
        for i, k in enumerate(bucket):
            if k != now and entries:
                yield done(entries, ids)
                entries, ids = [], []
            now = k
            entries.append(body[i])
            ids.append(found[i].values)
    if entries:
        yield done(entries, ids)


def repeated_runs(docs: DataFrame, window: int = 3, run: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, codes): the stretches of windows of units and words that occurred before."""
    id_type = docs.schema[id_col].dataType.simpleString()
    body = F.col(text_col).cast("string").cast("binary")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    n = parallelism(docs.sparkSession)
    bits = max(2, (8 * n - 1).bit_length())
    packed = f"bucket long, entries binary, ids array<{id_type}>"
    out = f"doc_id {id_type}, text_hash long, code long, print long, mixed boolean"

    def judged(entries: DataFrame, name: str) -> DataFrame:
        return materialize(entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_judged, out), name)

    groups = judged(rows.mapInArrow(_entries(window, run, bits), packed), "line-groups")
    # Groups of one fingerprint that differ: their windows one by one, of each kind the first.
    asked = groups.where("mixed").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("code", "print")).alias("asked"))
    mine = asked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "asked")
    read = rows.join(mine, rows["doc_id"].eqNullSafe(mine["_id"]) & (rows["text_hash"] == mine["_hash"])).select("doc_id", "text_hash", "body", "asked")
    windows = judged(read.mapInArrow(_windows(window, run, bits), packed), "line-windows")
    gone = groups.where("not mixed").unionByName(windows.where("not mixed"))
    cuts = materialize(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("code").alias("codes")), "line-cuts")
    discard(groups)
    discard(windows)
    return cuts


def cut_runs(body: bytes, starts, window: int, stretches) -> tuple[bytes, int]:
    """The text without the repeated units and words, and the number of units that lose any word."""
    spans = units(body)
    whole = np.zeros(len(spans), bool)
    if len(starts):
        for i in range(window):
            whole[np.asarray(starts) + i] = True
    gone = [spans[i] for i in np.flatnonzero(whole)]
    if len(stretches):
        data = np.frombuffer(body, np.uint8)
        first, last, _ = word_spans.spans(data, np.array([0, len(data)]), word_spans.SPACED)
        mark = np.zeros(len(first) + 1, np.int64)
        first_word, size = np.asarray(stretches).T
        np.add.at(mark, first_word, 1)
        np.add.at(mark, first_word + size, -1)
        inside = np.cumsum(mark) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        gone = sorted(gone + [(int(first[x]), int(last[y - 1])) for x, y in zip(edge[::2], edge[1::2], strict=True)])
    out, at = [], 0
    for a, b in gone:
        out.append(body[at:max(a, at)])
        while b < len(body) and body[b:b + 1] in (b" ", b"\t", b"\r", b"\n"):
            b += 1
            if body[b - 1:b] == b"\n":
                break
        at = max(at, b)
    left = b"".join([*out, body[at:]])
    touched = 0
    if gone and spans:
        cut, unit = np.array(gone), np.array(spans)
        # The first cut that reaches beyond the unit's begin, if it begins before the unit's end.
        at = np.searchsorted(np.maximum.accumulate(cut[:, 1]), unit[:, 0], "right")
        touched = int(((at < len(cut)) & (cut[np.minimum(at, len(cut) - 1), 0] < unit[:, 1])).sum())
    return (left if left.strip() else b""), touched


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs deleted from the text, plus ``n_units_cut`` int.

    ``words`` also deletes later copies of every run of that many words or more.
    """
    cuts = repeated_runs(docs, window, words, id_col, text_col)
    # The caller's columns may have any names.
    name = {n: free_name(docs, f"_cut_{n}") for n in ("id", "hash", "codes", "new")}
    cuts = cuts.select(F.col("doc_id").alias(name["id"]), F.col("text_hash").alias(name["hash"]), F.col("codes").alias(name["codes"]))
    hashed = F.xxhash64(docs[text_col].cast("string").cast("binary"))
    joined = docs.join(cuts, docs[id_col].eqNullSafe(cuts[name["id"]]) & (hashed == cuts[name["hash"]]), "left")

    @F.pandas_udf("text string, cut int")
    def apply(text: pd.Series, codes: pd.Series) -> pd.DataFrame:
        got = []
        for t, c in zip(text, codes, strict=True):
            if t is None:
                got.append((None, 0))
                continue
            start, n, unit = c >> 32, (c & 0xFFFFFFFF) >> 1, (c & 1) == 1
            starts = np.repeat(start[unit], n[unit]) + np.arange(n[unit].sum()) - np.repeat(np.cumsum(n[unit]) - n[unit], n[unit])
            left, cut = cut_runs(t.encode(), starts, window, np.stack([start[~unit], n[~unit] + ((words or 1) - 1)], axis=1))
            got.append((left.decode(), cut))
        return pd.DataFrame(got, columns=["text", "cut"])

    changed = F.col(name["hash"]).isNotNull()
    # Only the texts that change travel to Python.
    done = joined.withColumn(name["new"], apply(F.when(changed, F.col(text_col).cast("string")), F.col(name["codes"])))
    return done.select(*[F.when(changed, F.col(name["new"])["text"]).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)
                         for c in docs.columns], F.col(name["new"])["cut"].alias("n_units_cut"))

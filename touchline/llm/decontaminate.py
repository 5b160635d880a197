"""Operator 7: benchmark decontamination with a BM25 index of the test items.

The items are indexed once: per word the items that hold it with their BM25
impact, divided by the item's score against itself (so 1 is a whole match),
and for blocks of neighbouring items each word's largest impact in the block.
Every passage of every document is a query; passages are windows of
``2 * stride`` words, ``stride`` as long as the longest item's window (below), so
some passage holds any copied item whole.  Retrieval is block-max WAND for a fixed
threshold, for many passages at once: words whose largest impacts together
stay below half the threshold open no item; the other words' block maxima
bound each block; only blocks whose bound reaches the threshold are scored.

Each retrieved pair is then verified in windows of the item's own length:
twice its words, at least ``least_window``, begun at every word of the passage.
In one of them must stand at least ``overlap`` of the five-word shingles of the
item's question, and of its answer, and its words must score the threshold.
Passages overlap by a ``stride`` that is as long as the longest window, so each
window lies in a passage and an item decides nothing about another.  An item's answer is what follows its last question mark or, without one, its last
sentence; a one-sentence item's answer is its last quarter of words.  A part
of fewer than five words counts as one shingle.

The items are searched in slices of bounded size; only a slice is broadcast.

Texts and items are compared without regard to case in any script: both are
composed (NFC) and case-folded by Unicode before they are split into words.

Defined results: null or empty texts hold no item; items of fewer than
``SHINGLE`` words never match; an item listed twice is reported once per id;
rows that repeat an id are reported once; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize, text_hash, texts

SHINGLE = 5
#: Items, and bytes of their texts, that one slice of the index may hold.
SLICE_ITEMS, SLICE_BYTES = 20_000, 32 << 20
ITEM_BLOCK = 8
K1, B = 1.2, 0.75
#: Cells of the passage-by-block table that bounds one round of retrieval.
CELLS = 2 << 20


def folded_text(body: bytes) -> bytes:
    """The text composed and case-folded by Unicode; bytes that are not UTF-8 stay as they are."""
    if body.isascii():
        return body.lower()
    s = unicodedata.normalize("NFC", body.decode("utf-8", "surrogateescape")).casefold()
    return unicodedata.normalize("NFC", s).encode("utf-8", "surrogateescape")


def _folded_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of consecutive rows, case-folded; only rows beyond ASCII are decoded."""
    if not len(data) or int(data.max()) < 128:
        return words.folded(data), offsets
    whole = data.tobytes()
    rows = [folded_text(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def item_words(text: bytes) -> np.ndarray:
    data = np.frombuffer(folded_text(text), np.uint8)
    start, end, _ = words.spans(data, np.array([0, len(data)]), words.ALNUM)
    return words.hashes(data, start, end)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item's text."""
    if (at := text.rfind("?")) >= 0 and re.search(r"\w", text[at:]):
        return text[:at + 1], text[at + 1:]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=.*\w)", text, re.DOTALL)]
    if ends and re.search(r"\w", text[:ends[-1]]):
        return text[:ends[-1]], text[ends[-1]:]
    found = list(re.finditer(r"\S+", text))
    at = found[max(1, len(found) - max(1, len(found) // 4))].start() if len(found) > 1 else len(text)
    return text[:at], text[at:]


class BlockMaxIndex:
    """Impacts of one slice of the items, by word and, as maxima, by word and block of items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_words: float):
        self.item_id, self.question, self.answer, self.length, self.impact = [], [], [], [], []
        rows = []
        for item_id, text in items:
            h = item_words(text.encode())
            if len(h) < SHINGLE:
                continue
            terms, tf = np.unique(h, return_counts=True)
            seen = np.array([df[int(t.view(np.int64))] for t in terms], float)
            idf = np.log1p((n_items - seen + 0.5) / (seen + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_words))
            rows.append((terms, w / w.sum()))
            self.item_id.append(item_id)
            self.length.append(len(h))
            self.impact.append(rows[-1])
            q, a = (item_words(x.encode()) for x in split_item(text))
            self.question.append((min(SHINGLE, len(q)), np.unique(words.ngrams(q, min(SHINGLE, len(q)) or 1))))
            self.answer.append((min(SHINGLE, len(a)), np.unique(words.ngrams(a, min(SHINGLE, len(a)) or 1))))
        term = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        impact = np.concatenate([r[1] for r in rows]) if rows else np.empty(0)
        known, inverse = np.unique(term, return_inverse=True)
        most = np.zeros(len(known))
        np.maximum.at(most, inverse, impact)
        # Words are numbered by their largest impact, so a passage's sorted words begin with the weakest.
        by_most = np.argsort(most, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[by_most] = np.arange(len(known))
        self.words, self.rank, self.most = known, rank, most[by_most]
        order = np.lexsort((item, rank[inverse]))
        self.post_item, self.post_impact = item[order], impact[order]
        self.post_at = np.searchsorted(rank[inverse][order], np.arange(len(known) + 1))
        self.blocks = -(-len(rows) // ITEM_BLOCK)
        key = rank[inverse][order] * max(1, self.blocks) + self.post_item // ITEM_BLOCK
        cells, first = np.unique(key, return_index=True)
        self.max_block = cells % max(1, self.blocks)
        self.max_impact = np.maximum.reduceat(self.post_impact, first) if len(first) else np.empty(0)
        self.max_at = np.searchsorted(cells // max(1, self.blocks), np.arange(len(known) + 1))

    @staticmethod
    def _expand(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``of`` each list entry belongs to, and the entry's position in the lists."""
        n = at[of + 1] - at[of]
        owner = np.repeat(np.arange(len(of)), n)
        return owner, np.arange(int(n.sum())) + np.repeat(at[of] - (np.cumsum(n) - n), n)

    def search(self, passage: np.ndarray, hashed: np.ndarray, n_passages: int, threshold: float):
        """(passage, item, score) of every pair at or above the threshold."""
        if not len(self.words) or not len(hashed):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        at = np.searchsorted(self.words, hashed)
        at[at == len(self.words)] = 0
        hit = self.words[at] == hashed
        v = len(self.words)
        key = np.unique(passage[hit] * v + self.rank[at[hit]])
        out = []
        chunk = max(1, CELLS // max(self.blocks, len(self.item_id)))
        for lo in range(0, n_passages, chunk):
            part = key[np.searchsorted(key, lo * v):np.searchsorted(key, (lo + chunk) * v)]
            if len(part):
                out.append(self._search(part // v - lo, part % v, min(chunk, n_passages - lo), lo, threshold))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _search(self, p, t, n, lo, threshold):
        limit = threshold - 1e-9
        most = self.most[t]
        total = np.bincount(p, most, n)
        run = np.cumsum(most)
        first = np.searchsorted(p, np.arange(n))
        before = np.concatenate(([0.0], run))[first]
        weak = run - before[p] <= threshold / 2
        alive = (total >= limit)[p]
        strong = ~weak & alive
        slack = np.bincount(p[weak], most[weak], n)
        owner, entry = self._expand(self.max_at, t[strong])
        bound = np.bincount(p[strong][owner] * self.blocks + self.max_block[entry], self.max_impact[entry], n * self.blocks)
        ok = bound.reshape(n, self.blocks) + slack[:, None] >= limit
        ok &= (total >= limit)[:, None] & (bound.reshape(n, self.blocks) > 0)
        scored = ok.any(axis=1)
        number = np.cumsum(scored) - 1
        use = scored[p]
        owner, entry = self._expand(self.post_at, t[use])
        rows = p[use][owner]
        inside = ok[rows, self.post_item[entry] // ITEM_BLOCK]
        rows, entry = rows[inside], entry[inside]
        items = len(self.item_id)
        score = np.bincount(number[rows] * items + self.post_item[entry], self.post_impact[entry], int(scored.sum()) * items)
        found = np.flatnonzero(score >= limit)
        return np.flatnonzero(scored)[found // items] + lo, found % items, score[found]

    def verify(self, item: int, h: np.ndarray, threshold: float, overlap: float, least_window: int) -> tuple[float, float, float] | None:
        """(score, question overlap, answer overlap) of the best window of the passage's words ``h``, or None."""
        parts = (self.question[item], self.answer[item])
        grams = [words.ngrams(h, n) if n else h[:0] for n, _ in parts]
        if any(n and np.isin(want, g).mean() < overlap for (n, want), g in zip(parts, grams, strict=True)):
            return None
        width = window_words(self.length[item], least_window)
        q, a = (_window_shares(g, want, np.full(len(want), 1 / len(want)), len(h), width - n + 1) if n else np.ones(len(h))
                for (n, want), g in zip(parts, grams, strict=True))
        score = _window_shares(h, *self.impact[item], len(h), width)
        good = (q >= overlap - 1e-9) & (a >= overlap - 1e-9) & (score >= threshold - 1e-9)
        if not good.any():
            return None
        best = int(np.argmax(np.where(good, score, -1.0)))
        return tuple(round(float(x[best]), 9) for x in (score, q, a))


def window_words(length: int, least: int) -> int:
    """Words of the window in which an item of ``length`` words must stand."""
    return max(least, 2 * length)


def _window_shares(have: np.ndarray, want: np.ndarray, weight: np.ndarray, starts: int, span: int) -> np.ndarray:
    """For each start the weight of the distinct ``want`` (sorted) among the ``span`` entries of ``have`` from there."""
    at = np.searchsorted(want, have)
    at[at == len(want)] = 0
    place = np.flatnonzero(want[at] == have)
    which = at[place]
    # An entry counts for the starts after its previous equal entry, so none counts twice.
    order = np.lexsort((place, which))
    before = np.full(len(place), -1)
    same = which[order][1:] == which[order][:-1]
    before[order[1:][same]] = place[order][:-1][same]
    low = np.maximum(before + 1, np.maximum(place - span + 1, 0))
    change = np.zeros(starts + 1)
    np.add.at(change, low, weight[which])
    np.add.at(change, place + 1, -weight[which])
    return np.cumsum(change[:-1])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, least_window: int = 128,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_passages, score, question_overlap, answer_overlap: every verified leak."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()

    def terms(frames):
        for b in frames:
            rows = [item_words(x) for x in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(h) for h in rows], pa.int64()),
                                              pa.array([np.unique(h).view(np.int64) for h in rows], pa.list_(pa.int64()))],
                                             names=["item_id", "n", "terms"])

    indexed = materialize(texts(items, "item_id").mapInArrow(terms, "item_id long, n long, terms array<long>"), "benchmark-terms")
    n_items, total, longest = indexed.where(f"n >= {SHINGLE}").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    result = f"doc_id {id_type}, item_id long, score double, question_overlap double, answer_overlap double"
    if not n_items:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id long, n_passages long, score double, question_overlap double, answer_overlap double")
    df = indexed.where(f"n >= {SHINGLE}").select(F.explode("terms").alias("term")).groupBy("term").count()
    slices = max(-(-n_items // SLICE_ITEMS), -(-size // SLICE_BYTES))
    stride = window_words(longest, least_window)
    found = None
    for s in range(slices):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s
        rows = items.where(mine).orderBy("item_id", "text").collect()  # one slice: bounded
        mine_df = df.join(indexed.where(mine).select(F.explode("terms").alias("term")).distinct(), "term").collect()
        index = BlockMaxIndex([(r.item_id, r.text) for r in rows], {r["term"]: r["count"] for r in mine_df}, n_items, total / n_items)
        part = texts(docs, id_col, text_col).mapInArrow(_leaks(spark.sparkContext.broadcast(index), stride, threshold, overlap, least_window), result)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_passages"), F.round(F.max("score"), 9).alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"))


def _leaks(shared, stride: int, threshold: float, overlap: float, least_window: int):
    def run(frames):
        index = shared.value
        for batch in frames:
            out = []
            for a, _, data, offsets in words.groups(batch):
                data, offsets = _folded_rows(data, offsets)
                start, end, row = words.spans(data, offsets, words.ALNUM)
                if not len(start):
                    continue
                h = words.hashes(data, start, end)
                # Word positions within the row, the passages of each row, and each word's two passages.
                first = np.searchsorted(row, np.arange(len(offsets)))
                count = np.diff(first)
                made = np.maximum(1, -(-count // stride) - 1) * (count > 0)
                base = np.concatenate(([0], np.cumsum(made)))
                j = (np.arange(len(h)) - first[row]) // stride
                here, prior = j < made[row], j > 0
                passage = np.concatenate((base[row[here]] + j[here], base[row[prior]] + j[prior] - 1))
                hit = index.search(passage, np.concatenate((h[here], h[prior])), int(base[-1]), threshold)
                for p, item, _ in zip(*hit, strict=True):
                    r = int(np.searchsorted(base, p, "right")) - 1
                    lo = first[r] + (p - base[r]) * stride
                    leak = index.verify(int(item), h[lo:min(lo + 2 * stride, first[r + 1])], threshold, overlap, least_window)
                    if leak:
                        out.append((a + r, index.item_id[item], *leak))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item; any column names may stand beside id and text."""
    rows = docs.select(F.struct(docs[id_col].alias("id"), text_hash(text_col).alias("text_hash")).alias("row"), docs[text_col].alias("text"))
    bad = find_leaks(rows, benchmark, id_col="row", **kw).select("doc_id").distinct().select(
        F.col("doc_id.id").alias("leak_id"), F.col("doc_id.text_hash").alias("leak_hash"))
    hashed = text_hash(docs[text_col])
    return docs.join(bad, docs[id_col].eqNullSafe(bad["leak_id"]) & (hashed == bad["leak_hash"]), "left_anti")

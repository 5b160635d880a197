"""Operator 10: hashed maximum-entropy language model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class)``.  The class is a
softmax over hashed features of the history: the word before, the pair before,
and two skip features (the second and the third word before).  Classes are the
end of a text, the most frequent words (one class each) and, for all other
words, a hash of their last two bytes; so a class follows from the word alone.
Inside a class the words' probabilities are the softmax of one bias each, which
is add-half smoothing of their counts; each such class keeps half a count for
words never seen.

Steps, each one Spark job over the table:

1. word counts of the training texts, as sorted arrays of 64-bit word hashes
   by bucket (the leading bits of the hash);
2. rounds of distributed gradient updates: in a round each task goes through
   its share of the training texts in mini-batches (AdaGrad), and the tasks'
   changes are averaged row by row, each weighted by how many words it saw;
   the rounds take disjoint hash shares of the texts, so each text is seen once;
3. scoring in sparse numpy batches.  The weights (of fixed size) and a fixed
   number of frequent words' counts are broadcast; the counts of other words
   are fetched by bucket, as arrays, from the table of step 1.

Defined results: null or empty text is the end token alone; rows that repeat an
id are scored each; a null id hashes as the empty text for its fold; without
training texts every count is zero; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import crc_fold, materialize, mix64, parallelism, texts

#: Classes: 0 the end, then frequent words, then hashes of endings.
FREQUENT, ENDINGS = 31, 32
CLASSES = 1 + FREQUENT + ENDINGS
#: Feature templates and hashed rows of each; rows travel in blocks.
TEMPLATES, ROWS, ROW_BLOCK = 4, 8192, 512
#: Frequent words whose counts are broadcast.
CACHED = 262_144
ROUNDS, BATCH, RATE = 2, 8192, 0.25
#: Rows whose class scores are computed together: few enough to stay in a core's cache.
SLICE = 1024
#: Distinct words gathered by a task before it hands its counts on.
GATHERED = 2_000_000
_START = np.uint64(0x5851F42D4C957F2D)
_END = (mix64(np.array([77], np.uint64)) & ~np.uint64(31))[0]
_SALT = mix64(np.arange(1, TEMPLATES + 1, dtype=np.uint64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word and of one end for each row; the low five bits hash a word's last two bytes."""
    data = words.folded(data)
    start, end, row = words.spans(data, offsets, words.SPACED)
    h = words.hashes(data, start, end) & ~np.uint64(31)
    last = data[end - 1].astype(np.uint64) * np.uint64(256) + np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    h |= mix64(last + np.uint64(1)) & np.uint64(31)
    n = len(offsets) - 1
    at = np.searchsorted(row, np.arange(1, n + 1))
    return np.insert(h, at, _END), np.insert(row, at, np.arange(n))


def features(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(templates, tokens) hashed feature rows."""
    before = []
    for k in (1, 2, 3):
        x = np.full(len(h), _START)
        if len(h) > k:
            same = row[k:] == row[:-k]
            x[k:][same] = h[:-k][same]
        before.append(x)
    with np.errstate(over="ignore"):
        keys = (before[0], before[1], before[2], before[0] * np.uint64(3) + mix64(before[1]))
    return np.stack([(mix64(k ^ s) % np.uint64(ROWS)).astype(np.int32) for k, s in zip(keys, _SALT, strict=True)])


def classes(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Class of each token; ``frequent`` holds the sorted hashes of the words with a class of their own."""
    out = (1 + FREQUENT + (h & np.uint64(31))).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        out = np.where(frequent[at] == h, 1 + at, out)
    out[h == _END] = 0
    return out


class Weights:
    """Bias by class and a row of class weights for each hashed feature."""

    def __init__(self, bias: np.ndarray, table: np.ndarray | None = None):
        self.bias = bias.astype(np.float32)
        self.table = np.zeros((TEMPLATES, ROWS, CLASSES), np.float32) if table is None else table

    def centred(self, f: np.ndarray) -> np.ndarray:
        """Class scores less each row's highest."""
        z = np.take(self.table[0], f[0], axis=0, mode="clip")
        more = np.empty_like(z)
        for t in range(1, TEMPLATES):
            z += np.take(self.table[t], f[t], axis=0, mode="clip", out=more)
        z += self.bias
        top, k = z, CLASSES
        while k % 2 == 0:
            k //= 2
            top = np.maximum(top[:, :k], top[:, k:])
        z -= top.max(axis=1, keepdims=True)
        return z

    def log_softmax(self, f: np.ndarray) -> np.ndarray:
        z = self.centred(f)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def log10_class(self, f: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(y))
        for a in range(0, len(y), SLICE):
            z = self.centred(f[:, a:a + SLICE])
            own = z[np.arange(len(z)), y[a:a + SLICE]]
            out[a:a + SLICE] = own - np.log(np.exp(z, out=z).sum(axis=1))
        return out / np.log(10)

    def learn(self, f: np.ndarray, y: np.ndarray, squares: np.ndarray, seen: np.ndarray) -> None:
        """One mini-batch gradient update; ``squares`` holds AdaGrad's sums by row."""
        g = np.empty((len(y), CLASSES), np.float32)
        for a in range(0, len(y), SLICE):
            np.exp(self.log_softmax(f[:, a:a + SLICE]), out=g[a:a + SLICE])
        g[np.arange(len(g)), y] -= 1
        for t in range(TEMPLATES):
            order = np.argsort(f[t].astype(np.uint16), kind="stable")
            key = f[t][order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            by_size = np.argsort(-size, kind="stable")
            first, size = first[by_size], size[by_size]
            row, total = key[first], _group_sums(g, order, first, size)
            squares[t, row] += np.einsum("ij,ij->i", total, total)
            seen[t, row] += size
            total *= (RATE / np.sqrt(squares[t, row] + 1.0))[:, None]
            self.table[t][row] = np.subtract(np.take(self.table[t], row, axis=0, mode="clip"), total, out=total)


def _group_sums(g: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray, few: int = 16) -> np.ndarray:
    """Sums of the rows ``g[order]`` over groups in falling order of size: large ones singly, small ones member by member."""
    out = np.take(g, order[first], axis=0, mode="clip")
    large = int(np.searchsorted(-size, -few))
    more = np.empty_like(out[large:])
    for at in range(1, few + 1):
        k = int(np.searchsorted(-size, -at))
        if k <= large:
            break
        out[large:k] += np.take(g, order[first[large:k] + at], axis=0, mode="clip", out=more[:k - large])
    for i in range(large):
        out[i] = np.take(g, order[first[i]:first[i] + size[i]], axis=0, mode="clip").sum(axis=0)
    return out


def _by_bucket(h: np.ndarray, bits: int):
    """(bucket, from, to) of the slices of a sorted hash array."""
    if not len(h):
        return []
    b = (h >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return [(int(b[x]), int(x), int(y)) for x, y in zip(first, np.append(first[1:], len(b)), strict=True)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first)


def word_counts(train: DataFrame, bits: int) -> DataFrame:
    """(bucket, hashes, counts): one row per bucket, hashes sorted."""

    def count(frames):
        held, size = [], 0

        def flush():
            h, n = _merged(held)
            rows = _by_bucket(h, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([h[a:b].tobytes() for _, a, b in rows], pa.binary()),
                 pa.array([n[a:b].tobytes() for _, a, b in rows], pa.binary())], names=["bucket", "hashes", "counts"])

        for batch in frames:
            for _, _, data, offsets in words.groups(batch):
                h, n = np.unique(tokens(data, offsets)[0], return_counts=True)
                held.append((h, n.astype(np.int64)))
                size += len(h)
                if size > GATHERED:
                    held[:] = [_merged(held)]
                    size = len(held[0][0])
                    if size > GATHERED:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def merge(frames):
        now, held = None, []

        def row():
            h, n = _merged(held)
            return {"bucket": now, "hashes": h.tobytes(), "counts": n.tobytes()}

        for f in frames:
            out = []
            for b, h, n in zip(f["bucket"], f["hashes"], f["counts"], strict=True):
                if b != now:
                    if held:
                        out.append(row())
                    now, held = b, []
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)))
                if sum(len(x[0]) for x in held[1:]) > 2 * max(len(held[0][0]), 10_000):
                    held = [_merged(held)]
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([row()])

    schema = "bucket long, hashes binary, counts binary"
    n = parallelism(train.sparkSession)
    return train.mapInArrow(count, schema).repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(merge, schema)


def _vocabulary(counts: DataFrame, buckets: int):
    """Totals, the cached frequent words and the class sums, all of fixed size."""
    share = -(-2 * CACHED // buckets)

    def strongest(frames):
        for f in frames:
            for hs, ns in zip(f["hashes"], f["counts"], strict=True):
                h, n = np.frombuffer(hs, np.uint64), np.frombuffer(ns, np.int64)
                keep = np.argsort(-n, kind="stable")[:share]
                end = 1 + FREQUENT + (h & np.uint64(31)).astype(np.int64)
                yield pd.DataFrame([{"words": len(h), "tokens": int(n.sum()), "hashes": h[keep].tobytes(), "counts": n[keep].tobytes(),
                                     "by_class": np.bincount(end, n, CLASSES).tobytes(), "types": np.bincount(end, minlength=CLASSES).tobytes()}])

    got = counts.mapInPandas(strongest, "words long, tokens long, hashes binary, counts binary, by_class binary, types binary").collect()
    h = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in got] or [np.empty(0, np.uint64)])
    n = np.concatenate([np.frombuffer(r.counts, np.int64) for r in got] or [np.empty(0, np.int64)])
    own = np.lexsort((h, -n))[:CACHED]
    h, n = h[own], n[own]
    top = [(int(x), int(c)) for x, c in zip(h, n, strict=True) if x != _END][:FREQUENT]
    frequent = np.sort(np.array([x for x, _ in top], np.uint64))
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in got:
        mass += np.frombuffer(r.by_class, np.float64)
        types += np.frombuffer(r.types, np.int64)
    ends = int(n[h == _END].sum())
    for x, c in [*top, (int(_END), ends)] if ends else top:  # these have classes of their own
        k = 1 + FREQUENT + (x & 31)
        mass[k] -= c
        types[k] -= 1
        own_class = 0 if x == int(_END) else 1 + int(np.searchsorted(frequent, np.uint64(x)))
        mass[own_class] += c
        types[own_class] += 1
    order = np.argsort(h)
    return {"N": sum(r["tokens"] for r in got), "V": sum(r["words"] for r in got), "hashes": h[order], "counts": n[order],
            "frequent": frequent, "mass": mass, "types": types}


def _train(train: DataFrame, vocab: dict, weights: Weights) -> Weights:
    """One round of distributed gradient updates over ``train``."""
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast((weights.bias, weights.table, vocab["frequent"]))

    def run(frames):
        bias, table, frequent = shared.value
        w = Weights(bias, table.copy())
        squares, seen = np.zeros((TEMPLATES, ROWS), np.float32), np.zeros((TEMPLATES, ROWS), np.int64)
        for batch in frames:
            for _, _, data, offsets in words.groups(batch):
                h, row = tokens(data, offsets)
                f, y = features(h, row), classes(h, frequent)
                for a in range(0, len(y), BATCH):
                    w.learn(f[:, a:a + BATCH], y[a:a + BATCH], squares, seen)
        moved = w.table - table
        out = []
        for t in range(TEMPLATES):
            for lo in range(0, ROWS, ROW_BLOCK):
                rows = np.flatnonzero(seen[t, lo:lo + ROW_BLOCK])
                if len(rows):
                    out.append((t * ROWS + lo, rows.astype(np.int32).tobytes(), seen[t, lo + rows].tobytes(),
                                moved[t, lo + rows].astype(np.float16).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["block", "rows", "seen", "moved"])

    def average(frames):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for f in frames:
            for block, rows, seen, moved in zip(f["block"], f["rows"], f["seen"], f["moved"], strict=True):
                change, n = total.setdefault(block, (np.zeros((ROW_BLOCK, CLASSES)), np.zeros(ROW_BLOCK)))
                rows, seen = np.frombuffer(rows, np.int32), np.frombuffer(seen, np.int64)
                change[rows] += np.frombuffer(moved, np.float16).reshape(-1, CLASSES).astype(float) * seen[:, None]
                n[rows] += seen
        for block, (change, n) in total.items():
            yield pd.DataFrame([{"block": block, "change": (change / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()}])

    changes = (train.mapInArrow(run, "block int, rows binary, seen binary, moved binary")
               .repartition(TEMPLATES * ROWS // ROW_BLOCK, "block").mapInPandas(average, "block int, change binary"))
    table = weights.table.copy()
    for r in changes.toLocalIterator():  # the model's own fixed size
        t, lo = divmod(r.block, ROWS)
        table[t, lo:lo + ROW_BLOCK] += np.frombuffer(r.change, np.float32).reshape(ROW_BLOCK, CLASSES)
    return Weights(weights.bias, table)


def _chunks(shared, id_type: str):
    """Chunks of scored texts: what is known locally, and the words whose counts must be fetched."""

    def run(frames):
        bias, table, vocab = shared.value
        w = Weights(bias, table)
        known, count = vocab["hashes"], vocab["counts"]
        made = TaskContext.get().partitionId() << 32
        for batch in frames:
            for a, b, data, offsets in words.groups(batch):
                h, row = tokens(data, offsets)
                y = classes(h, vocab["frequent"])
                n = b - a
                by_class = np.bincount(row, w.log10_class(features(h, row), y), n)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1)) if len(known) else np.zeros(len(h), np.int64)
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                base, inside, met = _sums(row[hit], y[hit], count[at[hit]] if len(known) else np.empty(0, np.int64), vocab, n)
                ask, which = np.unique(h[~hit], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made], pa.int64()), pa.array([batch.column("doc_id").slice(a, n)], pa.list_(batch.schema.field("doc_id").type)),
                     pa.array([batch.column("held_out").slice(a, n)], pa.list_(pa.bool_())),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (np.bincount(row, minlength=n).astype(np.int64), met, base, by_class + inside,
                                                                     row[~hit].astype(np.int32), which.astype(np.int32), ask)]],
                    names=["chunk", "ids", "held", "n_tokens", "n_known", "base", "score", "rows", "which", "ask"])
                made += 1
    return run


def _sums(row, y, c, vocab, n):
    """Base score, in-class score and known tokens by row, of tokens whose counts are ``c``."""
    base = np.log10((c + 0.5) / (vocab["N"] + 0.5 * (vocab["V"] + 1)))
    inside = np.where(y <= FREQUENT, 0.0, np.log10((c + 0.5) / (vocab["mass"][y] + 0.5 * (vocab["types"][y] + 1))))
    return np.bincount(row, base, n), np.bincount(row, inside, n), np.bincount(row, c > 0, n).astype(np.int64)


def score_texts(docs: DataFrame, folds: int = 5, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text",
                rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    n = parallelism(spark)
    bits = max(2, (4 * n - 1).bit_length())
    held = crc_fold(F.col("doc_id"), folds) == held_fold
    body = texts(docs, id_col, text_col)
    train = body.where(~held)
    counts = materialize(word_counts(train.select("body"), bits), "lm-counts")
    vocab = _vocabulary(counts, 1 << bits)
    prior = np.log((vocab["mass"] + 0.5) / (vocab["N"] + 0.5 * CLASSES))
    weights = Weights(prior)
    for r in range(rounds):
        share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(rounds)) == r
        weights = _train(train.where(share).select("body"), vocab, weights)
    shared = spark.sparkContext.broadcast((weights.bias, weights.table, vocab))
    chunks = materialize(body.withColumn("held_out", held).mapInArrow(
        _chunks(shared, id_type), f"chunk long, ids array<{id_type}>, held array<boolean>, n_tokens binary, n_known binary, base binary, "
        "score binary, rows binary, which binary, ask binary"), "lm-chunks")

    def requests(frames):
        for f in frames:
            for chunk, ask in zip(f["chunk"], f["ask"], strict=True):
                h = np.frombuffer(ask, np.uint64)
                rows = [(b, 1, chunk, h[x:y].tobytes(), b"") for b, x, y in _by_bucket(h, bits)]
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "kind", "chunk", "hashes", "counts"])

    def answers(frames):
        now, h, n = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for f in frames:
            out = []
            for b, kind, chunk, hs, ns in zip(f["bucket"], f["kind"], f["chunk"], f["hashes"], f["counts"], strict=True):
                if b != now:
                    now, h, n = b, np.empty(0, np.uint64), np.empty(0, np.int64)
                if kind == 0:
                    h, n = np.frombuffer(hs, np.uint64), np.frombuffer(ns, np.int64)
                    continue
                want = np.frombuffer(hs, np.uint64)
                got = np.zeros(len(want), np.int64)
                if len(h):
                    at = np.minimum(np.searchsorted(h, want), len(h) - 1)
                    got = np.where(h[at] == want, n[at], 0)
                out.append((chunk, b, got.tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["chunk", "bucket", "counts"])

    asked = chunks.select("chunk", "ask").mapInPandas(requests, "bucket long, kind int, chunk long, hashes binary, counts binary")
    told = counts.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "hashes", "counts")
    fetched = (asked.unionByName(told).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
               .mapInPandas(answers, "chunk long, bucket long, counts binary")
               .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("got")))

    def finish(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                size = len(r.ids)
                base, score = np.frombuffer(r.base), np.frombuffer(r.score)
                n_known = np.frombuffer(r.n_known, np.int64)
                if r.got is not None and len(r.got):
                    ask, which = np.frombuffer(r.ask, np.uint64), np.frombuffer(r.which, np.int32)
                    c = np.concatenate([np.frombuffer(x["counts"], np.int64) for x in r.got])[which]
                    more = _sums(np.frombuffer(r.rows, np.int32), classes(ask, vocab["frequent"])[which], c, vocab, size)
                    base, score, n_known = base + more[0], score + more[1], n_known + more[2]
                yield pd.DataFrame({"doc_id": r.ids, "held_out": r.held, "n_tokens": np.frombuffer(r.n_tokens, np.int64), "n_known": n_known,
                                    "train_tokens": np.int64(vocab["N"]), "base_score": base, "score": score})

    small = {k: vocab[k] for k in ("N", "V", "frequent", "mass", "types")}
    vocab = small
    return chunks.join(fetched, "chunk", "left").mapInPandas(
        finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Operator 13: personal data, by patterns and a linear-chain conditional random field over word shapes.

The base finds e-mail addresses, IP addresses, card and phone numbers by four
fixed patterns with their checks.  The field adds what they miss (numbers
written without a plus, a phone and a card side by side, a card with a wrong
check digit); a span it finds is added unless it meets a base span.

Tokens are runs of letters, runs of digits and single other characters.  A
token's shape is its class, its length class and whether white space precedes
it; no word is ever a feature.  Labels are outside, and begin and inside of each
kind.  Weights belong to the shapes at up to ``REACH`` places around a token, to
pairs of neighbouring shapes and to pairs of labels; they are fitted by gradient
steps on the exact likelihood of a small labelled table (forward-backward over
all its sentences at once).

Whole texts are decoded by Viterbi in numpy batches.  A token with no digit, @, +
or opening bracket within ``REACH`` places is outside by rule, in fitting as in
decoding.  A token whose margin for "outside" is above anything its neighbours'
labels could return is outside in the best path.  At both the path falls apart
exactly: only the stretches between them are decoded, many side by side.

Defined results: a null or empty text has no spans; a very long text is one
sequence like any other; rows that repeat an id are each handled for their own
text; a null id stays null; an empty table gives an empty result; further
columns are ignored.  Offsets are code points, ends exclusive.  An empty
labelled table is an error: there is nothing to learn from.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches

KINDS = ("email", "ip", "card", "phone")
#: Labelled rows the fit takes at most: the table is a small one, by hand or by rule.
MAX_LABELLED = 5000
#: Places on each side whose shapes a token's weights see.
REACH = 6
#: Code points decoded together; a longer text is handled alone.
GROUP = 1 << 20

# Base patterns ------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: it would have started before, or that run was tried already.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern ``local@domain.part`` from each @ outwards, so that long words cost no second look."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        at += 1
        if domain and start < at - 1:
            done = at = domain.end()
            yield start, done


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right doubled, sum divisible by ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *span) for span in _emails(text)]
    first = _DIGIT.search(text)
    if first is None:
        return out
    at = first.start()
    for m in _IP.finditer(text, at):
        if all(_octet(p) for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text, at):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Tokens and shapes --------------------------------------------------------------------------------------------------

LETTERS, DIGITS, OTHER, SPACE = range(4)
_CLASS = np.full(129, OTHER, np.int8)
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = LETTERS
_CLASS[[ord(c) for c in "0123456789"]] = DIGITS
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[128] = LETTERS  # all beyond ASCII

#: Length classes of digit runs end at these lengths; punctuation marks that have a shape of their own.
_DIGIT_LENGTHS, _MARKS = (1, 2, 3, 4, 7, 12, 19), "@.-+()_/:"
_OF_MARK = np.zeros(129, np.int64)
_OF_MARK[[ord(c) for c in _MARKS]] = np.arange(1, len(_MARKS) + 1)
_N_DIGIT, _N_MARK = len(_DIGIT_LENGTHS) + 1, len(_MARKS) + 1
#: Shape 0 is beyond a text's ends; every other comes without and with white space before it.
SHAPES = 1 + 2 * (2 + _N_DIGIT + _N_MARK)
LABELS = 1 + 2 * len(KINDS)
#: Triggers are digits, @, + and the opening bracket: far from them the only label is outside.
_TRIGGERS = {2 + d for d in range(_N_DIGIT)} | {2 + _N_DIGIT + 1 + _MARKS.index(c) for c in "@+("}
TRIGGER = np.array([s > 0 and (s - 1) // 2 in _TRIGGERS for s in range(SHAPES)])


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape) of every token."""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int64)
    if not len(points):
        none = np.empty(0, np.int64)
        return none, none, none
    kind = _CLASS[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == OTHER)
    at = np.flatnonzero(edge)
    start, end, of = at[:-1], at[1:], kind[at[:-1]]
    keep = of != SPACE
    apart = np.ones(len(start), np.int64)
    apart[1:] = ~keep[:-1]
    start, end, of, apart = start[keep], end[keep], of[keep], apart[keep]
    length = end - start
    form = np.where(of == LETTERS, (length > 1).astype(np.int64),
                    np.where(of == DIGITS, 2 + np.searchsorted(_DIGIT_LENGTHS, length), 2 + _N_DIGIT + _OF_MARK[points[start]]))
    return start, end, 1 + 2 * form + apart


# The field ----------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights: ``single`` (place, shape, label), ``pair`` (shape before, shape, label), ``step`` (label before, label)."""

    single: np.ndarray
    pair: np.ndarray
    step: np.ndarray

    def emissions(self, shapes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of all labels for the tokens ``at`` of a padded shape sequence."""
        out = self.pair[shapes[at - 1], shapes[at]]
        for place in range(-REACH, REACH + 1):
            out += self.single[place + REACH, shapes[at + place]]
        return out

    @functools.cached_property
    def gain(self) -> np.ndarray:
        """What a label other than outside can gain at most from its two neighbours' labels."""
        into = (self.step - self.step[:, :1]).max(axis=0)
        return into + (self.step - self.step[:1]).max(axis=1)

    def certain(self, scores: np.ndarray) -> np.ndarray:
        """Tokens that are outside in every best path."""
        return ((scores[:, 1:] + self.gain[1:] + 1e-6) < scores[:, :1]).all(axis=1)


def near_trigger(flat: np.ndarray) -> np.ndarray:
    """Tokens with a trigger at most ``REACH`` places away; all others are outside by rule."""
    n = np.concatenate(([0], np.cumsum(TRIGGER[flat])))
    i = np.arange(len(flat))
    return (flat != 0) & (n[np.minimum(i + REACH + 1, len(flat))] > n[np.maximum(i - REACH, 0)])


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shape sequences one after another, ``REACH`` edge shapes around each, and where each begins."""
    gap = np.zeros(REACH, np.int64)
    flat = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
    lengths = np.array([len(p) for p in parts], np.int64)
    return flat, REACH + np.cumsum(lengths + REACH) - lengths - REACH


def decode(field: Field, flat: np.ndarray) -> np.ndarray:
    """The best labels of every token of a padded sequence; edge shapes are outside."""
    labels = np.zeros(len(flat), np.int8)
    at = np.flatnonzero(near_trigger(flat))
    if not len(at):
        return labels
    scores = field.emissions(flat, at)
    open_ = ~field.certain(scores)
    at, scores = at[open_], scores[open_]
    if not len(at):
        return labels
    # Stretches of neighbouring open tokens, longest first, all decoded side by side.
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    length = np.diff(np.concatenate((first, [len(at)])))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    best = scores[first] + field.step[0]
    back = np.zeros((len(at), LABELS), np.int8)
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t, "left"))  # stretches longer than t
        paths = best[:n, :, None] + field.step
        back[first[:n] + t] = paths.argmax(axis=1)
        best[:n] = paths.max(axis=1) + scores[first[:n] + t]
    last = (best + field.step[:, 0]).argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t, "left"))
        here = first[:n] + t
        labels[at[here]] = last[:n]
        last[:n] = back[here, last[:n]]
    return labels


def spans_of(labels: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of labelled tokens; an inside without its begin begins a span."""
    out: list[tuple[str, int, int]] = []
    previous = -2
    for t in np.flatnonzero(labels).tolist():
        kind, begins = KINDS[(labels[t] - 1) // 2], labels[t] % 2 == 1
        if not begins and previous == t - 1 and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], int(end[t]))
        else:
            out.append((kind, int(start[t]), int(end[t])))
        previous = t
    return out


_RANGE = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
_NUMBER = re.compile(r"[0-9 ().+\s-]+")


def plausible(kind: str, text: str) -> bool:
    """The exact check of a span the field proposes: an @, or digits of the kind's number with no letter, of an address four parts up to 255."""
    if kind == "email":
        return "@" in text
    if not _NUMBER.fullmatch(text):
        return False
    low, high = _RANGE[kind]
    parts = re.findall("[0-9]+", text)
    return low <= sum(map(len, parts)) <= high and (kind != "ip" or (len(parts) == 4 and all(map(_octet, parts))))


def _marginals(field: Field, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token marginals, summed pair marginals) of sentences side by side, longest first, by scaled forward-backward."""
    n, longest, _ = scores.shape
    unit = lambda x: x / x.sum(axis=-1, keepdims=True)
    e, step = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(field.step - field.step.max())
    on = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # sentences longer than t
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = unit(e[:, 0] * step[0])
    for t in range(1, longest):
        ahead[:on[t], t] = unit(e[:on[t], t] * (ahead[:on[t], t - 1] @ step))
    back[np.arange(n), lengths - 1] = step[:, 0]
    pairs = np.zeros_like(step)
    for t in range(longest - 1, 0, -1):
        after = e[:on[t], t] * back[:on[t], t]
        before = ahead[:on[t], t - 1]
        pairs += step * (before.T @ (after / ((before @ step) * after).sum(axis=1, keepdims=True)))
        back[:on[t], t - 1] = unit(after @ step.T)
    token = ahead * back
    token /= np.maximum(token.sum(axis=2, keepdims=True), 1e-300)
    pairs[0] += token[:, 0].sum(axis=0)
    pairs[:, 0] += token[np.arange(n), lengths - 1].sum(axis=0)
    return token, pairs


class _Sums:
    """Sums of rows by an index, for many sets of rows under one index."""

    def __init__(self, index: np.ndarray) -> None:
        self.order = np.argsort(index, kind="stable")
        self.ids, self.first = np.unique(index[self.order], return_index=True)

    def add(self, into: np.ndarray, rows: np.ndarray) -> None:
        into[self.ids] += np.add.reduceat(rows[self.order], self.first)


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """The field of greatest penalised likelihood, by Adam steps over the whole table."""
    made = [(tokens(text), spans) for text, spans in rows]
    made = sorted((m for m in made if len(m[0][0])), key=lambda m: -len(m[0][0]))
    if not made:
        raise ValueError("the labelled table holds no text to learn from")
    gold = []
    for (start, end, _), spans in made:
        y = np.zeros(len(start), np.int64)
        for kind, a, b in spans:
            inside = np.flatnonzero((start >= a) & (end <= b))
            y[inside] = 2 + 2 * KINDS.index(kind)
            y[inside[:1]] -= 1
        gold.append(y)
    flat, begins = _padded([m[0][2] for m in made])
    lengths = np.array([len(y) for y in gold])
    place = np.minimum(np.arange(lengths.max()), (lengths - 1)[:, None])
    at, real = begins[:, None] + place, np.arange(lengths.max()) < lengths[:, None]
    far = ~near_trigger(flat)[at]
    gold = [np.where(f[:len(y)], 0, y) for f, y in zip(far, gold, strict=True)]
    rule = np.where(far[..., None] & (np.arange(LABELS) > 0), -1e4, 0.0)
    truth = np.zeros(at.shape, np.int64)
    truth[real] = np.concatenate(gold)
    want = np.eye(LABELS)[truth] * real[..., None]
    want_step = np.zeros((LABELS, LABELS))
    for y in gold:
        np.add.at(want_step, (np.concatenate(([0], y)), np.concatenate((y, [0]))), 1)

    field = Field(np.zeros((2 * REACH + 1, SHAPES, LABELS)), np.zeros((SHAPES, SHAPES, LABELS)), np.zeros((LABELS, LABELS)))
    weights = [field.single, field.pair, field.step]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    spots = at[real]
    by_shape = [_Sums(flat[spots + p]) for p in range(-REACH, REACH + 1)]
    by_pair = _Sums(flat[spots - 1] * SHAPES + flat[spots])
    for n in range(1, steps + 1):
        token, pairs = _marginals(field, field.emissions(flat, at) + rule, lengths)
        miss = (want - token * real[..., None])[real]
        grads = [np.zeros_like(w) for w in weights]
        for into, sums in zip(grads[0], by_shape, strict=True):
            sums.add(into, miss)
        by_pair.add(grads[1].reshape(-1, LABELS), miss)
        grads[2] += want_step - pairs
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g / len(made) - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return Field(*weights)


# The labelled table -------------------------------------------------------------------------------------------------


def _example(rnd: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """One sentence of invented words with items in written forms that vary, and numbers that are no personal data."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice(("ta", "re", "mi", "so", "lu", "ké", "don", "x", "sch", "a")) for _ in range(rnd.randint(1, 4)))
    octet = lambda: str(rnd.randint(0, 255))
    code = lambda n, of: "".join(rnd.choice(of) for _ in range(n))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return rnd.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+1-{a}-{b}-{c}",
                           f"1 ({a}) {b}-{c}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"{a}.{b}.{c}", f"({a}){b}-{c}"))

    def card() -> str:
        a = d(16)
        return rnd.choice((a, a, a, " ".join(a[i:i + 4] for i in (0, 4, 8, 12)), "-".join(a[i:i + 4] for i in (0, 4, 8, 12)), d(15)))

    def email() -> str:
        host = rnd.choice(("mail", "post")) + rnd.choice(("", d(1))) + "." + rnd.choice(("example.com", "example.org", "net"))
        return word() + rnd.choice((".", "_", "")) + rnd.choice((d(2), word(), "")) + "@" + host

    def ip() -> str:
        return ".".join(octet() for _ in range(4))

    def clean() -> str:
        return rnd.choice((f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(1)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(1)},{d(3)}.{d(2)}", d(rnd.randint(1, 6)),
                           f"({d(4)})", f"{d(2)}%", f"{d(3)}/{d(3)}", f"@{word()}", f"{d(1)}.", f"{word()}={d(1)}{word()}{d(4)}{word()}{d(2)}", f"+{d(1)}", f"§ {d(2)}",
                           f"{word()}={code(24, '0123456789abcdef')}", f'"{code(40, "0123456789abcdef")}"', code(20, "0123456789ABCDEFGHIJKLMNOP"),
                           f"({word()})", f"{word()}-{word()}", f"A{d(3)}B{d(5)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(7)}", f"http://{word()}.{word()}/{d(4)}"))

    text, spans = "", []
    for _ in range(rnd.randint(1, 6)):
        words = [w.capitalize() if rnd.random() < 0.2 else w for w in (word() for _ in range(rnd.choice((0, 0, 0, 1, 2, 5))))]
        for w in words:
            text += w + rnd.choice((" ", " ", " ", " ", ", ", ". ", "\n"))
        make = rnd.choice((("email", email), ("ip", ip), ("card", card), ("phone", phone), (None, clean), (None, clean)))
        item = make[1]()
        if make[0]:
            spans.append((make[0], len(text), len(text) + len(item)))
        text += item + rnd.choice((" ", " ", " ", ", ", ". ", "\n"))
    return text + " ".join(word() for _ in range(rnd.randint(0, 5))), spans


def examples(n: int = 600, seed: int = 13) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rnd = random.Random(seed)
    return [_example(rnd) for _ in range(n)]


def labelled_examples(spark: SparkSession, n: int = 600, seed: int = 13) -> DataFrame:
    """A small labelled table made by rule: (text, spans array<struct<kind, start, end>>)."""
    return spark.createDataFrame(examples(n, seed), "text string, spans array<struct<kind:string,start:int,end:int>>")


# The operator -------------------------------------------------------------------------------------------------------

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def added_spans(field: Field, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """For each text the field's spans that pass their check and meet no base span."""
    cut = [tokens(t) for t in texts]
    flat, begins = _padded([c[2] for c in cut])
    labels = decode(field, flat)
    out = []
    for text, known, (start, end, _), a in zip(texts, base, cut, begins.tolist(), strict=True):
        mine = labels[a:a + len(start)]
        found = spans_of(mine, start, end) if mine.any() else []
        taken = sorted((s, e) for _, s, e in known)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else []

        def free(s, e, starts=starts, reach=reach):
            before = int(np.searchsorted(starts, e))  # base spans that begin before this one ends
            return not before or reach[before - 1] <= s

        out.append([(k, s, e) for k, s, e in found if free(s, e) and plausible(k, text[s:e])])
    return out


def _map(field: Field, id_type: pa.DataType, size: int):
    order = {k: i for i, k in enumerate(KINDS)}

    def batch(ids, texts):
        base = [base_spans(t) for t in texts]
        more = added_spans(field, texts, base)
        every = [sorted(b + m, key=lambda s: (order[s[0]], s[1])) for b, m in zip(base, more, strict=True)]
        listed = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x], pa.list_(_SPAN)) for x in (base, every)]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *listed], ["doc_id", "base", "spans"])

    def run(frames):
        ids, held, n = [], [], 0
        for some, bodies in batches(frames, "doc_id", "text"):
            for doc, text in zip(some, bodies, strict=True):
                if held and n + len(text) > size:
                    yield batch(ids, held)
                    ids, held, n = [], [], 0
                ids.append(doc)
                held.append(text)
                n += len(text)
        if held:
            yield batch(ids, held)
    return run


def find_personal_data(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED,
                       group: int = GROUP) -> DataFrame:
    """(doc_id, base, spans): the patterns' spans, and those with the spans the field adds, by kind and start.

    ``labelled``: (text, spans array<struct<kind, start, end>>), at most ``max_labelled`` rows by text order."""
    from pyspark.sql.pandas.types import to_arrow_type

    taken = labelled.where("text IS NOT NULL").orderBy("text").limit(max_labelled).collect()
    field = fit([(r["text"], [tuple(s) for s in r["spans"] or []]) for r in taken])
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    span = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(_map(field, to_arrow_type(id_type), group), f"doc_id {id_type.simpleString()}, base {span}, spans {span}")


def written(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

"""Operator 3: token counts of whole texts, huge documents in overlapping chunks spliced together.

The tokenizer drops white space and never joins text across it, so a token
boundary next to ASCII white space does not depend on where a chunk begins or
ends.  A document longer than ``chunk_chars`` is encoded in chunks that
overlap, each as one text with offsets; two neighbours are spliced at a white
space inside their overlap around which both list the same tokens (starts,
ends and ids).  Where the overlap holds no such place, because the chunks'
edges cut the pieces in it, it is doubled and the right-hand chunk encoded again.

A shorter document is one chunk.  The library is too slow for all of them
(README), so their distinct white-space-free pieces are encoded once each and
remembered in a bounded table.

Defined results: null or empty text has 0 tokens; special strings inside a text
count as the library's default counts them; repeated rows each give a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import texts

#: Pieces, and their characters, remembered by one Python worker; past either the table starts afresh.
MEMORY, MEMORY_CHARS = 400_000, 16_000_000
_PIECE = re.compile(r"[^\t\n\x0b\x0c\r ]+")
_SPACE = re.compile(r"[\t\n\x0b\x0c\r ]")


class PieceEncoder:
    """The library's tokens of whole chunks, and its counts of distinct pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.counts: dict[str, int] = {}
        self.held = 0

    def count_all(self, pieces: list[str]) -> int:
        if len(self.counts) > MEMORY or self.held > MEMORY_CHARS:
            self.counts.clear()
            self.held = 0
        counts = self.counts
        if new := [p for p in set(pieces) if p not in counts]:
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                counts[p] = len(e)
            self.held += sum(map(len, new))
        return sum(map(counts.__getitem__, pieces))

    def tokens(self, text: str, offset: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of each token of one chunk, encoded as one text; positions are the document's."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return [(a + offset, b + offset, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _stable_cut(text: str, lo: int, hi: int, left: list, right: list) -> int | None:
    """White space in [lo, hi), nearest the middle, around which both chunks list the same tokens; or None.

    The pieces on both sides of it are compared up to the next white space or the overlap's edge.  A piece that
    an edge cuts is whole in one chunk only, so there the chunks mostly disagree."""
    spaces = [lo + m.start() for m in _SPACE.finditer(text[lo:hi])]
    edges = [lo, *spaces, hi]
    middle = (lo + hi) // 2
    for i in sorted(range(len(spaces)), key=lambda i: abs(spaces[i] - middle)):
        span = (edges[i],), (edges[i + 2],)
        a, b = (tokens[bisect.bisect_left(tokens, span[0]):bisect.bisect_left(tokens, span[1])] for tokens in (left, right))
        if a and a == b:
            return spaces[i]
    return None


def count_spliced(enc: PieceEncoder, text: str, chunk_chars: int, overlap: int) -> int:
    """Tokens of one document, encoded chunk by chunk and spliced at stable boundaries."""
    total, cut, end = 0, 0, min(len(text), chunk_chars)
    left = enc.tokens(text[:end], 0)
    while end < len(text):
        width = overlap
        while True:
            begin = max(cut, end - width)
            stop = min(len(text), begin + max(chunk_chars, 2 * width))
            right = enc.tokens(text[begin:stop], begin)
            at = _stable_cut(text, begin, end, left, right)
            if at is not None:
                break
            if begin == cut:  # no boundary since the last cut: encode one longer chunk from there
                end = min(len(text), max(end + width, stop))
                left = enc.tokens(text[cut:end], cut)
                if end == len(text):
                    return total + len(left)
            width *= 2
        total += bisect.bisect_left(left, (at,))
        cut, end = at, stop
        left = right[bisect.bisect_left(right, (at,)):]
    return total + len(left)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = 65_536,
                 overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit.  One map pass, no shuffle."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        enc = encoder(tokenizer_path)
        for b in frames:
            sizes, tokens = [], []
            for body in b.column("body").to_pylist():
                text = body.decode("utf-8", "replace")
                sizes.append(len(body))
                tokens.append(enc.count_all(_split(text)) if len(text) <= chunk_chars
                              else count_spliced(enc, text, chunk_chars, overlap))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([t > limit for t in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def _split(text: str) -> list[str]:
    return _PIECE.findall(text)

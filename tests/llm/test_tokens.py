from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from touchline.llm import token_counts
from tests.llm.fixtures import awkward_texts, docs, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def whole(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def test_matches_the_library_on_awkward_rows(spark):
    rows = [*awkward_texts(), (90, "a<|endoftext|>b <|startoftext|> don't we'll 12 3a"), (91, "É́  x y ​ z\x1c q")]
    for chunk, overlap in ((65_536, 512), (700, 40)):
        got = token_counts.count_tokens(docs(spark, rows), PATH, 100, chunk, overlap).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
            (str(i), len((t or "").encode()), whole(t), whole(t) > 100) for i, t in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sét12 \n\t.,<|> ́", min_size=0, max_size=400), st.integers(5, 60), st.integers(1, 12))
def test_spliced_chunks_count_as_the_whole(text, chunk, overlap):
    assert token_counts.count_spliced(token_counts.encoder(PATH), text, chunk, overlap) == whole(text)


class Recorded(token_counts.PieceEncoder):
    """Keeps the span of every chunk that was encoded."""

    def tokens(self, text, offset):
        self.spans = [*getattr(self, "spans", []), (offset, offset + len(text))]
        return super().tokens(text, offset)


def test_chunks_that_disagree_near_a_cut_are_widened():
    enc = Recorded(PATH)
    # Words of 30 characters: an overlap of 8 often lies inside one word.
    word = "internationalizationalismslike"
    text = " ".join(word for _ in range(40))
    assert token_counts.count_spliced(enc, text, 200, 8) == whole(text)
    assert any(b[0] < a[0] for a, b in zip(enc.spans, enc.spans[1:]))  # a chunk encoded again from further left
    # The right chunk begins inside a word: its tokens there differ from the left chunk's, later ones agree.
    left, right = enc.tokens(text[:200], 0), enc.tokens(text[100:300], 100)
    inside = [[t for t in side if 100 <= t[0] < 123] for side in (left, right)]
    assert inside[0] != inside[1]
    at = token_counts._stable_cut(text, 100, 200, left, right)
    assert text[at] == " " and at > 123
    assert token_counts._stable_cut(text, 100, 126, left[:len([t for t in left if t[1] <= 123])], right) is None


def test_one_piece_without_white_space():
    text = "ab1" * 3_000
    assert token_counts.count_spliced(token_counts.encoder(PATH), text, 700, 40) == whole(text)


def test_empty_table(spark):
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0

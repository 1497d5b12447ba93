"""Properties that hold for any input."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sonoframe.llm import _common, lm_scoring, packing, suffix_dedup, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
COUNTER = token_counts.ChunkedCounter(PIECES, chunk=23, overlap=2)
BYTES = public_tokenizers.path("byte_bpe_50k.json")
CODEC = packing.Codec(BYTES, public_tokenizers.path("byte_bpe_50k.tiktoken"))
WHOLE = Tokenizer.from_file(BYTES)
TEXT = st.text(st.one_of(st.sampled_from(" \n\tabé▁.,'"), st.characters(exclude_categories=["Cs"])), max_size=200)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_spliced_counts_are_whole_counts(text):
    assert COUNTER.many([text]) == [len(MODEL.encode(text))]


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>\n"])))
def test_packed_ids_are_the_tokenizers(text):
    assert CODEC.ids(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=60))
def test_packing_fills_and_loses_nothing(lengths):
    lengths = np.array(lengths, np.int64)
    pieces = packing.assign(lengths, 64)
    used, got = {}, np.zeros(len(lengths), np.int64)
    for item, start, n, seq in sorted(pieces):
        assert n > 0 and start == got[item]
        got[item] += n
        used[seq] = used.get(seq, 0) + n
    assert (got == lengths).all()
    assert all(n == 64 or n & (n - 1) == 0 for n in used.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_rows(texts):
    hashes, rows = _common.word_hashes(pa.array(texts, pa.string()))
    split = [[w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in split]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for x in split for w in x], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_numbers_come_back(numbers):
    x = np.sort(np.array(numbers, np.uint64))
    if len(x):
        assert (lm_scoring.unpacked(lm_scoring.packed(x, ">u8"), ">u8") == x).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=700), max_size=4), st.text("ab", min_size=200, max_size=260))
def test_equal_strings_meet_at_the_same_place(texts, shared):
    texts = [t[:100] + shared + t[100:] for t in texts]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t) for t in texts])
    row, key, first, last, _ = suffix_dedup.cover(data, at, 200)
    places = {}
    for r, k, a, b in zip(row.tolist(), key.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, b + 1):
            assert at[r] <= s and s + 200 <= at[r + 1]
            places.setdefault(bytes(data[s : s + 200]), set()).add(k)
    assert all(len(k) == 1 for k in places.values())
    assert sum(last - first + 1) == sum(max(0, len(t) - 199) for t in texts)

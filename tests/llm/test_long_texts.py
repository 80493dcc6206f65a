"""Long texts: what is hashed piece by piece equals what is hashed whole, and takes little memory."""

import random
import tracemalloc

import numpy as np
import pytest

from graphweave.llm import language_id, ngram_join, shingles

ALPHABET = "abcdeéΣσß ΑİI.\n\0 12\t😀 "


def peak(run):
    """Bytes that a second run takes at most; the first builds tables."""
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("seed", range(5))
def test_pieces_give_the_same_hashes(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(60)))
        buckets, _, has_letter = language_id.hashed_ngrams([text])
        counts, letter = language_id.ngram_counts(text, piece=rng.randrange(1, 9))
        assert np.array_equal(counts, sum(np.bincount(b, minlength=2**language_id.BITS + 1) for b in buckets)) and letter == has_letter[0]
        data = text.encode().lower()
        for cut, whole in zip(shingles.word_hashes(data, rng.randrange(1, 9)), shingles._hashes_of(data)):
            assert np.array_equal(cut, whole)


def test_long_text_among_others_is_predicted_in_order():
    model = language_id.LanguageModel(["a", "b"], np.zeros(2), np.random.default_rng(1).normal(size=(2**language_id.BITS + 1, 2)).astype(np.float32))
    long = "one two, three. " * 40_000
    texts = ["first", long, "", "second", long + "end", "..." * 200_000, "third"]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        buckets, starts, has_letter = language_id.hashed_ngrams([text])
        total = sum(model.log_prob[b].sum(axis=0, dtype=np.float64) for b in buckets) / len(buckets)
        assert name == (["a", "b"][int(total.argmax())] if has_letter[0] else language_id.UNDETERMINED)
        assert score == pytest.approx(1 / np.exp(total - total.max()).sum() if has_letter[0] else 0.0)


def test_long_text_takes_little_memory():
    text = " ".join(f"word{k * k % 1_000_003}" for k in range(300_000))
    model = language_id.LanguageModel(["a", "b", "c", "d"], np.zeros(4), np.zeros((2**language_id.BITS + 1, 4), np.float32))
    assert peak(lambda: model.predict([text])) < 30 * len(text)  # 64 bytes a character when hashed whole
    assert peak(lambda: shingles.word_hashes(text.encode())) < 20 * len(text)  # about 30


def test_wide_bitmap_is_the_parity_of_its_buckets():
    tokens = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    words = ngram_join.wide_words(len(tokens))
    assert words > ngram_join.WIDE_WORDS
    odd = np.bincount((shingles.mix(tokens) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    assert np.array_equal(ngram_join.parity(tokens, words), np.packbits(odd.astype(np.uint8)).view(np.int64))

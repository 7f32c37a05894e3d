"""Words and token ids of many texts: equal however they are cut, within little memory."""

import gc
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pageloom.llm import words
from pageloom.llm.tokens import WordEncoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def texts_of(megabytes):
    rng = random.Random(3)
    some = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(2000)]
    text = " ".join(rng.choices(some, k=700))
    return pa.array([text] * (megabytes * 1000000 // len(text)))


def peak(work):
    """MB that the work holds at most, numpy's arrays included."""
    words._powers.cache_clear()
    gc.collect()
    tracemalloc.start()
    try:
        for _ in work():
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("what", ["ids", "shingles"])
def test_texts_of_a_batch_take_little_memory(what):
    texts, enc = texts_of(9), WordEncoder(WORD_BPE)
    for _ in enc.encode(texts.slice(0, 100)):  # the words are known
        pass
    assert peak(lambda: enc.encode(texts) if what == "ids" else words.shingle_sets(texts, 5)) < 60


@pytest.mark.parametrize("piece", [1, 64, 1 << 20])
def test_words_dont_depend_on_pieces(monkeypatch, piece):
    texts = pa.array(["One two  three", None, "", " \n", "x" * 5000, "é" * 100 + " a\tb\r\n", "end"])
    data, offsets = words.text_buffer(texts)
    whole = words.words_of(data, offsets, lower=False)
    monkeypatch.setattr(words, "_PIECE", piece)
    for x, y in zip(whole, words.words_of(data, offsets, lower=False), strict=True):
        assert np.array_equal(x, y)


def ids_of(enc, texts):
    return [x.tolist() for _, ids, n in enc.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("special_as_text", [True, False])
def test_cut_words_have_the_tokenizers_ids(special_as_text):
    enc = WordEncoder(WORD_BPE, special_as_text)
    rng = random.Random(5)
    parts = ["a", "S", "'s", "'", "re", "'LL", ".", ",", "(", "_", "<|endoftext|>", "<|", "|>", "é", "é", "…", "≠", ";", ";", "3", "½", "-", "漢", "😀", " ", "\n", " ", "ſ", "K"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(enc, texts) == want


def test_marks_beside_a_word_are_kept_apart():
    """So texts with many marks don't fill the table with words that it has, and the tokenizer sees each word once."""
    enc = WordEncoder(WORD_BPE)
    words_ = ["tele", "scope", "lantern"]
    ids_of(enc, [f"{a}{w}{b}" for w in words_ for a in ("", "(", '"') for b in ("", ",", ".", "!", ")", "...")])
    assert enc.n == len(words_) + len({"(", '"', ",", ".", "!", ")", "..."})

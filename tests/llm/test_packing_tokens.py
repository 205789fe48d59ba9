"""Chunked tokens equal the tokenizer's own, and words before stops are learnt once."""

import random

import numpy as np

from framelens.llm import packing


def blocks(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_chunks_cut_at_stops_give_the_same_tokens():
    tokens = packing.Tokens(packing.public_tokenizer())
    rng = random.Random(8)
    parts = ["word", "wörd", "é", "×", "÷", "'s", "'", "don't", "12", "3.14", ".", "...", ",", "!?", "***", "$5", "%", "&amp;", ")", "(", "|", "<|endoftext|>", "<|", " ", "  ", "\n", "\t", "ß", "日本", "á", "٣", "_", "-", "#", ":", ";", "@"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(3000)] + ["", "."]
    for some in (texts[:1500], texts[1500:], texts[:10]):
        ids, begin = tokens.of(*blocks(some))
        for i, text in enumerate(some):
            assert ids[begin[i] : begin[i + 1]].tolist() == tokens.encode.encode(text, add_special_tokens=False).ids, text
    assert (np.diff(tokens.known.astype(object)) > 0).all()


def test_a_word_before_stops_is_learnt_once():
    tokens = packing.Tokens(packing.public_tokenizer())
    tokens.of(*blocks(["a word. a word, a word! a word*** a word)"]))
    assert len(tokens.known) == 8  # 'a', ' a', ' word' and five stops; once 7 chunks of which five held the word
    tokens.of(*blocks(["a word: a word; a word"]))
    assert len(tokens.known) == 10

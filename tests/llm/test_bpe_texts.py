"""Byte-level BPE against tiktoken, on random and on awkward texts, with few states kept."""

import random

import public_tokenizers
import pytest
import tiktoken

from eventlens.llm import bpe, catalog


@pytest.fixture(scope="module")
def ranks():
    with open(catalog.RANKS, "rb") as file:
        return bpe.read_ranks(file)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(params=[None, 40], ids=["states kept", "40 states kept"])
def encoder(request, ranks, monkeypatch):
    if request.param:
        monkeypatch.setattr(bpe, "STATES_KEPT", request.param)
        monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN)


AWKWARD = [
    "",
    " ",
    "\n\n \t ",
    "a" * 3000,
    "ab" * 2000,
    "é" * 1500,
    "\U0001f469‍\U0001f469‍\U0001f467" * 50,
    "'s 're don't I'll",
    "\x00\x01\x7f ﻿",
    "0123456789" * 200,
    "!?" * 700,
    "한국어 텍스트 中文文本 العربية" * 20,
    "ſtraße ﬁ Ǆ ǅ",
]


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_texts(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_random_texts(encoder, reference):
    rnd = random.Random(5)
    alphabets = ["ab", "abcdefghij ", "etaoin shrdlu\n", "éèüß ñ", "".join(map(chr, range(32, 1000))), "aA1 .,\n\t"]
    for _ in range(600):
        text = "".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(0, 120)))
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_states_are_bounded_inside_one_piece(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "STATES_KEPT", 500)
    rnd = random.Random(1)
    piece = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    transducer = bpe.Transducer(ranks)
    assert list(transducer.encode(piece.encode())) == reference.encode_ordinary(piece)
    assert len(transducer.states) <= 502

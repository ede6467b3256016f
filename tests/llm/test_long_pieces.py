"""Long pieces are counted in blocks; the counts stay the library's."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomline.llm import token_counts as tc

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return tc.Vocabulary.load(BPE)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BPE)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def long_texts(seed: int, most: int) -> list[str]:
    rng = random.Random(seed)
    units = ["a", " ", "!", "é", "ab", "the", "=-", "\U0001f600", "0", "\n", "----"]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = rng.choice(units)
            parts.append(unit * rng.randint(1, most) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, most))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("block, warm, states", [(512, 48, 300_000), (7, 2, 300_000), (16, 0, 40)])
def test_blocks_give_the_counts_of_the_library(monkeypatch, vocabulary, library, block, warm, states):
    # Blocks as short as these are mostly guessed wrong, and so few states are forgotten all the time.
    monkeypatch.setattr(tc, "BLOCK", block)
    monkeypatch.setattr(tc, "WARM", min(warm, block))
    monkeypatch.setattr(tc, "LONG", max(block, 16))
    monkeypatch.setattr(tc, "MOST_STATES", states)
    texts = long_texts(block, 20 * max(block, 16))
    assert tc.Counter(vocabulary).count(texts).tolist() == [library(t) for t in texts]


def test_very_long_pieces_take_no_step_a_byte(vocabulary, library):
    for text in (" " * 300_000, "!" * 300_000, "ab" * 150_000):
        counter = tc.Counter(vocabulary)
        began = time.perf_counter()
        found = counter.count([text]).tolist()
        assert time.perf_counter() - began < 3
        assert found == [library(text)]


def test_states_in_use_keep_their_meaning(vocabulary):
    counter = tc.Counter(vocabulary)
    counter.count(["some words", "and others"])
    meant = [counter.states[3], counter.states[5]]
    used = np.array([5, -1, 3, 0])
    counter.shrink([used])
    assert [counter.states[used[2]], counter.states[used[0]]] == meant
    assert used[1] == -1 and used[3] == 0 and len(counter.states) == 3

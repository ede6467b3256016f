"""Different bytes of one polynomial hash are not taken for copies by the removal of repeats."""

import random

import numpy as np
import pytest

from fathomline.llm.anchors import BASE
from fathomline.llm.suffix_dedup import remove_repeats, repeated_windows
from tests.llm.test_llm import brute_removal

# Found by lattice reduction: the difference is a multiple of 2**64 at BASE.
TWINS = b"jnpiooillplkqklm", b"plkqklronkoojonn"


def value(word: bytes) -> int:
    return sum(c * pow(BASE, i, 2**64) for i, c in enumerate(word)) % 2**64


@pytest.fixture(scope="module")
def around():
    """Surroundings of 300 bytes each, so that every string of 400 bytes holds one of the twins between them."""
    rng = random.Random(5)
    return [tuple("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)).encode() for _ in "ab") for _ in range(5)]


def test_twins_share_their_hash():
    assert value(TWINS[0]) == value(TWINS[1]) and TWINS[0] != TWINS[1]


def test_documents_of_one_hash(spark, around):
    """Ids 0 to 9 are unlike all others; 10 to 15 hold a repeat and its twin, which stays."""
    texts = {}
    for k, (a, b) in enumerate(around):
        texts |= {2 * k: a + TWINS[0] + b, 2 * k + 1: a + TWINS[1] + b}
    for k, (a, b) in enumerate(around[:2]):
        texts |= {10 + 3 * k + i: bytes(reversed(b)) + w + bytes(reversed(a)) + tail for i, (w, tail) in enumerate([(TWINS[0], b""), (TWINS[1], b""), (TWINS[0], b" tail")])}
    got = {r.doc_id: tuple(r)[1:5] for r in remove_repeats(spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string")).collect()}
    assert got == brute_removal(texts, 400)
    assert [got[i][1] for i in range(16)] == [0] * 10 + [616, 0, 616] * 2


def test_windows_of_one_hash(around):
    (a, b), (c, d) = around[:2]
    regions = [a + TWINS[1] + b, a + TWINS[0] + b, c + TWINS[0] + d, a + TWINS[0] + b]
    want = [np.full(len(r) - 399, w) for r, w in zip(regions, [False, True, False, True], strict=True)]
    assert all((g == w).all() for g, w in zip(repeated_windows(regions, 400), want, strict=True))

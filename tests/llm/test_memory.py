"""What a Python worker holds: executors keep their workers, so what each holds adds to a JVM near its limit."""

import random
import tracemalloc

import numpy as np
import pytest

from foliospark.llm import common, language_id, sentencepieces


def _texts() -> list[str]:
    """2 MB of 200 texts."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäßéñ", k=rng.randint(2, 9))) for _ in range(20_000)]
    return [" ".join(rng.choices(words, k=1_500)) for _ in range(200)]


def _peak(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_slice_needs_little_beside_its_text():
    texts = _texts()
    own, v = sentencepieces.pieces(sentencepieces.MODEL), language_id.vocabulary(language_id.MODEL)
    assert _peak(lambda: own.encode(texts)) < 75
    assert _peak(lambda: language_id.Words(texts, v)) < 60


def test_workers_give_back_what_hashes_needed():
    s = np.arange(0, 900_000, 3)
    common.word_hashes(np.full(900_000, 97, np.uint8), s, s + 2)
    common.gram_hashes(np.arange(300_000).astype(np.uint64), 7)
    assert len(common._BYTES.up) <= 1 << 18
    common._give_back()
    assert all(len(p.up) == len(p.down) == 1 for p in (common._BYTES, *common._GRAMS))


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_char_hashes_are_the_same_in_any_block(block, monkeypatch):
    c = np.array([3, 1, 4, 1, 5, 3, 1, 0x110000, 9, 1], np.int32)
    whole = common.char_hashes(c, np.array([0, 2, 5, 7]), np.array([2, 3, 2, 3]))
    monkeypatch.setattr(common, "_SUM_CHARS", block)
    assert (common.char_hashes(c, np.array([0, 2, 5, 7]), np.array([2, 3, 2, 3])) == whole).all()
    assert whole[0] == whole[2] and len(set(whole.tolist())) == 3
    assert len(common.char_hashes(c, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0

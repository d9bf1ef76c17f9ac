"""What a Python worker still holds when an operator's batch is done stays there for the stages that follow."""

import tracemalloc

import numpy as np
import xxhash

from ownerscope.llm import jaccard_join as J
from ownerscope.llm.shingles import shingle_set, word_hashes, words_of


def test_shingle_sets_leave_no_words_in_the_worker():
    J._sets(["a few words first"], 5)
    texts = [" ".join(f"word{k}-{i}" for i in range(500)) for k in range(100)]
    tracemalloc.start()
    try:
        J._sets(texts, 5)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 1_000_000  # 50,000 words


def test_word_hashes_are_those_of_the_single_words():
    words = words_of("Ab ab é 中文 \x00 ab")
    assert word_hashes(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert word_hashes([]).dtype == np.uint64 and len(shingle_set(word_hashes([]), 5)) == 0

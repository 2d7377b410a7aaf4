"""What a task of the phrase counts holds at once stays small beside an executor's memory."""

import tracemalloc

import numpy as np
import pytest

co = pytest.importorskip("itemscope.llm.collocations")


def test_merging_held_pairs_takes_little_memory():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, co.HELD, dtype=np.uint64)
    tracemalloc.start()
    co.distinct_pairs(fp, fp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20

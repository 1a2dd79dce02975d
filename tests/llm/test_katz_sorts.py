"""The sorts that the Katz model's time goes into, against NumPy's own."""

import time

import numpy as np
import pytest

from lipikar.llm import katz


@pytest.mark.parametrize("values", [[], [7], [3, 1, 3, 0, 1], [2**62, 5, 2**62], [-1, 4, -1]])
def test_ranked(values):
    a = np.array(values, np.int64)
    for got, want in zip(katz.ranked(a), np.unique(a, return_index=True, return_inverse=True)):
        assert np.array_equal(got, want)


def test_ranked_takes_half_the_time():
    a = np.random.default_rng(1).integers(0, 2**36, 1_000_000)
    best = lambda f: min((lambda t: (f(), time.thread_time() - t)[1])(time.thread_time()) for _ in range(3))
    assert best(lambda: katz.ranked(a)) < 0.6 * best(lambda: np.unique(a, return_index=True, return_inverse=True))


@pytest.mark.parametrize("top", [1 << 10, 1 << 20])
def test_steady(top):
    a = np.random.default_rng(2).integers(0, top, 5000)
    assert np.array_equal(katz.steady(a), np.argsort(a, kind="stable"))


@pytest.mark.parametrize("top", [50, 2**31, 2**40])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_by_last(n, top):
    columns = np.unique(np.random.default_rng(3).integers(0, top, (400, n)), axis=0)
    assert np.array_equal(columns[katz._by_last(columns)], columns[np.lexsort(columns.T)])

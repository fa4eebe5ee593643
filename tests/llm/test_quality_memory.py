"""The quality model is fitted in the driver, so what it holds there must not grow with the number of pairs."""

import tracemalloc

import numpy as np

from tallyforge.llm import quality


def _made(n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, n)
    return rng.normal(size=(n, quality.N_BASE)) + 0.4 * y[:, None], y


def test_fit_holds_no_difference_of_every_pair():
    x, y = _made()
    tracemalloc.start()
    quality.fit(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # the differences of all pairs alone are 106 MB


def test_blocks_give_the_model_of_one_block(monkeypatch):
    x, y = _made()
    blocks = quality.fit(x, y)
    monkeypatch.setattr(quality, "BLOCK", quality.PAIRS)
    one = quality.fit(x, y)
    np.testing.assert_allclose(blocks.weights, one.weights, rtol=1e-9)
    np.testing.assert_allclose(blocks.score(x), one.score(x), rtol=1e-9)

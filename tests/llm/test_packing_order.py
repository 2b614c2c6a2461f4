"""The order in which a window takes its seed's neighbours."""

import numpy as np

from matchloom.llm import packing


def test_neighbours_lie_best_last_and_ties_by_place():
    score = np.random.default_rng(3).integers(-1, 5, 4000).astype(float)
    got = packing._best_last(score)
    assert got[::-1] == sorted((k for k in range(len(score)) if score[k] > 0), key=lambda k: (-score[k], k))
    assert all(type(k) is int for k in got) and packing._best_last(np.array([0.0, -1.0])) == []

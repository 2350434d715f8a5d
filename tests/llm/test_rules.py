"""The parts of the rule ensemble: splits against an exhaustive search, lasso weights against their optimality conditions."""

from __future__ import annotations

import numpy as np
import pytest

from quillstone.llm import quality


@pytest.mark.parametrize("seed", range(5))
def test_a_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 2))
    y = (x[:, seed % 2] + rng.normal(0, 0.5, 60) > 0.3).astype(float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9))) for f in (0, 1)]
    found: set = set()
    quality._grow(x, y, np.arange(60), (), 1, cuts, np.random.default_rng(0), found)

    def error(f, at):
        left = x[:, f] <= at
        if not 3 <= left.sum() <= 57:
            return np.inf
        return ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()

    least = min(error(f, at) for f in (0, 1) for at in cuts[f])
    assert len(found) == 2
    bounds = [rule[0] for rule in found]
    assert bounds[0].statistic == bounds[1].statistic and bounds[0].at == bounds[1].at and bounds[0].above != bounds[1].above
    assert abs(error(bounds[0].statistic, bounds[0].at) - least) < 1e-9


def test_paths_are_conjunctions_down_to_the_depth():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    cuts = [np.linspace(-2, 2, 17)] * 2
    found: set = set()
    quality._grow(x, y, np.arange(400), (), 3, cuts, np.random.default_rng(0), found)
    assert {len(rule) for rule in found} <= {1, 2, 3} and max(len(rule) for rule in found) > 1
    for rule in found:
        rows = np.logical_and.reduce([b.holds(x) for b in rule])
        assert rows.sum() >= 3


@pytest.mark.parametrize("penalty", [0.002, 0.02, 0.2])
def test_lasso_is_optimal(penalty):
    rng = np.random.default_rng(4)
    z = (rng.random((300, 12)) < 0.4).astype(float)
    y = (z[:, 0] - z[:, 1] + rng.normal(0, 0.7, 300) > 0).astype(float)
    constant, weights = quality._lasso(z, y, penalty)
    p = 1 / (1 + np.exp(-(constant + z @ weights)))
    pull = z.T @ (p - y) / 300
    assert abs((p - y).mean()) < 1e-6
    assert np.all(np.abs(pull[weights == 0]) <= penalty + 1e-6)
    assert np.allclose(pull[weights != 0], -penalty * np.sign(weights[weights != 0]), atol=1e-6)
    assert (weights == 0).sum() > 0 or penalty < 0.01

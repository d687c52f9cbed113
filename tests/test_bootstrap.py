"""The bootstrap of many states at a time against a loop over states, to the last bit."""

import numpy as np
import pytest

from decisionlake.operators import bootstrap, verification as ve
from decisionlake.plans import catalog


def alone(one, two, seed, s):
    at = np.random.default_rng(seed).integers(0, one.shape[1], size=(s.resamples, one.shape[1]))

    def risk(x):
        cost = x[0][at]
        tail = cost >= np.quantile(cost, s.cvar_alpha, axis=1, keepdims=True)
        mean, cvar = cost.mean(axis=1), (cost * tail).sum(axis=1) / tail.sum(axis=1)
        rest = [x[k][at].mean(axis=1) for k in range(1, 5)]
        return mean + s.cvar_weight * (cvar - mean) + s.constraint_weight * rest[0] + s.repair_weight * rest[1] + s.fallback_weight * rest[2] + s.infeasible_weight * (1 - rest[3])

    gap, a = risk(two) - risk(one), (1 - s.confidence) / 2
    return [*np.quantile(gap, [a, 1 - a]), (gap > 0).mean(), gap.std(ddof=1)]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 16, 24])
@pytest.mark.parametrize("s", [ve.Settings(resamples=200), ve.Settings(resamples=101, cvar_alpha=0.8)])
def test_intervals_equal_a_loop(n, s):
    r = np.random.default_rng(n)
    costs = [r.random((6, n)), r.integers(0, 3, (6, n)) / 3, 0.3 + r.integers(0, 4, (6, n)) * 5.5e-17, -1e3 * r.random((6, n))]  # all kinds of ties
    one, two = (np.concatenate([np.stack([c, *(np.repeat(r.random((6, 1)), n, 1) if i % 2 else r.random((6, n)) for i in range(3)), (r.random((6, n)) < 0.8).astype(float)], axis=1) for c in costs]) for _ in range(2))
    seeds = [int(x) for x in r.integers(0, 2**63, len(one))]
    got = bootstrap.intervals(one, two, seeds, s)
    assert np.array_equal(got, [alone(x, y, k, s) for x, y, k in zip(one, two, seeds)])


def test_eights_come_from_tables(monkeypatch):
    r, called = np.random.default_rng(0), []
    real = bootstrap._margins_of_eight
    monkeypatch.setattr(bootstrap, "_margins_of_eight", lambda *x: called.append(len(x[2])) or real(*x))
    x = r.random((40, 5, 8))
    bootstrap.intervals(x, x + 0.1, list(range(40)), ve.Settings(resamples=50))
    assert sum(called) == 40


def test_rollouts_are_not_dealt_out_for_the_pairs(spark):
    sf = "/root/testdata/sf0.001"
    plan = catalog.ve11(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(state_id" in plan and not [x for x in plan.splitlines() if "Exchange" in x and ", candidate_index" in x]


def test_only_states_that_are_asked_for_are_resampled(spark, monkeypatch):
    seen, real = [], ve.paired_bootstrap
    monkeypatch.setattr(ve, "paired_bootstrap", lambda rollouts, ranked, s: seen.append(ranked) or real(rollouts, ranked, s))
    catalog.ve12_sure(spark, "/root/testdata/sf0.001")
    each = seen[0].groupBy("state_id").agg({"equivalent": "count", "*": "count"})
    assert each.count() > 0 and seen[0].selectExpr("count(*) over (partition by state_id) as n", "count_if(equivalent) over (partition by state_id) as e").where("n > 1 and e = 1").count() == 0

"""How often the large tables are dealt out: disk is full of what exchanges write."""

import pytest

from decisionlake.operators import teacher as te, verification as ve
from decisionlake.plans import audits, catalog, data, teacher
from decisionlake.sources import adapters as a

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_dealt_out_once_for_all_that_goes_by_state(spark):
    assert plan(ve.select(ve.rank_candidates(ve.summarize_rollouts(a.rollouts(spark, SF))))).count("Exchange") == 1


def test_the_selected_are_told_from_one_exchange(spark):
    won = catalog.qr1_selected(spark, SF)
    assert len({x.split("plan_id")[0] for x in plan(won).splitlines() if "Exchange hashpartitioning(state_id" in x and "Reused" not in x}) <= 2
    assert won.columns[0] == "n" and won.count() == 1


def test_rows_of_a_pool_are_not_dealt_out_again(spark):
    own, bank, greedy = teacher.pool_parts(spark, SF)
    assert plan(te.pool_summary(te.build_pool(own, bank, greedy), bank)).count("Exchange") == 4


def test_coverage_takes_both_zeros_for_one(spark):
    def rows(source, *near):
        return spark.createDataFrame([("s", i, 0, 0, 0.0, 0.0, x, 0.0, 0.0, 0.0, 0.0) for i, x in enumerate(near)], "state_id string, candidate_index int, pair int, ris_code int, " + ", ".join(f"{c} double" for c in te.CONTINUOUS))

    bank = rows("bank", 0.0, 0.25)
    assert te.pool_summary(te.build_pool(rows("own", -0.0), bank.where("eta_near > 1"), bank.where("eta_near > 1")), bank).first().coverage == 0.5


@pytest.mark.parametrize("f", [audits.au6, audits.metrics, audits.qr13, data.ev5, data.mg4])
def test_a_query_ranks_once(spark, monkeypatch, f):
    times, rank = [], ve.rank_candidates
    monkeypatch.setattr(ve, "rank_candidates", lambda *x: times.append(1) or rank(*x))
    f(spark, SF)
    assert len(times) == 1

"""Operators against numbers worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from decisionlake.functions import freshness, links
from decisionlake.operators import audit, sampling, training, verification as ve


def test_splits_and_seeds(spark):
    d = spark.createDataFrame([(f"scenario-{i}",) for i in range(50)], "k string")
    got = sampling.assign_split(d, "k", 42).withColumn("seed", sampling.stable_seed(F.col("k"), 42)).collect()
    for r in got:
        h = hashlib.sha256(f"42:{r.k}".encode()).digest()
        u = int.from_bytes(h[:8], "big") / 2**64
        assert r.split == ("train" if u < 0.7 else "validation" if u < 0.85 else "test")
        assert r.seed == int.from_bytes(h[:4], "big")
    with pytest.raises(ValueError):
        sampling.assign_split(d, "k", 42, {"train": 0.5, "validation": 0.1, "test": 0.1})


def test_quotas(spark):
    q = {"ordinary": 0.35, "freshness": 0.25, "sensing": 0.15, "secrecy": 0.15, "rare": 0.10}
    got = dict(sampling.largest_remainder_quotas(spark, 5000, q, 42, "category").collect())
    assert sorted(got.values()) == [500, 750, 750, 1250, 1750]
    assert [tuple(r) for r in sampling.shard_bounds(spark, 5000, 10).collect()] == [(i, 500 * i, 500 * i + 500) for i in range(10)]
    d = sampling.exact_assignments(spark.range(101), "id", 101, {"a": 0.5, "b": 0.5}, 1, "part").groupBy("part").count().collect()
    assert sorted(r["count"] for r in d) == [50, 51]


def test_summary_and_rank(spark):
    rows = [("s", c, "teacher", m, cost + m, 0.0, 0.0, 0.0, True) for c, cost in ((0, 1.0), (1, 1.005), (2, 3.0)) for m in range(4)]
    d = spark.createDataFrame(rows, "state_id string, candidate_index long, candidate_source string, rollout_index int, discounted_cost double, mean_constraint_violation double, mean_repair_distance double, fallback_rate double, hard_feasible boolean")
    ranked = ve.rank_candidates(ve.summarize_rollouts(d))
    r = {x.candidate_index: x for x in ranked.collect()}
    assert r[0].cvar_cost == pytest.approx(4.0) and r[0].p90_cost == pytest.approx(3.7) and r[0].median_cost == pytest.approx(2.5)
    assert r[0].risk == pytest.approx(2.5 + 0.25 * 1.5) and [r[i].rank for i in range(3)] == [1, 2, 3]
    assert sum(x.quality_weight for x in r.values()) == pytest.approx(1) and [r[i].equivalent for i in range(3)] == [True, True, False]
    chosen = ve.select(ranked)
    assert chosen.first().equivalent_indices == [0, 1]
    boot = ve.paired_bootstrap(d.withColumn("rollout_seed", F.col("rollout_index") + 7), ranked)
    assert boot.first().confidence_low > 0
    status = ve.decision_status(chosen.join(boot, "state_id", "left")).first()
    assert status.decision_status == "practically_equivalent" and not status.uncertain


def test_ages_and_queue(spark):
    log = spark.createDataFrame([("u", i, e, g) for i, (e, g) in enumerate([(False, 1.0), (True, -5.0), (False, 30.0), (False, -1.0)], 1)], "entity string, slot int, delivered boolean, increment double")
    assert [r.age for r in freshness.age(log, "delivered", 10, 3).orderBy("slot").collect()] == [4, 1, 2, 3]
    assert [r.queue for r in freshness.virtual_queue(log, 25.0).orderBy("slot").collect()] == [1.0, 0.0, 25.0, 24.0]


def test_availability(spark):
    jobs = spark.createDataFrame([("u", 1, 3, 9.0), ("u", 2, 3, 5.0), ("u", 0, 4, 1.0)], "entity string, timestamp int, ready_slot int, trace double")
    slots = spark.createDataFrame([("u", i) for i in range(1, 6)], "entity string, slot int")
    got = freshness.sensing_availability(slots, jobs).orderBy("slot").collect()
    assert [r.available.timestamp if r.available else None for r in got] == [None, None, 2, 2, 2]


def test_noma(spark):
    d = spark.createDataFrame([(1.0, 3.0, 2.0, 1.0, 1.0)], "near_power double, far_power double, near_gain double, far_gain double, disturbance double")
    r = links.noma_kpis(d, threshold=1.0).first()
    assert (r.far_sinr, r.far_at_near_sinr, r.near_sinr, r.sic_margin) == (1.5, 2.0, 2.0, 1.0) and r.far_rate == pytest.approx(1.3219280948873624)


def test_audit(spark):
    states = spark.createDataFrame([("0", 0, "a", "train", "h"), ("1", 1, "a", "test", "h"), ("3", 3, "b", "train", "g"), ("3", 3, "b", "train", "i")], "state_id string, global_state_index long, scenario_id string, split string, causal_state_hash string")
    assert {tuple(r) for r in audit.index_coverage(states, 0, 4).collect()} == {("missing", 2), ("repeated", 3)}
    assert audit.split_leakage(states).first().leaking == 1
    assert [r.n for r in audit.duplicate_states(states).collect()] == [2]
    assert audit.orphans(spark.createDataFrame([("9",), ("0",)], "state_id string"), states).first().orphans == 1


def test_batches(spark):
    d = spark.range(1000).selectExpr("cast(id as string) as state_id")
    n = [r["count"] for r in training.training_batches(d, 300, 1).groupBy("batch").count().orderBy("batch").collect()]
    assert n == [300, 300, 300, 100]
    first = {tuple(r) for r in training.training_batches(d, 300, 1).select("state_id", "batch").collect()}
    assert first == {tuple(r) for r in training.training_batches(d.repartition(7), 300, 1).select("state_id", "batch").collect()}

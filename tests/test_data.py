"""Bootstrap, shards, features, training inputs and stateful streams against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from decisionlake.functions import freshness
from decisionlake.operators import evaluation as ev, features as fe, merge as me, report, sampling, shards, training, verification as ve
from decisionlake.streaming import streams


def test_bootstrap_sample_by_sample(spark):
    r = np.random.default_rng(1)
    s = ve.Settings(resamples=50)
    rows = [("a", c, m, 100 + 7 * m, float(r.normal(c, 1)), float(r.random()), float(r.random()), 0.0, bool(m % 3)) for c in (4, 2) for m in range(8)] + [("b", 0, m, m, 1.0, 0.0, 0.0, 0.0, True) for m in range(8)]
    rollouts = spark.createDataFrame(rows, "state_id string, candidate_index int, rollout_index int, rollout_seed long, discounted_cost double, mean_constraint_violation double, mean_repair_distance double, fallback_rate double, hard_feasible boolean")
    ranked = spark.createDataFrame([("a", 4, 1), ("a", 2, 2), ("b", 0, 1)], "state_id string, candidate_index int, rank int")
    got = ve.paired_bootstrap(rollouts.repartition(3), ranked, s).collect()
    assert [g.state_id for g in got] == ["a"]

    def risk(sample):
        cost = [x[4] for x in sample]
        q = np.quantile(cost, s.cvar_alpha)
        mean, tail = np.mean(cost), np.mean([c for c in cost if c >= q])
        return mean + s.cvar_weight * (tail - mean) + s.constraint_weight * np.mean([x[5] for x in sample]) + s.repair_weight * np.mean([x[6] for x in sample]) + s.fallback_weight * np.mean([x[7] for x in sample]) + s.infeasible_weight * (1 - np.mean([x[8] for x in sample]))

    best, second = ([x for x in rows if x[0] == "a" and x[1] == c] for c in (4, 2))
    seed = int.from_bytes(hashlib.sha256(("4:2:" + ",".join(str(x[3]) for x in best)).encode()).digest()[:8], "big")
    margins = [risk([second[i] for i in at]) - risk([best[i] for i in at]) for at in np.random.default_rng(seed).integers(0, 8, size=(50, 8))]
    want = (*np.quantile(margins, [0.025, 0.975]), np.mean(np.array(margins) > 0), np.std(margins, ddof=1))
    assert (got[0].confidence_low, got[0].confidence_high, got[0].probability, got[0].standard_error) == pytest.approx(want)
    moved = rollouts.withColumn("rollout_seed", F.expr("case when candidate_index = 2 then rollout_seed + 1 else rollout_seed end"))
    with pytest.raises(Exception, match="common seeds"):
        ve.paired_bootstrap(moved, ranked, s).collect()


def test_errors_are_raised(spark):
    key = "a" * 64
    old = spark.createDataFrame([(key, "x", 5)], "cache_key string, text string, at int")
    new = spark.createDataFrame([(key, "y", 1), (key, "z", 2)], "cache_key string, text string, at int")
    assert [tuple(r) for r in shards.cache_upsert(old, new, "at").collect()] == [(key, "z", 2)]
    with pytest.raises(Exception, match="hex"):
        shards.cache_upsert(old, new.withColumn("cache_key", F.lit("no")), "at").collect()
    log = spark.createDataFrame([("u", 1, 2)], "entity string, slot int, accepted int")
    with pytest.raises(Exception, match="future"):
        freshness.sensing_age(log, "accepted", 4, 2).collect()
    with pytest.raises(Exception, match="no rows in split"):
        training.split_counts(spark.createDataFrame([("train",)], "split string")).collect()
    states = spark.createDataFrame([("a", 0), ("b", 2)], "state_id string, global_state_index long")
    with pytest.raises(Exception, match="missing or repeated"):
        me.merge_shards({"states": states}, "run", 2)["states"].collect()
    assert me.merge_shards({"states": states.limit(1)}, "run", 1)["states"].first().run_id == "run"


def test_student_quantiles(spark):
    d = spark.createDataFrame([(k,) for k in (1, 12, 17, 30, 60, 10**9)], "k long").select(training.student(F.col("k")))
    assert [round(r[0], 3) for r in d.collect()] == pytest.approx([12.706, 2.179, 2.110, 2.042, 2.001, 1.960], abs=2e-3)


def test_trim_keeps_a_prefix_of_all_tables(spark):
    states = spark.createDataFrame([(f"s{i}", i) for i in range(6)], "state_id string, global_state_index long")
    selections = spark.createDataFrame([(f"s{i}", "rejected" if i == 1 else "accepted", 2, 1, 3) for i in range(6)], "state_id string, acceptance_status string, candidate_pool_count int, verified_candidate_count int, verification_rollouts int")
    accepted = [i for i in range(6) if i != 1]
    tables = {
        "states": states, "selections": selections, "candidates": spark.createDataFrame([(f"s{i}", k) for i in accepted for k in range(2)], "state_id string, candidate_index int"),
        "rollouts": spark.createDataFrame([(f"s{i}", k) for i in accepted for k in range(2 if i == 4 else 3)], "state_id string, rollout_index int"),
        "demonstrations": spark.createDataFrame([(f"s{i}",) for i in accepted], "state_id string"), "requests": states.select("state_id"),
    }
    got = {name: sorted({r.state_id for r in t.collect()}) for name, t in me.trim_incomplete(tables).items()}
    assert got["states"] == got["selections"] == got["requests"] == ["s0", "s1", "s2", "s3"]
    assert got["candidates"] == got["rollouts"] == got["demonstrations"] == ["s0", "s2", "s3"]
    assert me.complete_states(tables | {"rollouts": tables["rollouts"].limit(0)}).where("complete").count() == 1


def test_manifests(spark):
    rows = [(k, 3, 30, 1, "c", False, 10 * k, 10 * k + 10, "now", {"states": 10}) for k in range(3)]
    kinds = "shard_index long, shard_count long, total_requested_states long, master_seed long, git_commit string, git_dirty boolean, global_state_start long, global_state_stop long, completed_at string, table_counts map<string, long>"
    assert me.validate_shards(spark.createDataFrame(rows, kinds)).count() == 0
    assert {r.problem for r in me.validate_shards(spark.createDataFrame(rows[:2], kinds)).collect()} == {"shards are missing", "shards do not cover the plan"}
    assert {r.problem for r in me.validate_shards(spark.createDataFrame([], kinds)).collect()} >= {"no shard manifests were found"}


def test_payload_contracts(spark):
    o = "named_struct('pair_tokens', array({0}), 'pair_mask', array(1), 'global_features', array_repeat(1.23456789D, 25), 'virtual_queues', array_repeat(0.5D, 8), 'previous_action', array_repeat(0D, 9)) as observation"
    good = fe.causal_payload(spark.sql("select " + o.format("array_repeat(0.25D, 14)")))
    assert good.select("causal.global_features").first()[0][0] == 1.234568 and fe.name_features(good, 1).first().named.pairs[0].active
    short = fe.causal_payload(spark.sql("select " + o.format("array_repeat(0.25D, 13)")))
    with pytest.raises(Exception, match="contract"):
        fe.name_features(short, 1).select("named").collect()
    with pytest.raises(Exception, match="missing"):
        fe.causal_payload(spark.sql("select " + o.format("array_repeat(0.25D, 14)")).withColumn("observation", F.expr("named_struct('pair_tokens', observation.pair_tokens, 'pair_mask', observation.pair_mask, 'global_features', cast(null as array<double>), 'virtual_queues', observation.virtual_queues, 'previous_action', observation.previous_action)"))).select("causal").collect()


def test_tracking_errors_of_singular_covariances(spark):
    p = np.array([[2.0, 1.0, 0.0, 0.0], [1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 3.0]])
    d = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [0.0, 1.0, 1.0, 1.0], p.tolist())], "k int, mean array<double>, truth array<double>, covariance array<array<double>>")
    e = np.array([1.0, 1, 2, 3])
    r = fe.tracking_errors(d, ["k"]).first()
    assert (r.position_squared_error, r.nees) == pytest.approx((2.0, e @ np.linalg.pinv(p) @ e)) and fe.tracking_errors(d.limit(0), ["k"]).count() == 0


def test_ages_over_batches(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(e, s, bool(r.random() < 0.2), float(r.normal(0.1, 1))) for e in "ab" for s in range(40)]
    for k in range(4):  # files by slot, one after another; the last brings a late slot again
        part = [x for x in rows if x[1] // 10 == k] + ([("a", 5, True, 9.0)] if k == 3 else [])
        spark.createDataFrame(part, "entity string, slot long, event boolean, increment double").coalesce(1).write.mode("append").parquet(str(tmp_path / "slots"))
    schema = spark.read.parquet(str(tmp_path / "slots")).schema
    stream = streams.stream_table(spark, str(tmp_path / "slots"), schema, files=1)
    got = {(x.entity, x.slot): (x.age, x.queue) for x in streams.drain(streams.ages(stream, "entity", 6, 3.0, 2), ["entity", "slot"], "ages", "append").collect()}
    for e in "ab":
        age, queue = 2, 0.0
        for _, s, event, g in (x for x in rows if x[0] == e):
            age, queue = 1 if event else min(age + 1, 6), min(3.0, max(0.0, queue + g))
            assert got[e, s] == pytest.approx((age, queue))
    assert len(got) == 80


def test_report_rules(spark):
    m = [(name, 1.0) for name, *_ in report.WARNINGS] + [("verified_baseline_compared_states", 0.0)]
    by = lambda more: {r.warning for r in report.audit_warnings(spark.createDataFrame([(n, {**dict(m), **more}[n]) for n in dict(m) | more], "metric string, value double")).collect()}
    assert not any("intervals overlap" in w for w in by({}))  # too much is unresolved
    assert any("intervals overlap" in w for w in by({"selection_unresolved_rate": 0.0}))
    low = {"selected_vs_greedy_verified_win_rate": 0.1}
    assert not any("greedy in 55%" in w for w in by(low)) and any("greedy in 55%" in w for w in by(low | {"verified_baseline_compared_states": 3.0}))
    gates = report.all_gates(spark.createDataFrame([(k, limit) for k, (_, limit) in ev.GATES.items()], "metric string, value double")).collect()
    assert len(gates) == 25 and all(g.passed and g.all_passed for g in gates)
    none = report.all_gates(spark.createDataFrame([], "metric string, value double")).collect()
    assert not any(g.passed or g.all_passed for g in none)


def test_ranks_over_many_prefixes(spark):
    d = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = sampling.global_rank(d, "h", rows_each=7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(500)) and [r.h for r in got] == sorted(r.h for r in got)

"""Merging shards from folders, resuming, transactions and single candidates."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decisionlake.operators import audit, merge as me, sampling, verification as ve



def shards(folder, n=3, each=4, **changes):
    for k in range(n):
        s = folder / f"shard-{9 - k:04d}"
        s.mkdir(parents=True)
        index = [k * each + i for i in range(each)]
        m = {"shard_index": k, "shard_count": n, "total_requested_states": n * each, "master_seed": 1, "git_commit": "c", "git_dirty": False, "global_state_start": k * each, "global_state_stop": (k + 1) * each, "completed_at": "t", "table_counts": {"states": each}}
        m |= changes.get(f"m{k}", {})
        (s / "manifest.json").write_text(json.dumps(m))
        (s / "states.jsonl").write_text("".join(json.dumps({"state_id": f"s{i}", "global_state_index": i, "run_id": f"old{k}"}) + "\n" for i in changes.get(f"i{k}", index)) + changes.get(f"t{k}", ""))
        (s / "rows.jsonl").write_text("\n".join(json.dumps({"state_id": f"s{i}", "x": x}) for i in index for x in (1, 2)) + "\n\n")


MANIFEST = "shard_index long, shard_count long, total_requested_states long, master_seed long, git_commit string, git_dirty boolean, global_state_start long, global_state_stop long, completed_at string, table_counts map<string,long>"


def merged(spark, root, out, run="new", expected=None):
    schemas = {"states": StructType.fromDDL("state_id string, global_state_index long, run_id string"), "rows": StructType.fromDDL("state_id string, x long, run_id string")}
    me.merge_folder(spark, str(root), str(out), run, schemas, StructType.fromDDL(MANIFEST), expected)
    return schemas


def test_merge_keeps_order_and_publishes_once(spark, tmp_path):
    shards(tmp_path / "in")
    schemas = merged(spark, tmp_path / "in", tmp_path / "out", expected=3)
    states = me.read_merged(spark, str(tmp_path / "out"), "states", schemas["states"])
    folder = json.loads(next((tmp_path / "out" / "merges").glob("part-*")).read_text())["folder"]
    read = [json.loads(line)["global_state_index"] for f in sorted((tmp_path / "out" / folder.rsplit("/", 1)[1] / "states.jsonl").glob("part-*")) for line in f.read_text().splitlines()]
    assert read == list(range(12))
    assert {r.run_id for r in states.collect()} == {"new"}
    assert me.read_merged(spark, str(tmp_path / "out"), "rows", schemas["rows"]).count() == 24
    merged(spark, tmp_path / "in", tmp_path / "out", "again")
    assert {r.run_id for r in me.read_merged(spark, str(tmp_path / "out"), "states", schemas["states"]).collect()} == {"again"}


@pytest.mark.parametrize("changes,text", [
    ({"i1": [4, 5, 6, 6]}, "missing or repeated"), ({"i1": [4, 5, 6]}, "missing or repeated"), ({"m1": {"completed_at": None}}, "not finalized"), ({"m2": {"git_commit": "other"}}, "one clean commit"), ({"t0": '{"a":1} tail\n'}, "not one JSON|MALFORMED|parse"),
])
def test_merge_publishes_nothing_that_is_wrong(spark, tmp_path, changes, text):
    shards(tmp_path / "in", **changes)
    with pytest.raises(Exception, match=text):
        merged(spark, tmp_path / "in", tmp_path / "out")
    assert not (tmp_path / "out" / "merges").exists()


def test_merge_counts_shards(spark, tmp_path):
    shards(tmp_path / "in")
    with pytest.raises(ValueError, match="expected 4 shards"):
        merged(spark, tmp_path / "in", tmp_path / "out", expected=4)


def test_resuming_older_schemas_and_external_baselines(spark):
    states = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "state_id string, global_state_index long")
    x = spark.createDataFrame([("s0", "accepted", 2, 1, 3, 1), ("s1", "accepted", 2, 1, 0, 0), ("s2", "other", 0, 0, 0, 0), ("s3", "accepted", 2, 1, 3, None)], "state_id string, acceptance_status string, candidate_pool_count int, verified_candidate_count int, verification_rollouts int, external_baseline_rollout_count int")
    t = {
        "states": states, "selections": x, "candidates": spark.createDataFrame([(s, k) for s in ("s0", "s1", "s3") for k in range(2)], "state_id string, candidate_index int"),
        "rollouts": spark.createDataFrame([("s0", k) for k in range(6)] + [("s3", k) for k in range(3)], "state_id string, i int"), "demonstrations": spark.createDataFrame([("s0",), ("s1",), ("s3",)], "state_id string"),
        "requests": spark.createDataFrame([("s0",), ("s1",), ("s2",), ("s4",)], "state_id string"),
    }
    got = lambda d: {r.state_id: r.complete for r in d.collect()}
    assert got(me.complete_states(t)) == {"s0": True, "s1": False, "s2": True, "s3": False, "s4": False}  # s3 has no request, s4 no selection
    assert got(me.complete_states({k: v for k, v in t.items() if k != "requests"}))["s3"]
    assert got(me.complete_states(t, schema=4, candidates=2, shortlist=0))["s0"] and not got(me.complete_states(t, schema=4, candidates=3, shortlist=0))["s0"]


def test_transactions_of_each_selection(spark):
    x = spark.createDataFrame([("a", "accepted", 2, 1), ("b", "accepted", 2, 0), ("c", "accepted", 0, 0), ("d", "rejected", 9, 9), ("e", "accepted", 1, None)], "state_id string, acceptance_status string, verification_rollouts int, external_baseline_rollout_count int")
    c = spark.createDataFrame([(s, v) for s in "abcde" for v in (True, False, None)], "state_id string, rollout_verified boolean")
    r = spark.createDataFrame([("a",)] * 4 + [("b",)] * 3 + [("e",)], "state_id string")
    assert sorted(map(tuple, audit.rollout_transactions(x, c, r).collect())) == [("b", 2, 3), ("c", 0, 0)]
    assert {q.state_id for q in audit.rollout_transactions(x, c, r, schema=4).collect()} == {"a", "b", "c", "e"}


def test_a_single_candidate_is_sure(spark):
    rows = [("a", 0, "t", 1.0, 0.5, 1), ("b", 0, "t", 1.0, 0.0, 1), ("b", 1, "g", 2.0, 0.0, 2)]
    ranked = spark.createDataFrame(rows, "state_id string, candidate_index int, candidate_source string, risk double, quality_weight double, rank int")
    ranked = ranked.withColumns({"score_margin": F.lit(1.0), "rollouts": F.lit(8), "equivalent": F.col("rank") == 1})
    boot = spark.createDataFrame([("b", 0.1, 0.2, 0.9, 0.0)], "state_id string, confidence_low double, confidence_high double, probability double, standard_error double")
    got = {r.state_id: r for r in ve.decision_status(ve.select(ranked).join(boot, "state_id", "left")).collect()}
    endless = float("inf")
    a, b = got["a"], got["b"]
    assert (a.score_margin, a.confidence_low, a.confidence_high, a.standardized_margin, a.probability, a.decision_status, a.uncertain) == (endless, endless, endless, endless, 1.0, "decisive", False)
    assert (b.confidence_low, b.standardized_margin, b.probability, b.decision_status, b.uncertain) == (0.1, endless, 0.9, "decisive", False)
    assert {r.state_id: r.candidate_source_counts for r in ve.source_counts(ranked).collect()} == {"a": {"t": 1}, "b": {"t": 1, "g": 1}}


def test_ranks_by_numbers_go_by_their_size(spark):
    """Not by their digits, in as many ranges as there are."""
    x = spark.range(1000).selectExpr("id * 7 as x")
    got = sampling.global_rank(x, "x", "place", rows_each=90)
    assert [r.place for r in got.orderBy("x").collect()] == list(range(1000))

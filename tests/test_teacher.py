"""The response path and candidate pools against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from decisionlake.operators import teacher as te


def said(candidates, **top):
    return json.dumps({"schema_version": 1, "state_id": "s", "candidates": candidates} | top)


def good(**more):
    return {"template_id": "p1_sense10w", "eta_near": 0.1, "eta_cpu": 1} | more


@pytest.mark.parametrize("payload, error", [
    (said([good(), good(confidence=0.2, reason_codes=["a"])]), None),
    (None, "no valid JSON"), ("[1]", "no valid JSON"),
    (said([good(), good()], more=1), "unknown fields"), (said([good(), good(extra=1)]), "unknown fields"),
    (said([good(), good(template_id="")]), "length"), (said([good(), good(template_id="x" * 65)]), "length"),
    (said([good(), good(eta_near=0.6)]), "eta_near"), (said([good(), {"template_id": "a", "eta_near": 0.1}]), "eta_cpu"),
    (said([good(), good(reason_codes=["a"] * 4)]), "reason_codes"), (said([good(), good(confidence=1.5)]), "confidence"),
    (said([good(), good(pair=-1)]), "another control"), (said([good(), good(aav_heading_rad=4)]), "another control"),
    (said([good(), good()], schema_version=2), "schema"), (said([good(), good()], state_id="t"), "state_id"), (said([good()]), "expected 2 candidates, received 1"),
    (json.dumps({"schema_version": 1, "state_id": "s", "candidates": 3}), "no list"),
])
def test_validation(spark, payload, error):
    r = te.validated(spark.createDataFrame([("s", payload, 2)], "state_id string, payload string, expected_candidates int")).first()
    assert (r.valid, r.error is None) == (error is None, error is None) and (error is None or error in r.error)


def test_normalising_and_routing(spark):
    moved = good(template_id_actual="x", reason_codes="single", reason_codes_override=["y"])
    del moved["template_id"]
    rows = [("s", said([moved, good(template_id_actual="p1_sense10w"), good(template_id_actual="z", reason_codes=["a", "b"])]), 3, False), ("u", "none", 3, True), ("v", "none", 3, False)]
    checked = te.validated(spark.createDataFrame(rows, "state_id string, payload string, expected_candidates int, failed boolean"))
    r = checked.where("valid").first()
    assert [c.template_id for c in r.candidates] == ["x", "p1_sense10w", "z"] and [list(c.reason_codes) for c in r.candidates] == [["single"], [], ["a", "b"]]
    assert [n.split(".")[1] for n in r.notes] == [
        "template_id_actual->template_id", "reason_codes_string_to_array", "reason_codes_override_removed", "template_id_actual_duplicate_removed", "template_id_conflict_prefer_actual"]
    requests, rejected = te.route(checked.selectExpr("*", "case when failed then 'transport_error' end as call_status"))
    assert {x.state_id: x.status for x in requests.collect()} == {"s": "ok", "u": "transport_error", "v": "parse_error"}
    assert sorted((x.state_id, x.selected_candidate_index, x.acceptance_status) for x in rejected.collect()) == [("u", -1, "rejected"), ("v", -1, "rejected")]
    each = te.explode_candidates(checked).orderBy("candidate_index").collect()
    assert [x.confidence for x in each] == [0.5] * 3 and each[0].template_id_raw is None


def test_canonical_json(spark):
    d = spark.sql("select named_struct('b', array(named_struct('z', 1, 'y', null)), 'a', 'x') as v")
    assert d.select(te.canonical_json(d, "v")).first()[0] == '{"a":"x","b":[{"y":null,"z":1}]}'
    a, b = (te.render_prompts(spark.sql(q), "v", "Do.").first().prompt_hash for q in ("select named_struct('a', 1, 'b', 2) as v", "select named_struct('b', 2, 'a', 1) as v"))
    assert a == b


def test_pool_and_compliance(spark):
    names = ["state_id", "candidate_index", "pair", "ris_code", *te.CONTINUOUS]
    types = ", ".join(f"{n} {'string' if n == 'state_id' else 'int' if i < 4 else 'double'}" for i, n in enumerate(names))

    def action(k, pair, haps, near=0.1):
        return ("s", k, pair, 0, haps, 1 - haps, near, 0.0, 0.0, 0.0, 0.5)

    teacher = spark.createDataFrame([action(0, 1, 0.25), action(1, 1, 0.25)], types)
    bank = spark.createDataFrame([action(0, 1, 0.25 + 1e-10), action(1, 2, 0.45), action(2, 2, 0.45)], types)
    greedy = spark.createDataFrame([action(0, 1, 0.25)], types)
    pool = te.build_pool(teacher, bank, greedy)
    assert [(r.candidate_index, r.candidate_source, r.pair) for r in pool.orderBy("candidate_index").collect()] == [(0, "teacher", 1), (1, "teacher", 1), (2, "safe_template", 2), (3, "greedy_baseline", 1)]
    r = te.pool_summary(pool, bank).first()
    assert (r.candidate_pool_count, r.coverage, r.greedy_candidate_index) == (4, 1.0, 3)
    templates = spark.createDataFrame([("s", "a", 1, 0.25, 0.75, 0.1, 0.2)], "state_id string, template_id string, pair int, eta_haps double, eta_communication double, default_near double, maximum_near double")
    c = pool.withColumn("template_id", F.expr("case when candidate_index = 0 then 'a' else 'b' end"))
    assert [r.template_compliant for r in te.template_compliance(c, templates).orderBy("candidate_index").collect()] == [True, False, False, None]
    assert te.template_compliance(c.where("candidate_index = 0").withColumn("eta_near", F.lit(0.3)), templates).first().template_compliant is False


def test_templates_of_states_are_never_broadcast(spark):
    """They grow with the states, though their file is small."""
    t = spark.range(20).selectExpr("cast(id as string) as state_id", "inline(array(struct('p1_sense10w' as template_id, 1 as pair, 0.25D as eta_haps, 0.75D as eta_communication, 0.1D as default_near, 0.3D as maximum_near)))")
    c = spark.range(20).selectExpr("cast(id as string) as state_id", "0 as candidate_index", "'teacher' as candidate_source", "'p1_sense10w' as template_id", "'' as template_id_raw", "array('a') as reason_codes", "1 as pair", "0.25D as eta_haps",
                                   "0.75D as eta_communication", "0.1D as eta_near", "0.5D as eta_cpu")
    d = te.project(te.resolve_template(c, t), t)
    out = te.template_compliance(d.withColumn("template_id", F.col("resolved")).drop("resolved"), t)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.template_compliant for r in out.collect()] == [True] * 20

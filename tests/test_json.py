"""Strict JSON lines, objects in answers, and types of fields."""

import json

import pytest
from pyspark.sql.types import StructType

from decisionlake.functions.jsontext import is_object
from decisionlake.operators import responses, teacher as te
from decisionlake.sources import tables

TEXTS = [
    '{"a":1}', ' {"a":1}\t', '{"a":1} tail', '{"a":2}{"a":3}', '{"a":1},{"a":2}', '{"a":1}] x', '{"a":1}, {"b":2}] x', "[1]", "1", "null", '"x"', "{", '{"a":{"b":1}', "{'a':1}", '{"a":01}', '{"a":"x\\"} y"}',
    '{"a":NaN}', '{"a":1,"a":2}', "", "   ", "x", "{}", '{"a":[1,2,{"b":"]}"}]}', '{"a":1]}', '{"a":"\\u00e9 日本"}', '{"a":1}\n{"a":2}',
]


def python_says(text):
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def test_is_object_as_a_decoder_tells_it(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    got = {r.t: r.ok for r in d.select("t", is_object(d.t).alias("ok")).collect()}
    assert got == {t: python_says(t) for t in TEXTS} | {None: False}


@pytest.mark.parametrize("bad", ['{"a":1} tail', '{"a":2}{"a":3}', "[1]", '{"a":', "null", '{"a":1},{"a":2}'])
def test_table_refuses_a_line(spark, tmp_path, bad):
    (tmp_path / "t.jsonl").write_text('{"a":1,"b":{"c":"x"}}\n\n  \n' + bad + "\n")
    schema = StructType.fromDDL("a long, b struct<c:string>")
    with pytest.raises(Exception, match="not one JSON object|MALFORMED|FAILFAST|CANNOT_PARSE|parse"):
        tables.read_table(spark, str(tmp_path), schema).collect()
    assert [tuple(r) for r in tables.read_valid_prefix(spark, str(tmp_path), schema).collect()] == [(1, ("x",))]


def test_table_reads_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a":1,"b":{"c":"x"},"z":0}\n\n{"b":null,"a":2}\n')
    got = tables.read_table(spark, str(tmp_path), StructType.fromDDL("a long, b struct<c:string>")).collect()
    assert sorted(map(tuple, got)) == [(1, ("x",)), (2, None)]


def test_first_object(spark):
    says = {
        '{"a":1} tail': '{"a":1}', 'so {"a":"}"} it is': '{"a":"}"}', '{ not {"b":2} and {': '{"b":2}', 'x {"a":1} {"b":2}': '{"a":1}', "none": None, "{": None, None: None,
        '```json\n{"c": 3, "b": 1.50, "a": [0.25, "é"]}\n```': '{"a":[0.25,"é"],"b":1.5,"c":3}', '{"b": 0.25, "a": {"z": null, "y": true}}': '{"a":{"y":true,"z":null},"b":0.25}', '{"x": 1.0, "y": 1e-7}': '{"x":1.0,"y":1e-07}',
        'a } b { c {"d":[{}]}': '{"d":[{}]}',
    }
    d = spark.createDataFrame([(t,) for t in says], "t string")
    assert {r.t: r.o for r in d.select("t", responses.extract_json_object(d.t).alias("o")).collect()} == says


def test_each_type_in_each_field(spark):
    values = ['"p1"', "5", '["a"]', "1.5", "[1]", "null", "true", '"0.25"', "0.25", '"x"', '{"a":1}', '" 1 "', "2", "-1", '["a",null]', "[]", '""', '"1.0"', '"1.5"', '["a","b","c","d"]']
    whole = ("pair", "ris_code")
    bounds = {"eta_near": (0, 0.5), "eta_cpu": (0, 1), "confidence": (0, 1), "pair": (0, 1e18), "ris_code": (0, 1e18), "eta_haps": (0, 1), "aav_heading_rad": (-3.2, 3.2)}

    def number(v):
        if isinstance(v, str):
            try:
                v = float(v)
            except ValueError:
                return None
        return float(v) if isinstance(v, bool | int | float) else None

    def right(field, v):
        if field == "template_id":
            return isinstance(v, str) and 1 <= len(v) <= 64
        if field == "reason_codes":
            return isinstance(v, str) or isinstance(v, list) and len(v) <= 3 and all(isinstance(x, str) for x in v)
        if v is None:
            return field not in ("eta_near", "eta_cpu", "confidence")
        x = number(v)
        return x is not None and bounds[field][0] <= x <= bounds[field][1] and (field not in whole or x == int(x))

    rows, base = [], {"template_id": '"p1"', "eta_near": "0.1", "eta_cpu": "0.5"}
    for f in ("template_id", "reason_codes", *bounds):
        rows += [(f, v, "s", 1, '{"schema_version":1,"state_id":"s","candidates":[{' + ",".join(f'"{k}":{x}' for k, x in (base | {f: v}).items()) + "}]}") for v in values]
    d = spark.createDataFrame(rows, "f string, v string, state_id string, expected_candidates int, payload string")
    wrong = {(r.f, r.v): (r.valid, r.error) for r in te.validated(d).collect() if r.valid != right(r.f, json.loads(r.v))}
    assert not wrong


def test_whole_payloads(spark):
    good = '{"template_id":"p","eta_near":0.1,"eta_cpu":1}'
    says = {
        '{"schema_version":1,"state_id":"s","candidates":[' + good + "]}": None, '{"schema_version":"1","state_id":"s","candidates":[' + good + "]}": None,
        '{"schema_version":2,"state_id":"s","candidates":[' + good + "]}": "unsupported", '{"schema_version":1,"state_id":5,"candidates":[' + good + "]}": "state_id", '{"schema_version":1,"state_id":"s","candidates":"x"}': "no list",
        '{"schema_version":1,"state_id":"s","candidates":[5]}': "no object", '{"schema_version":1,"state_id":"s","candidates":[]}': "expected 1", "x": "no valid JSON", '{"schema_version":1,"state_id":"s","candidates":[' + good[:-1] + ',"more":1}]}': "unknown fields",
    }
    d = spark.createDataFrame([("s", 1, p) for p in says] + [("s", 1, None)], "state_id string, expected_candidates int, payload string")
    for r in te.validated(d).collect():
        want = says.get(r.payload, "no valid JSON")
        assert r.valid == (want is None) and (want is None or want in r.error), r


def test_routes(spark):
    good = '{"schema_version":1,"state_id":"s","candidates":[{"template_id":"p","eta_near":0.1,"eta_cpu":1}]}'
    rows = [("a", good, "ok", None, 10), ("b", good, "error", "timed out", 64), ("c", "x", "ok", None, None), ("d", None, "timeout", None, 99), ("e", good, None, None, 64)]
    d = spark.createDataFrame([("s", 1, *r) for r in rows], "state_id string, expected_candidates int, id string, payload string, call_status string, why string, completion_tokens int")
    requests, rejected = te.route(te.validated(d), call_error="why", max_tokens=64)
    got = {r.id: (r.status, r.schema_valid, r.candidates_returned, r.unique_candidates, r.truncated, r.error) for r in requests.collect()}
    assert got == {
        "a": ("ok", True, 1, 1, False, None), "b": ("error", False, 0, 0, True, "timed out"), "c": ("parse_error", False, 0, 0, False, "response contains no valid JSON object"),
        "d": ("timeout", False, 0, 0, True, "unknown teacher failure"), "e": ("ok", True, 1, 1, True, None),
    }
    assert sorted(r.rejection_reason for r in rejected.collect()) == ["response contains no valid JSON object", "timed out", "unknown teacher failure"]
    assert all((r.candidate_pool_count, r.verification_rollouts, r.selection_probability, r.equivalent_candidate_indices) == (0, 0, 0.0, []) for r in rejected.collect())


def test_templates_with_any_white_space(spark):
    t = spark.createDataFrame([("s", "p1_sense10w", 1, 0.25, 0.75)], "state_id string, template_id string, pair int, eta_haps double, eta_communication double")
    c = spark.createDataFrame([("s", i, x, x, [], 0, 0.0, 0.0) for i, x in enumerate(["\tp1_sense10w\n", " p1_sense10w", "p1_sense10w", " x "])], "state_id string, candidate_index int, template_id string, template_id_raw string, reason_codes array<string>, pair int, eta_haps double, eta_communication double")
    assert [r.resolved for r in te.resolve_template(c, t).orderBy("candidate_index").collect()] == ["p1_sense10w"] * 3 + [None]

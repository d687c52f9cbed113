"""Controls, responses, sources and streams against values worked out by hand."""

import json
from math import inf, nan

import pytest
from pyspark.sql import functions as F

from decisionlake.functions import control, freshness, links
from decisionlake.operators import audit, responses
from decisionlake.plans import catalog, controls  # noqa: F401  controls adds its queries to the catalog
from decisionlake.sources import tables
from decisionlake.streaming import streams


def test_valid_prefix(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":1}\n\n{"x":2}\n{"x":\n{"x":4}\n')
    (tmp_path / "b.jsonl").write_text('{"x":5}\n[6]\n{"x":7}\n')
    (tmp_path / "c.jsonl").write_text('{"x":8}\n{"x":9}')
    schema = spark.range(0).selectExpr("cast(id as long) as x").schema
    assert sorted(r.x for r in tables.read_valid_prefix(spark, str(tmp_path), schema).collect()) == [1, 2, 5, 8, 9]
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path), schema).collect()


def test_write_and_special_doubles(spark, tmp_path):
    d = spark.createDataFrame([(1, inf, [1.5, -inf], (2.0,))], "b int, a double, c array<double>, s struct<v: double>")
    out = str(tmp_path / "t")
    tables.write_table(tables.encode_special_doubles(d), out)
    line = spark.read.text(out).first().value
    assert json.loads(line) == {"a": "Infinity", "b": 1, "c": [1.5, "-Infinity"], "s": {"v": 2.0}} and line.startswith('{"a"')
    with pytest.raises(Exception):
        tables.encode_special_doubles(spark.createDataFrame([(nan,)], "a double")).collect()
    assert tables.flatten(d).columns == ["b", "a", "c", "s.v"]


def test_responses(spark):
    d = spark.createDataFrame([("<think> a </think> b ",), (" c ",), (None,)], "t string")
    answer, reasoning = responses.split_reasoning(F.col("t"))
    assert [tuple(r) for r in d.select(answer, reasoning).collect()] == [("b", "a"), ("c", None), (None, None)]
    d = spark.createDataFrame([('```json\n{ no {"b": 1, "a": {"c": 2}} rest\n```',), ("none {",), ("",), (None,)], "t string")
    got = [r[0] for r in d.select(responses.extract_json_object(F.col("t"))).collect()]
    assert got == ['{"a":{"c":2},"b":1}', None, None, None]


def test_controls(spark):
    names = ["pair", *control.BOUNDS]
    d = spark.createDataFrame([(9.0, 2.0, -1.0, 0.7, 0.5, 4.0, 0.5, 0.5)], ", ".join(f"{n} double" for n in names))
    r = control.clip_action(d, 4).first()
    assert (r.pair, r.eta_haps, r.eta_communication, r.eta_near) == (-1, 1.0, 0.0, 0.5) and r.heading == pytest.approx(3.141592653589793)
    both = control.clip_action(d.withColumn("before", F.struct(*names)), 4).withColumn("after", F.struct(*names))
    want = (10 / 4 + 1 + 1 + 0.4 + (4 - 3.141592653589793) / 3.141592653589793) / 8
    assert both.select(control.repair_distance("before", "after", 4)).first()[0] == pytest.approx(want)
    assert d.select(control.thermal_noise_watts(F.lit(1.0))).first()[0] == pytest.approx(10 ** -20.4)
    with pytest.raises(Exception):
        d.select(control.linear_to_db(F.lit(-1.0))).collect()
    gain = d.select(links.beam_gain(*[F.array(*map(F.lit, x)) for x in ([1.0, 0.0], [0.0, 1.0], [2.0, 1.0], [0.0, 1.0])])).first()[0]
    assert gain == pytest.approx(abs(1 * (2 + 0j) + (0 - 1j) * (1 + 1j)) ** 2)


def test_sensing_age(spark):
    log = spark.createDataFrame([("u", 1, None), ("u", 2, 0), ("u", 3, None), ("u", 4, 4)], "entity string, slot int, accepted int")
    assert [r.age for r in freshness.sensing_age(log, "accepted", 4, 2).orderBy("slot").collect()] == [3, 2, 3, 1]


def test_targets(spark):
    rows = [(None,), ([],), ([(0, 1.0)],), ([(0, 0.5), (0, 0.5)],), ([(0, 0.6), (1, 0.5)],), ([(0, nan)],), ([(0, None)],), ([(0, -0.5), (1, 1.5)],)]
    d = spark.createDataFrame(rows, "t array<struct<index: int, weight: double>>")
    assert [r[0] for r in d.select(audit.targets_valid("t")).collect()] == [True, False, True, False, False, False, False, False]


def test_registered_streams_over_many_files(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,id) as ts, id div 24 as user_id, if(id % 5 = 0, 'error', 'view') as event_type, cast(id as double) as value from range(720)").createOrReplaceTempView("e")
    events = spark.table("e")
    events.repartition(40, "value").write.parquet(str(tmp_path / "many" / "events.parquet"))
    events.coalesce(1).write.parquet(str(tmp_path / "one" / "events.parquet"))
    assert len(list((tmp_path / "many" / "events.parquet").glob("*.parquet"))) > 16
    for name in ("st2_windows", "st3_sessions", "st4_distinct_keys", "st5_rates"):
        many, one = (sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path / k)).collect())) for k in ("many", "one"))
        assert many == one, name
    st5 = catalog.QUERIES["st5_rates"](spark, str(tmp_path / "many")).collect()
    assert sum(r.n for r in st5) == 720 and sum(r.n for r in catalog.QUERIES["st2_windows"](spark, str(tmp_path / "many")).collect()) == 3 * 720
    assert catalog.QUERIES["st4_distinct_keys"](spark, str(tmp_path / "many")).count() == 60
    assert catalog.QUERIES["st3_sessions"](spark, str(tmp_path / "many")).count() == 30  # the last one too


def test_stream_over_several_batches(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id % 3 as k, cast(id as double) as v from range(300)").repartition(5).write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    stream = streams.stream_table(spark, str(tmp_path / "e"), schema, files=1)
    out = streams.drain(streams.windows(stream, ["k"], "v", "1 hour", late="10 hours"), ["start", "k"], "t").collect()
    assert sum(r.n for r in out) == 300 and len(out) == 15 and max(r.top for r in out) == 299
    keys = streams.drain(streams.distinct_keys(stream, ["k"], "10 hours").select("k"), ["k"], "t").collect()
    assert sorted(r.k for r in keys) == [0, 1, 2]

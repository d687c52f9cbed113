"""Scans in blocks against loops, on one long entity among short ones."""

import random

import pytest
from pyspark.sql import functions as F

from decisionlake.functions import freshness, scan


@pytest.fixture(params=[(8, 16), (256, 4096)])
def log(spark, request, monkeypatch):
    monkeypatch.setattr(scan, "FOLD", request.param[0])
    monkeypatch.setattr(scan, "BLOCK", request.param[1])
    r = random.Random(9)
    rows = [(e, slot, r.random() < 0.1, r.normalvariate(0, 1), slot - r.randrange(3) if r.random() < 0.2 else None) for e, n in (("hot", 700), ("short", 3), (None, 40)) for slot in range(1, n + 1) if e != "short" or slot != 2]
    return rows, spark.createDataFrame(rows, "entity string, slot long, event boolean, increment double, accepted long").repartition(6)


def loop(rows, step, start):
    out, state = {}, {}
    for e, slot, *rest in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state[e] = step(state.get(e, start), slot, *rest)
        out[e, slot] = state[e]
    return out


def got(df, name):
    rows = df.collect()
    out = {(r.entity, r.slot): r[name] for r in rows}
    assert len(out) == len(rows)
    return out


def test_queue(log):
    rows, d = log
    want = loop(rows, lambda q, slot, event, g, acc: min(2.5, max(0.0, q + g)), 0.0)
    assert got(freshness.virtual_queue(d, 2.5), "queue") == pytest.approx(want)


def test_ages(log):
    rows, d = log
    last = loop(rows, lambda at, slot, event, g, acc: slot if event else at, None)
    assert got(freshness.age(d, "event", 9, 4), "age") == {k: min(9, 4 + k[1] if v is None else 1 + k[1] - v) for k, v in last.items()}
    assert got(freshness.waiting(d, "event", 9), "waiting") == {k: min(9, k[1] - (v or 0)) for k, v in last.items()}
    seen = loop(rows, lambda at, slot, event, g, acc: (slot, max(1, slot - acc)) if acc is not None else at, None)
    assert got(freshness.sensing_age(d, "accepted", 9, 4), "age") == {k: min(9, 4 + k[1] if v is None else min(v[1], 9) + k[1] - v[0]) for k, v in seen.items()}


def test_availability(spark, log):
    rows, d = log
    jobs = [(e, slot, slot + 1 + slot % 5, float(slot % 7)) for e, slot, event, *_ in rows if event] + [("hot", 3, 50, 1.0), ("hot", 3, 50, 0.5)]
    j = spark.createDataFrame(jobs, "entity string, timestamp long, ready_slot long, trace double")
    have = got(freshness.sensing_availability(d, j).withColumn("t", F.col("available.timestamp")), "t")
    for (e, slot), t in have.items():
        assert t == max((x[1] for x in jobs if x[0] == e and x[2] <= slot), default=None)


def test_prefix_of_any_step(spark, log):
    rows, d = log
    text = scan.prefix(d.withColumn("x", F.concat(F.lit(","), F.col("slot").cast("string"))), ["entity"], "slot", "x", "concat({a}, {b})", "''")
    want = loop(rows, lambda t, slot, *_: t + "," + str(slot), "")
    assert {k: v + "," + str(k[1]) for k, v in got(text, "_before").items()} == want


def test_nothing(spark):
    d = spark.createDataFrame([], "entity string, slot long, event boolean, increment double")
    assert freshness.age(d, "event", 9, 4).count() == 0 and freshness.virtual_queue(d, 1.0).count() == 0

"""Quantiles by brackets against percentile()."""

import random

import pytest
from pyspark.sql import functions as F

from decisionlake.operators import quantiles as q


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(q, "HELD", 20)
    monkeypatch.setattr(q, "STEPS", 64)


def same(spark, rows, by, wanted):
    d = spark.createDataFrame(rows, "g string, h int, x double, y int").repartition(5)
    exact = [q.Exact(f"q{i}", v, p) for i, (v, p) in enumerate(wanted)]
    got = q.aggregate(d, by, F.count("*").alias("n"), *exact, F.max("h").alias("top"))
    want = d.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile(F.expr(v), p).alias(f"q{i}") for i, (v, p) in enumerate(wanted)), F.max("h").alias("top"))
    assert got.columns == want.columns
    key = lambda r: repr([r[c] for c in by])
    a, b = (sorted(x.collect(), key=key) for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, nan_ok=True) if all(isinstance(v, float) for v in x) else [v if not isinstance(v, float) else pytest.approx(v, nan_ok=True) for v in y] == list(x)


WANTED = [("x", 0.0), ("x", 0.05), ("x", 0.5), ("x", 0.95), ("x", 1.0), ("y * 2", 0.3)]


def test_equal_to_percentile(spark, narrow):
    r = random.Random(5)
    rows = [("a", i, r.lognormvariate(0, 3), i) for i in range(3000)]
    rows += [(None, 0, float(r.randrange(3)), r.randrange(5)) for _ in range(1000)]  # ties only
    rows += [("half", 0, 1.0 if i < 500 else 2.0, 7) for i in range(1000)] + [("one", 0, 4.5, None), ("none", 0, None, None), ("none", 1, None, 3)]
    rows += [("mixed", 0, None if i % 3 else float(i % 50), i if i % 2 else None) for i in range(2000)]
    same(spark, rows, ["g"], WANTED)
    same(spark, rows, [], WANTED)
    same(spark, rows, ["g", "y"], WANTED[:3])


def test_special_values(spark, narrow):
    rows = [("a", 0, v, 1) for v in [float("inf"), float("-inf"), float("nan"), 0.0, -0.0] for _ in range(40)]
    same(spark, rows, ["g"], [("x", 0.1), ("x", 0.5), ("x", 0.99)])


def test_small_groups_and_nothing(spark):
    same(spark, [("a", 0, 1.0, 1), ("a", 0, 2.0, 2), ("b", 0, 9.0, None)], ["g"], WANTED)
    same(spark, [], ["g"], WANTED[:2])
    same(spark, [], [], WANTED[:2])
    d = spark.createDataFrame([("a", None)], "g string, x double")
    r = q.aggregate(d, [], q.Exact("p", "x", 0.5, 3, 0.0)).first()
    assert r.p == 0.0


def test_many_passes_hold_few_values(spark, monkeypatch):
    monkeypatch.setattr(q, "HELD", 3)
    monkeypatch.setattr(q, "STEPS", 32)
    same(spark, [("a", i, float(i * i % 4999), i) for i in range(5000)], ["g"], [("x", 0.5), ("x", 0.9)])

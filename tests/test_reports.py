"""Evaluation operators against values worked out by hand or by NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from decisionlake.operators import evaluation as ev, report


def test_extrapolate_equals_repeated_steps(spark):
    dt, acceleration = 0.5, 1.5
    step = np.array([[1, dt], [0, 1]])
    noise = acceleration**2 * np.outer([dt**2 / 2, dt], [dt**2 / 2, dt])
    mean, cov = np.array([3.0, -2.0]), np.array([[4.0, 0.5], [0.5, 2.0]])
    for n in range(5):
        got = spark.range(1).select(*ev.extrapolate(*map(F.lit, (3.0, -2.0, 4.0, 0.5, 2.0, float(n))), dt, acceleration)).first()
        assert (got.x, got.v, got.pxx, got.pxv, got.pvv) == pytest.approx((*mean, cov[0, 0], cov[0, 1], cov[1, 1]))
        mean, cov = step @ mean, step @ cov @ step.T + noise


def test_nearest_template(spark):
    offered = spark.createDataFrame([("s", "p1_sense2w"), ("s", "p1_sense10w"), ("s", "p2_sense18w")], "state_id string, template_id string")
    asked = [(0, "s", "P1-Sense6W"), (1, "s", "p1_sense18w"), (2, "s", "p1_sense100w"), (3, "s", "p9_sense2w"), (4, "t", "p1_sense2w"), (5, "s", None), (6, "s", "sense")]
    got = ev.nearest_template(spark.createDataFrame(asked, "k int, state_id string, template_id string"), offered).orderBy("k").collect()
    assert [r.resolved for r in got] == ["p1_sense10w", "p1_sense10w", None, None, None, None, None]


def test_gates_and_status(spark):
    m = spark.createDataFrame([("candidate_fallback_rate", 0.05), ("candidate_unique_ratio", 0.5)], "metric string, value double")
    got = {r.metric: r.passed for r in report.all_gates(m).collect()}
    assert got["candidate_fallback_rate"] and not got["candidate_unique_ratio"] and not got["request_schema_valid_rate"] and len(got) == len(ev.GATES)
    d = spark.createDataFrame([("decisive", True), (None, False), ("odd", None)], "s string, u boolean")
    assert [r[0] for r in d.select(ev.decision_status("s", "u")).collect()] == ["decisive", "decisive", "unresolved"]

"""Quality report: rates, diversity, distributions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake.operators.quantiles import Exact, aggregate

def _rate(condition: str, name: str):
    return F.round(F.avg(F.expr(f"cast({condition} as double)")), 6).alias(name)


def candidate_summary(candidates: DataFrame, selected: str | None = None, parts: tuple[str, ...] = ("all", "source", "bucket", "selected")) -> DataFrame:
    """Rates and distances in all, by source and by confidence bucket (QR1, QR2), and with
    ``selected``, a condition, of the candidates that it holds for; ``part`` tells which.
    ``parts`` are those that are asked for."""
    bucket = F.expr("case when teacher_confidence < 0.5D then 'low' when teacher_confidence < 0.8D then 'medium' else 'high' end")
    none = F.lit(None).cast("string")
    sets = [("all", none, none), ("source", F.col("candidate_source"), none), ("bucket", none, bucket), *([("selected", none, none)] if selected else [])]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("part"), s.alias("s"), b.alias("b")) for name, s, b in sets if name in parts)))
    d = candidates.withColumn("_set", each).withColumns({"part": F.col("_set.part"), "candidate_source": F.col("_set.s"), "bucket": F.col("_set.b")}).drop("_set")
    return aggregate(
        d.where(f"part <> 'selected' or ({selected})") if selected else d, ["part", "candidate_source", "bucket"],
        F.count("*").alias("n"), _rate("pre_repair_feasible", "pre_feasible"), _rate("hard_feasible", "feasible"), _rate("fallback_used", "fallback"), _rate("repair_distance > 1e-12D", "repaired"),
        F.round(F.avg("repair_distance"), 9).alias("mean_distance"), Exact("p95_distance", "repair_distance", 0.95, 6),
    )


def action_diversity(candidates: DataFrame, key: Column) -> DataFrame:
    """Distinct actions (by a key) to candidates, over states (QR3)."""
    each = candidates.groupBy("state_id").agg((F.count_distinct(key) / F.count("*")).alias("r"))
    return each.agg(F.count("*").alias("states"), F.round(F.avg("r"), 8).alias("mean_ratio"), F.sum(F.when(F.col("r") < 0.75, 1).otherwise(0)).alias("below"))


def role_compliance(candidates: DataFrame) -> DataFrame:
    """Share of states with exactly one sensing-only candidate (QR4)."""
    each = candidates.groupBy("state_id").agg(F.count_if(F.col("pair") == 0).alias("k"))
    return each.agg(_rate("k = 1", "compliance"))


def action_field_changes(candidates: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """How repair changed each control, told by its proposed and executed columns (QR5)."""
    stack = ", ".join(f"'{name}', cast(abs({done} - {own}) as double)" for name, (own, done) in fields.items())
    d = candidates.selectExpr(f"stack({len(fields)}, {stack}) as (field, x)")
    return aggregate(
        d, ["field"], F.count("*").alias("n"), F.count_if(F.col("x") > 1e-12).alias("changed"), F.round(F.avg((F.col("x") > 1e-12).cast("double")), 8).alias("rate"),
        F.round(F.avg("x"), 8).alias("mean_change"), Exact("p95_change", "x", 0.95, 8),
    )


def distribution_error(df: DataFrame, column: str, target: Mapping[str, float]) -> DataFrame:
    """Observed against wanted shares of each label, either side's labels (QR6)."""
    want = df.sparkSession.createDataFrame(sorted(target.items()), "label string, target double")
    have = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    have = have.withColumn("total", F.sum("n").over(_all()))
    d = have.join(want, "label", "full").withColumns({"n": F.coalesce("n", F.lit(0)), "share": F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))})
    return d.select("label", "n", F.round("share", 8).alias("actual"), "target", F.round(F.abs(F.col("share") - F.col("target")), 8).alias("error"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # over a row a label


def duplicate_rate(states: DataFrame) -> DataFrame:
    """Repeats of a state hash to states (QR9)."""
    return states.groupBy("causal_state_hash").agg(F.count("*").alias("n")).agg(F.round(F.sum(F.col("n") - 1) / F.sum("n"), 8).alias("duplicate_rate"))


def repair_reasons(candidates: DataFrame) -> DataFrame:
    """How often each reason occurs, its rate per candidate, and its place by frequency (QR12)."""
    d = candidates.select(F.explode("repair_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    d = d.crossJoin(F.broadcast(candidates.agg(F.count("*").alias("_all"))))  # one row
    return d.selectExpr("reason", "n", "round(n / _all, 8) as rate", "cast(row_number() over (order by n desc, reason) as bigint) as place")  # a row a reason


def latency_report(requests: DataFrame) -> DataFrame:
    return aggregate(
        requests, [], F.round(F.avg("latency_s"), 6).alias("mean_latency"), Exact("p95_latency", "latency_s", 0.95, 6), F.round(F.avg("completion_tokens"), 6).alias("mean_tokens")
    )


def difficulty_cube(states: DataFrame, axes: list[str], metrics: list[str]) -> DataFrame:
    """Means of metrics by all axes, with subtotals (QR19)."""
    return states.cube(*axes).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def template_resolution(candidates: DataFrame) -> DataFrame:
    """Candidates, their share and how many comply, by how their template was found, and in all (QR14)."""
    d = candidates.groupingSets([[], ["template_resolution"]], "template_resolution").agg(F.count("*").alias("n"), F.round(F.avg(F.col("template_compliant").cast("double")), 8).alias("compliance"))
    return d.withColumn("share", F.round(F.col("n") / F.max("n").over(_all()), 8))


def target_shape(targets: DataFrame) -> DataFrame:
    """Mean number of targets, none counting as one, how many are valid, and their mean entropy (QR16)."""
    from decisionlake.operators.audit import targets_valid

    size = F.when(F.col("targets").isNull(), 1).otherwise(F.size("targets"))
    return targets.agg(F.count("*").alias("n"), F.avg(size).alias("mean_targets"), F.count_if(targets_valid("targets")).alias("valid"), F.avg("target_entropy").alias("mean_entropy"))

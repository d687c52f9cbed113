"""Training batches and evaluation of methods over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake.operators.quantiles import Exact, aggregate
from decisionlake.operators.sampling import global_rank

#: Two-sided 95 % quantiles of Student's t by degrees of freedom (fixed values).
STUDENT = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056,
    2.052, 2.048, 2.045, 2.042,
]


def training_batches(df: DataFrame, size: int, seed: int) -> DataFrame:
    """Consecutive batches in a seeded hash order; the last one partial (TD2)."""
    ranked = global_rank(df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("state_id")), 256)), "_h")
    return ranked.withColumn("batch", F.floor(F.col("rank") / size)).drop("_h")


def split_counts(df: DataFrame, wanted: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Rows of each split; one of the wanted splits without a row is an error (TD8)."""
    want = df.sparkSession.createDataFrame([(w,) for w in wanted], "split string")
    d = want.join(df.groupBy("split").agg(F.count("*").alias("n")), "split", "full")
    return d.select("split", F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no rows in split "), "split"))).otherwise(F.col("n")).alias("n"))


def student(freedom: Column) -> Column:
    """The quantile of STUDENT; beyond its last, interpolated in 1 / freedom to the normal's."""
    table = F.array(*map(F.lit, STUDENT))
    tail = F.lit(1.96) + (STUDENT[-1] - 1.96) * len(STUDENT) / freedom
    return F.when(freedom <= len(STUDENT), F.get(table, (freedom - 1).cast("int"))).otherwise(tail)


def seed_means_ci(results: DataFrame) -> DataFrame:
    """Mean over independent seeds with its 95 % half width, median and the worst
    twentieth (EV1)."""
    each = results.groupBy("method", "seed").agg(F.avg("cost").alias("m"))
    d = aggregate(each, ["method"], F.count("*").alias("seeds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), Exact("median", "m", 0.5), Exact("tail", "m", 0.95))
    t = student(F.col("seeds") - 1)
    return d.select("method", "seeds", F.round("mean", 4).alias("mean"), F.round(t * F.col("sd") / F.sqrt("seeds"), 4).alias("half_width"), F.round("median", 4).alias("median"), F.round("tail", 4).alias("tail"))


def paired_comparison(results: DataFrame, one: str, two: str) -> DataFrame:
    """Difference of two methods on common scenarios: a mean for each seed, and over the
    seeds its mean, 95 % half width and win rate (EV2)."""
    each = results.where(F.col("method").isin(one, two)).groupBy("seed", "scenario").agg(
        F.avg(F.when(F.col("method") == one, F.col("cost"))).alias("x"), F.avg(F.when(F.col("method") == two, F.col("cost"))).alias("y")
    ).where("x is not null and y is not null")
    by_seed = each.groupBy("seed").agg(F.avg(F.col("x") - F.col("y")).alias("gap"), F.avg((F.col("x") < F.col("y")).cast("double")).alias("win"))
    d = by_seed.agg(F.count("*").alias("seeds"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("sd"), F.avg("win").alias("w"))
    half = student(F.col("seeds") - 1) * F.col("sd") / F.sqrt("seeds")
    return d.select("seeds", F.round("m", 4).alias("mean_gap"), F.round(half, 4).alias("half_width"), F.round("w", 6).alias("win_rate"))


def fifth_percentile_rate(results: DataFrame) -> DataFrame:
    return aggregate(results, ["method", "seed"], F.round(F.sum("rate"), 2).alias("sum_rate"), Exact("p05_rate", "rate", 0.05, 2))


def continuous_targets(actions: DataFrame) -> DataFrame:
    """The seven controls as targets from -1 to 1; a value that is not finite is an error (TD5)."""
    from math import pi

    from decisionlake.functions.control import BOUNDS, clip

    def target(c: str):
        x = F.col(c).cast("double")
        scaled = x * {"eta_near": 2.0, "heading": 1 / pi}.get(c, 1.0)
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{c} must be finite"))).otherwise(clip(scaled, -1.0, 1.0))

    return actions.withColumns({c: target(c) for c in BOUNDS})


def head_size(df: DataFrame, label: str) -> DataFrame:
    """Classes a head needs: its largest label and one (TD7)."""
    return df.agg((F.max(label) + 1).cast("long").alias("classes"))


def latency_percentiles(requests: DataFrame, deadline: float) -> DataFrame:
    """Median, 95 % quantile, share beyond the deadline and tokens a second, by teacher (EV3)."""
    return aggregate(
        requests, ["teacher_label"], Exact("p50", "latency_s", 0.5, 6), Exact("p95", "latency_s", 0.95, 6),
        F.round(F.avg((F.col("latency_s") > deadline).cast("double")), 6).alias("missed"),
        F.round(F.sum(F.when(F.col("latency_s") > 0, F.coalesce("completion_tokens", F.lit(0)))) / F.sum("latency_s"), 6).alias("tokens_per_s"),
    )


def active_query_ranking(states: DataFrame, weights: dict[str, float], n: int) -> DataFrame:
    """The n states most worth asking about, ties by state (EV5); a top-k report. Each of
    the criteria (columns) adds its weight times its value; a null adds nothing."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return states.select("state_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "state_id").limit(n)


def demonstrations(df: DataFrame, split: str | None = None) -> DataFrame:
    """The demonstrations of a split, all where none is named (TD1)."""
    return df if split is None else df.where(F.col("split") == split)


def pad_targets(df: DataFrame, action: str = "selected_action") -> DataFrame:
    """df (batch, targets: array of weight and action, selected_action) with targets of one
    length a batch (TD3): its longest, filled up with nothing; ``target_mask`` says what is
    there. Without targets the selected action is the only one, with weight 1."""
    own = F.array(F.struct(F.lit(1.0).alias("weight"), F.col(action).alias("action")))
    t = F.when(F.coalesce(F.size("targets"), F.lit(0)) > 0, F.transform("targets", lambda x: F.struct(x["weight"].cast("double").alias("weight"), x["action"].alias("action")))).otherwise(own)
    longest = df.select("batch", F.size(t).alias("_n")).groupBy("batch").agg(F.max("_n").alias("_longest"))
    d = df.withColumn("_t", t).join(longest, "batch")
    gap = F.col("_longest") - F.size("_t")
    nothing = {"int": F.lit(0), "bigint": F.lit(0).cast("long"), "double": F.lit(0.0)}
    fields = df.schema[action].dataType.fields

    def of(name: str):
        return F.transform("_t", lambda x: x["action"][name])

    return d.select(
        *(c for c in df.columns if c != "targets"), F.concat(F.transform("_t", lambda x: x["weight"]), F.array_repeat(F.lit(0.0), gap)).alias("target_weight"),
        *(F.concat(of(f.name), F.array_repeat(nothing[f.dataType.simpleString()], gap)).alias(f"target_{f.name}") for f in fields),
        F.concat(F.transform("_t", lambda x: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("target_mask"),
    )


def auxiliary_targets(df: DataFrame, constraints: int) -> DataFrame:
    """df with value, constraint and weight targets (TD6): the value or else the verifier's
    score, 0 where not finite; constraints from 0 to 1 with a mask, of another length or
    not finite an error; the quality weight from 0.001 to 1."""
    x = F.coalesce("value_target", "verifier_score", F.lit(0.0))
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    c = F.col("constraint_targets")
    wrong = (F.size(c) != constraints) | F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clipped = F.when(wrong, F.raise_error(F.lit("constraint targets must be finite and as many as the head has"))).otherwise(F.transform(c, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))))
    return df.withColumns({
        "value": F.when(finite, x).otherwise(0.0), "constraint_target": F.when(c.isNull(), F.array_repeat(F.lit(0.0), constraints)).otherwise(clipped), "constraint_mask": F.when(c.isNull(), 0).otherwise(1),
        "weight": F.greatest(F.lit(1e-3), F.least(F.lit(1.0), F.coalesce("quality_weight", F.lit(1.0)))),
    })

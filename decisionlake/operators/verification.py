"""From rollouts to weighted demonstrations. Everything is keyed by state_id."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake.operators import bootstrap


@dataclass(frozen=True)
class Settings:
    """Weights and limits of the verification (fixed values)."""

    cvar_alpha: float = 0.90
    cvar_weight: float = 0.25
    constraint_weight: float = 2.0
    repair_weight: float = 0.25
    fallback_weight: float = 2.0
    infeasible_weight: float = 1000.0
    temperature: float = 0.10
    margin: float = 0.01
    shortlist: int = 3
    discount: float = 0.995
    horizon: int = 32
    resamples: int = 2000
    confidence: float = 0.95
    batch: int = 8
    cap: int = 64


DEFAULT = Settings()


def quantile(sorted_values: str, p: float) -> Column:
    """Quantile, linearly interpolated, of a sorted array column."""
    at = f"({p}D * (size({sorted_values}) - 1))"
    low, high = f"get({sorted_values}, cast(floor({at}) as int))", f"get({sorted_values}, cast(ceil({at}) as int))"
    return F.expr(f"{low} + ({high} - {low}) * ({at} - floor({at}))")


def reduce_steps(steps: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Step log (step, cost, mean_aoi, delivered, outages, users, queue, energy, violation,
    repair, fallback, feasible, terminated) to a rollout row (VE1); steps beyond the horizon
    or after a termination drop out."""
    first = F.min(F.when(F.col("terminated"), F.col("step"))).over(_over(keys))
    d = steps.withColumn("_end", first).where(f"step < {s.horizon} and (_end is null or step <= _end)")
    g = F.pow(F.lit(s.discount), "step")
    return d.groupBy(*keys).agg(
        F.count("*").alias("steps"), (F.sum(g * F.col("cost")) / F.sum(g)).alias("discounted_cost"), F.avg("cost").alias("mean_cost"), F.max("mean_aoi").alias("max_mean_aoi"), F.sum("energy").alias("energy"),
        F.max("queue").alias("max_queue"), (F.sum("delivered") / F.sum("users")).alias("delivery_rate"), (F.sum("outages") / F.sum("users")).alias("outage_rate"), F.avg("violation").alias("mean_constraint_violation"),
        F.avg("repair").alias("mean_repair_distance"), F.avg(F.col("fallback").cast("double")).alias("fallback_rate"), F.bool_and("feasible").alias("hard_feasible"),
    )


def _over(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def summarize_rollouts(rollouts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A row a candidate: moments, quantiles, tail mean and risk (VE2 to VE4). One
    shuffle by state; a candidate's costs, at most s.cap, are sorted once in an array."""
    d = rollouts.repartition("state_id").groupBy("state_id", "candidate_index").agg(
        F.sort_array(F.collect_list("discounted_cost")).alias("_c"), F.count("*").alias("rollouts"),
        F.avg("discounted_cost").alias("mean_cost"), F.coalesce(F.stddev_samp("discounted_cost"), F.lit(0.0)).alias("std_cost"),
        F.avg(F.col("hard_feasible").cast("double")).alias("feasible_probability"), F.avg("mean_constraint_violation").alias("violation"),
        F.avg("mean_repair_distance").alias("repair"), F.avg("fallback_rate").alias("fallback"), F.first("candidate_source").alias("candidate_source"),
    )
    d = d.withColumns({
        "standard_error": F.col("std_cost") / F.sqrt("rollouts"), "median_cost": quantile("_c", 0.5), "p05_cost": quantile("_c", 0.05),
        "p10_cost": quantile("_c", 0.10), "p90_cost": quantile("_c", 0.90), "p95_cost": quantile("_c", 0.95), "max_cost": F.array_max("_c"), "_q": quantile("_c", s.cvar_alpha),
    })
    d = d.withColumn("cvar_cost", F.expr("aggregate(filter(_c, x -> x >= _q), 0D, (a, x) -> a + x) / size(filter(_c, x -> x >= _q))")).drop("_c", "_q")
    return d.withColumn("risk", risk_score(s))


def risk_score(s: Settings = DEFAULT) -> Column:
    """Mean plus weighted tail excess, violation, repair, fallback and infeasibility (VE4)."""
    return F.expr(
        f"mean_cost + {s.cvar_weight}D * (cvar_cost - mean_cost) + {s.constraint_weight}D * violation + {s.repair_weight}D * repair"
        f" + {s.fallback_weight}D * fallback + {s.infeasible_weight}D * (1 - feasible_probability)"
    )


def preliminary_score(s: Settings = DEFAULT) -> Column:
    """Score of a candidate after one step (VE5)."""
    return F.expr(
        f"one_step_stage_cost + {s.constraint_weight}D * one_step_constraint_violation + {s.repair_weight}D * repair_distance"
        f" + {s.fallback_weight}D * cast(fallback_used as double) + {s.infeasible_weight}D * cast(not hard_feasible as double)"
    )


def shortlist(candidates: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The best few of each state by preliminary score, and its greedy ones (VE6)."""
    d = candidates.withColumn("preliminary_score", preliminary_score(s))
    d = d.selectExpr("*", "row_number() over (partition by state_id order by preliminary_score, candidate_index) as _rn")
    return d.where(f"_rn <= {s.shortlist} or candidate_source = 'greedy_baseline'").drop("_rn")


def rank_candidates(summary: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rank from 1, quality weight, membership of the equivalent set, margin to the
    second (VE7 to VE10), by windows of one partitioning."""
    d = summary.selectExpr(
        "*", "row_number() over (partition by state_id order by feasible_probability < 1, risk, repair, candidate_index) as rank",
        "min(risk) over (partition by state_id) as _least",
    )
    d = d.withColumn("_e", F.expr(f"exp(greatest(-700D, (_least - risk) / {s.temperature}D))"))
    return d.selectExpr(
        "*", "_e / sum(_e) over (partition by state_id) as quality_weight",
        f"risk - first_value(risk) over (partition by state_id order by rank) <= {s.margin}D + 1e-12D as equivalent",
        "coalesce(lead(risk) over (partition by state_id order by rank) - risk, double('infinity')) as score_margin",
    ).drop("_least", "_e")


def select(ranked: DataFrame) -> DataFrame:
    """One row a state: the winner, its margin and the equivalent set (VE13)."""
    return ranked.groupBy("state_id").agg(
        F.min_by("candidate_index", "rank").alias("selected_index"), F.min_by("candidate_source", "rank").alias("selected_source"),
        F.min_by("risk", "rank").alias("risk"), F.min_by("score_margin", "rank").alias("score_margin"), F.min_by("quality_weight", "rank").alias("quality_weight"),
        F.min("rollouts").alias("rollouts"), F.count("*").alias("verified"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("equivalent"), F.struct("rank", "candidate_index")))), lambda x: x["candidate_index"]).alias("equivalent_indices"),
    )


def decision_status(selected: DataFrame) -> DataFrame:
    """Decisive, practically equivalent or unresolved (VE12), with the interval, the
    probability and the margin over its standard error. A state with one candidate is
    decisive: margin, interval and standardised margin are infinite, the probability is 1;
    so is a standardised margin without any error."""
    alone = F.col("verified") == 1
    endless = F.lit(float("inf"))
    d = selected.withColumns({c: F.when(alone, endless).otherwise(F.col(c)) for c in ("score_margin", "confidence_low", "confidence_high")})
    ratio = F.when(F.col("standard_error") > 0, F.col("score_margin") / F.col("standard_error")).otherwise(endless) if "standard_error" in selected.columns else F.lit(None).cast("double")
    d = d.withColumn("standardized_margin", F.when(alone, endless).otherwise(ratio))
    if "probability" in selected.columns:
        d = d.withColumn("probability", F.when(alone, 1.0).otherwise(F.col("probability")))
    status = F.when(alone, "decisive").when(F.size("equivalent_indices") > 1, "practically_equivalent").when(F.col("confidence_low") > 0, "decisive").otherwise("unresolved")
    return d.withColumn("decision_status", status).withColumn("uncertain", F.coalesce(F.col("confidence_low") <= 0, F.lit(False)))


def source_counts(candidates: DataFrame) -> DataFrame:
    """Of each state a map of its pool's candidates by source (VE13)."""
    each = candidates.groupBy("state_id", "candidate_source").agg(F.count("*").alias("_n"))
    return each.groupBy("state_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("candidate_source", "_n")))).alias("candidate_source_counts"))  # the few sources of a pool


def select_with_confidence(ranked: DataFrame, rollouts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row a state with everything a selection says (VE13): the winner, the margin's
    interval and probability, the equivalent set, the status, and counts by source."""
    d = decision_status(select(ranked).join(paired_bootstrap(rollouts, ranked, s), "state_id", "left"))
    return d.join(source_counts(ranked), "state_id", "left")


def paired_bootstrap(rollouts: DataFrame, ranked: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Confidence interval of the risk margin between ranks 1 and 2 over common seeds
    (VE11): the same resampled rollouts for both, the whole risk again each time.

    rollouts has rollout_seed; the two candidates' seeds must agree one by one in order of
    rollout_index, else it is an error. The generator is seeded by the pair's indices and
    seeds. A state with one candidate gives no row. A state's rollouts, s.cap at most for
    each candidate, come as one row; a task works out many states from one batch at a time
    (bootstrap.intervals)."""
    pair = ranked.where("rank <= 2").groupBy("state_id").agg(*(F.max(F.when(F.col("rank") == k, F.col("candidate_index"))).alias(f"{name}_index") for k, name in ((1, "one"), (2, "two")))).where("two_index is not null")
    item = F.struct("rollout_index", "rollout_seed", "discounted_cost", "mean_constraint_violation", "mean_repair_distance", "fallback_rate", F.col("hard_feasible").cast("double").alias("feasible"))
    d = rollouts.join(pair.hint("merge"), "state_id").where("candidate_index in (one_index, two_index)").groupBy("state_id", "one_index", "two_index").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("candidate_index") == F.col(f"{name}_index"), item))).alias(name) for name in ("one", "two")),
    ).where("size(two) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            n, (one, two) = batch.num_rows, (bootstrap.rolls(batch.column(c)) for c in ("one", "two"))
            if not (one.counts == two.counts).all() or not one.counts.all() or (one.seeds != two.seeds).any():
                raise ValueError("the rollouts of a state's candidates must have common seeds")
            generators = []
            for i, j, start, count in zip(batch.column("one_index").to_pylist(), batch.column("two_index").to_pylist(), one.starts, one.counts):
                said = f"{i}:{j}:" + ",".join(map(str, one.seeds[start:start + count].tolist()))
                generators.append(int.from_bytes(hashlib.sha256(said.encode()).digest()[:8], "big"))
            told = np.empty((n, 4))
            for count in np.unique(one.counts).tolist():
                at = np.flatnonzero(one.counts == count)
                told[at] = bootstrap.intervals(one.of(at, count), two.of(at, count), [generators[k] for k in at], s)
            yield pa.RecordBatch.from_arrays([batch.column("state_id"), *(pa.array(c) for c in told.T)], ["state_id", "confidence_low", "confidence_high", "probability", "standard_error"])

    return d.mapInArrow(run, "state_id string, confidence_low double, confidence_high double, probability double, standard_error double")


def next_verification_round(selected: DataFrame, rollouts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The rollouts still to run for unresolved states below the cap (VE14)."""
    grow = selected.where(f"decision_status = 'unresolved' and rollouts < {s.cap}").select("state_id", F.least(F.lit(s.cap), F.col("rollouts") + s.batch).alias("_n"))
    known = rollouts.select("state_id", "candidate_index").distinct().join(grow, "state_id")
    wanted = known.select("state_id", "candidate_index", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("rollout_index"))
    return wanted.join(rollouts, ["state_id", "candidate_index", "rollout_index"], "left_anti")


def baseline_scores(summary: DataFrame, candidates: DataFrame, baselines: tuple[str, ...] = ("greedy_baseline", "random_baseline")) -> DataFrame:
    """Per state a map of each baseline's scores (VE15): its cost after one step, and its
    verified risk, mean, tail mean, violation, repair and fallback."""
    d = summary.join(candidates.select("state_id", "candidate_index", "one_step_stage_cost"), ["state_id", "candidate_index"]).where(F.col("candidate_source").isin(*baselines))
    names = {"one_step_stage_cost": "one_step_cost", "risk": "verified_risk_score", "mean_cost": "mean_cost", "cvar_cost": "cvar_cost", "violation": "constraint_violation", "repair": "repair_distance", "fallback": "fallback_rate"}
    best = d.groupBy("state_id", "candidate_source").agg(F.min_by(F.struct(*names), "candidate_index").alias("_b"))
    entries = F.array(*(F.struct(F.concat(F.substring_index("candidate_source", "_", 1), F.lit(f"_{n}")).alias("k"), F.col(f"_b.{c}").cast("double").alias("v")) for c, n in names.items()))
    return best.groupBy("state_id").agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("baseline_scores"))


def soft_targets(ranked: DataFrame) -> DataFrame:
    """Weights of the equivalent candidates, summing to 1, and their entropy (VE16)."""
    d = ranked.where("equivalent").selectExpr("state_id", "candidate_index", "rank", "risk", "quality_weight / sum(quality_weight) over (partition by state_id) as weight")
    return d.groupBy("state_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "candidate_index", "weight", "risk"))).alias("target_candidates"),
        (-F.sum(F.expr("weight * ln(greatest(weight, 2.2250738585072014e-308D))"))).alias("target_entropy"),
    )


def demonstrations(selected: DataFrame, targets: DataFrame, candidates: DataFrame, states: DataFrame, action: list[str]) -> DataFrame:
    """Accepted states (acceptance_status) with the winner's executed action, a struct of
    the columns ``action``, its weight, risk and repair distance, and the targets (VE17)."""
    c = candidates.select("state_id", F.col("candidate_index").alias("selected_index"), F.struct(*action).alias("selected_action"), "repair_distance")
    accepted = selected.where("acceptance_status = 'accepted'")
    return accepted.join(c, ["state_id", "selected_index"]).join(targets, "state_id").join(states.select("state_id", "scenario_id", "split", "global_state_index"), "state_id")


def rejection_reason(candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """Why a candidate was not selected: null for the selected one (VE18)."""
    d = candidates.join(ranked.select("state_id", "candidate_index", "rank"), ["state_id", "candidate_index"], "left")
    return d.withColumn("rejection_reason", F.when(F.col("rank").isNull(), "not_shortlisted").when(F.col("rank") > 1, "higher_verified_risk_score"))

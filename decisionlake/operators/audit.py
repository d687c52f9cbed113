"""Integrity checks over linked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(table: DataFrame, states: DataFrame) -> DataFrame:
    """Number of distinct states a table names that do not exist (AU2)."""
    return table.select("state_id").distinct().join(states.select("state_id"), "state_id", "left_anti").agg(F.count("*").alias("orphans"))


def index_coverage(states: DataFrame, start: int, stop: int) -> DataFrame:
    """Missing, surplus and repeated global indices (AU8)."""
    found = states.groupBy("global_state_index").agg(F.count("*").alias("n"))
    wanted = states.sparkSession.range(start, stop).withColumnRenamed("id", "global_state_index").withColumn("want", F.lit(True))
    both = found.join(wanted, "global_state_index", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "surplus").when(F.col("n") > 1, "repeated")
    return both.select(problem.alias("problem"), "global_state_index").where("problem is not null")


def duplicate_states(states: DataFrame) -> DataFrame:
    """State hashes that occur more than once (AU9)."""
    return states.groupBy("causal_state_hash").agg(F.count("*").alias("n")).where("n > 1")


def rollout_transactions(selections: DataFrame, candidates: DataFrame, rollouts: DataFrame, schema: int = 5) -> DataFrame:
    """Accepted selections whose rollouts are not complete (AU10): (state_id, expected, found).
    Expected are as many rollouts as the selection says (verification_rollouts), for each
    of its candidates that is rollout_verified and each external baseline, whose number the
    selection says from schema 5 on (external_baseline_rollout_count, null: none) and
    which are two before; a selection without rollouts is wrong in any case."""
    s = selections.where("acceptance_status = 'accepted'")
    outside = F.coalesce(F.col("external_baseline_rollout_count"), F.lit(0)) if schema >= 5 else F.lit(2)
    s = s.select("state_id", F.coalesce("verification_rollouts", F.lit(0)).cast("long").alias("_each"), outside.cast("long").alias("_outside"))
    verified = candidates.groupBy("state_id").agg(F.count_if("rollout_verified").alias("_verified"))
    have = rollouts.groupBy("state_id").agg(F.count("*").alias("found"))
    d = s.join(verified, "state_id", "left").join(have, "state_id", "left")
    d = d.selectExpr("state_id", "(coalesce(_verified, 0) + _outside) * _each as expected", "coalesce(found, 0) as found", "_each")
    return d.where("_each <= 0 or expected <> found").drop("_each")


def split_leakage(states: DataFrame) -> DataFrame:
    """Number of scenarios in more than one split (AU11)."""
    each = states.groupBy("scenario_id").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    return each.where("low <> high").agg(F.count("*").alias("leaking"))


def hard_infeasible(candidates: DataFrame) -> DataFrame:
    """Candidates still infeasible after repair (AU4)."""
    return candidates.where("not hard_feasible").select("state_id", "candidate_index")


def selections_per_state(states: DataFrame, selections: DataFrame) -> DataFrame:
    """States without exactly one selection (AU5)."""
    have = selections.groupBy("state_id").agg(F.count("*").alias("n"))
    return states.select("state_id").join(have, "state_id", "left").select("state_id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def dangling_selections(demonstrations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Demonstrations whose candidate was not selected (AU6)."""
    return demonstrations.join(candidates.where("selected").select("state_id", "candidate_index"), ["state_id", "candidate_index"], "left_anti").select("state_id", "candidate_index")


def target_candidates(demonstrations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Whether the targets of each demonstration are valid and name candidates that are
    there (AU7)."""
    t = demonstrations.select("state_id", targets_valid("targets").alias("good"), F.explode_outer("targets.index").alias("candidate_index"))
    known = candidates.select("state_id", "candidate_index").distinct().withColumn("_in", F.lit(True))
    d = t.join(known, ["state_id", "candidate_index"], "left")
    return d.groupBy("state_id").agg((F.bool_and("good") & F.bool_and(F.col("candidate_index").isNull() | F.col("_in").isNotNull())).alias("valid"))


def targets_valid(targets: str, tolerance: float = 1e-6) -> Column:
    """Whether an array of (index, weight) is null, or not empty with finite weights of
    at least 0 that sum to 1, and distinct indices (AU7, QR8)."""
    good = (
        f"size({targets}) > 0 and forall({targets}, t -> t.weight >= 0 and t.weight < double('infinity'))"
        f" and abs(aggregate({targets}, 0D, (s, t) -> s + t.weight) - 1) <= {tolerance}D and size(array_distinct({targets}.index)) = size({targets})"
    )
    return F.expr(f"{targets} is null or coalesce({good}, false)")

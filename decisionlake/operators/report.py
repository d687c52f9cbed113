"""The audit's metrics, warnings and report, and the wide parts of the quality report.

Metrics are rows (metric, value); each comes from one aggregation over its table, so that
a report reads every table a few times and never brings rows to the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decisionlake.operators.audit import targets_valid
from decisionlake.operators.evaluation import GATES, decision_status
from decisionlake.operators.quantiles import Exact, aggregate

#: The audit's rules in order (metric, way, threshold, text, first and last
#: schema they hold for).
WARNINGS = (
    ("request_schema_valid_rate", "<", 0.99, "teacher schema-valid rate is below 99%", 0, 99),
    ("candidate_unique_ratio", "<", 0.75, "candidate uniqueness is below 75%", 0, 99),
    ("request_normalization_rate", ">", 0.05, "more than 5% of teacher requests required response normalization", 0, 99),
    ("teacher_template_resolution_repair_rate", ">", 0.05, "more than 5% of teacher candidates required template-id repair", 0, 99),
    ("candidate_fallback_rate", ">", 0.05, "candidate fallback rate is above 5%", 0, 99),
    ("candidate_p95_repair_distance", ">", 0.25, "candidate p95 repair distance is above 0.25", 0, 99),
    ("candidate_role_compliance_rate", "<", 0.95, "fewer than 95% of states have exactly one sensing-only candidate", 0, 4),
    ("teacher_template_compliance_rate", "<", 0.95, "fewer than 95% of teacher candidates comply with the referenced safe template", 5, 99),
    ("safe_template_coverage_rate", "<", 1.0, "deterministic safe-template bank coverage is incomplete", 5, 99),
    ("greedy_selectable_rate", "<", 1.0, "the selectable greedy floor is missing for at least one accepted state", 5, 99),
    ("executed_candidate_unique_ratio", "<", 0.75, "post-repair candidate uniqueness is below 75%", 0, 99),
    ("selected_fallback_rate", ">", 0.0, "at least one selected demonstration used fallback", 0, 99),
    ("selected_p95_repair_distance", ">", 0.05, "selected-candidate p95 repair distance is above 0.05", 0, 99),
    ("selection_unresolved_rate", ">", 0.05, "more than 5% of accepted selections remain unresolved after verification", 0, 99),
    ("selection_uncertain_rate", ">", 0.05, "confidence intervals overlap, but labels are practically equivalent", 0, 99),
    ("selected_vs_greedy_verified_win_rate", "<", 0.55, "selected candidates do not beat verified greedy in 55% of states", 0, 99),
    ("selected_vs_random_verified_win_rate", "<", 0.55, "selected candidates do not beat verified random in 55% of states", 0, 99),
)


def share(condition: Column | str) -> Column:
    """Share of rows, 0 of none; an unknown condition counts as false."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(F.avg(F.coalesce(c.cast("boolean"), F.lit(False)).cast("double")), F.lit(0.0))


def mean(value: str) -> Column:
    return F.coalesce(F.avg(F.expr(value)), F.lit(0.0))


def high(value: str, p: float = 0.95) -> Column:
    """For groups that are small by their nature, as the candidates of a state."""
    return F.coalesce(F.percentile(F.expr(value), p), F.lit(0.0))


def long(wide: DataFrame) -> DataFrame:
    """One row of metrics as rows (metric, value)."""
    names = wide.columns
    return wide.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast(`{n}` as double)" for n in names) + ") as (metric, value)")


def missing_tables(spark: SparkSession, folder: str, schemas: Mapping[str, StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, errors) of a folder of JSON-lines tables (AU1): one that is absent is an
    error and reads as empty."""
    tables, absent = {}, []
    for name, schema in schemas.items():
        try:
            tables[name] = spark.read.schema(schema).json(f"{folder}/{name}.jsonl")
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            tables[name] = spark.createDataFrame([], schema)
            absent.append((f"missing canonical table: {name}.jsonl",))
    return tables, spark.createDataFrame(absent, "error string")


def candidate_counts(requests: DataFrame, candidates: DataFrame, selections: DataFrame, expected: int, schema: int = 5) -> DataFrame:
    """Valid requests whose candidates are not as many as they should be (AU3): the
    teacher's as many as asked for, the pool as many as its selection says; before
    schema 5 the pool as many as asked for."""
    have = candidates.groupBy("state_id").agg(F.count("*").alias("pool"), F.count_if(F.col("candidate_source") == "teacher").alias("teacher"))
    d = requests.where("schema_valid").select("state_id").join(have, "state_id", "left").join(selections.select("state_id", "candidate_pool_count"), "state_id", "left")
    d = d.select("state_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("pool", "teacher", "candidate_pool_count")))
    problems = [("teacher", F.col("teacher"), F.lit(expected)), ("pool", F.col("pool"), F.col("candidate_pool_count"))] if schema >= 5 else [("pool", F.col("pool"), F.lit(expected))]
    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), found.cast("long").alias("found"), want.cast("long").alias("expected")) for kind, found, want in problems))
    return d.select("state_id", F.inline(rows)).where("found <> expected")


def request_metrics(requests: DataFrame) -> DataFrame:
    return long(aggregate(
        requests, [], share("schema_valid").alias("request_schema_valid_rate"), share("size(response_normalization_notes) > 0").alias("request_normalization_rate"),
        mean("case when schema_valid then unique_candidates / greatest(1.0D, candidates_returned) end").alias("candidate_unique_ratio"),
        mean("latency_s").alias("mean_request_latency_s"), Exact("p95_request_latency_s", "latency_s", 0.95, default=0.0), mean("completion_tokens").alias("mean_completion_tokens"),
    ))


def candidate_metrics(candidates: DataFrame, executed_key: Column, schema: int = 5) -> DataFrame:
    """Of the teacher's candidates from schema 5 on, else of all."""
    some = candidates.where("candidate_source = 'teacher'") if schema >= 5 else candidates
    rows = aggregate(
        some, [], share("template_compliant").alias("teacher_template_compliance_rate"), share("template_resolution <> 'exact'").alias("teacher_template_resolution_repair_rate"),
        share("pre_repair_feasible").alias("candidate_pre_repair_feasible_rate"), share("hard_feasible").alias("candidate_post_repair_hard_feasible_rate"), share("repair_distance > 1e-12D").alias("candidate_repair_rate"),
        mean("repair_distance").alias("candidate_mean_repair_distance"), Exact("candidate_p95_repair_distance", "repair_distance", 0.95, default=0.0), share("fallback_used").alias("candidate_fallback_rate"),
    )
    each = some.groupBy("state_id").agg((F.count_distinct(executed_key) / F.count("*")).alias("r"), (F.count_if(F.col("pair") == 0) == 1).alias("one"))
    states = each.agg(mean("r").alias("executed_candidate_unique_ratio"), share("one").alias("candidate_role_compliance_rate"))
    chosen = aggregate(candidates.where("selected"), [], share("fallback_used").alias("selected_fallback_rate"), Exact("selected_p95_repair_distance", "repair_distance", 0.95, default=0.0))
    return long(rows).unionByName(long(states)).unionByName(long(chosen))


def selection_metrics(selections: DataFrame) -> DataFrame:
    """Of accepted selections; the comparison with baselines of all that have all three risks."""
    accepted = selections.where("acceptance_status = 'accepted'").withColumn("_s", decision_status("decision_status", "selection_uncertain"))
    own = accepted.agg(
        mean("coalesce(safe_template_coverage_rate, 0)").alias("safe_template_coverage_rate"), share("greedy_candidate_index is not null").alias("greedy_selectable_rate"),
        share("selection_uncertain").alias("selection_uncertain_rate"), share("_s = 'unresolved'").alias("selection_unresolved_rate"),
    )
    both = selections.where("selected_risk is not null and greedy_risk is not null and random_risk is not null").agg(
        F.count("*").alias("verified_baseline_compared_states"), share("selected_risk < greedy_risk").alias("selected_vs_greedy_verified_win_rate"),
        share("selected_risk <= greedy_risk + 1e-12D").alias("selected_no_worse_than_greedy_verified_rate"), share("selected_risk < random_risk").alias("selected_vs_random_verified_win_rate"),
        mean("greedy_risk - selected_risk").alias("mean_greedy_minus_selected_verified_risk"), mean("random_risk - selected_risk").alias("mean_random_minus_selected_verified_risk"),
    )
    return long(own).unionByName(long(both))


def demonstration_metrics(demonstrations: DataFrame, states: DataFrame) -> DataFrame:
    valid = demonstrations.agg(share(targets_valid("targets")).alias("distillation_target_valid_rate"), F.count("*").alias("_d"))
    n = states.agg(F.count("*").alias("_n"))
    return long(valid.crossJoin(F.broadcast(n)).selectExpr("distillation_target_valid_rate", "coalesce(_d / nullif(_n, 0), 0) as demonstration_acceptance_rate"))  # a row each


def rollout_metrics(rollouts: DataFrame) -> DataFrame:
    return long(rollouts.agg(share("hard_feasible").alias("rollout_hard_feasible_rate"), share("retained_trajectory").alias("rollout_retained_trajectory_rate")))


def audit_metrics(requests: DataFrame, candidates: DataFrame, rollouts: DataFrame, selections: DataFrame, demonstrations: DataFrame, states: DataFrame, executed_key: Column, schema: int = 5) -> DataFrame:
    """The rates, means and quantiles of a dataset (AU12)."""
    parts = [request_metrics(requests), candidate_metrics(candidates, executed_key, schema), selection_metrics(selections), demonstration_metrics(demonstrations, states), rollout_metrics(rollouts)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("metric <> 'selected_no_worse_than_greedy_verified_rate'")


def audit_warnings(metrics: DataFrame, schema: int = 5) -> DataFrame:
    """The rules that a dataset's metrics break, in order (AU13). Uncertainty is only
    told where not too much is unresolved, baselines only where some state was compared."""
    rules = [(i, m, way, limit, text) for i, (m, way, limit, text, low, top) in enumerate(WARNINGS) if low <= schema <= top]
    rows = metrics.sparkSession.createDataFrame(rules, "place int, metric string, way string, threshold double, warning string")
    broken = F.when(F.col("way") == "<", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    d = rows.join(metrics, "metric").withColumn("broken", broken)
    known = metrics.agg(F.max(F.expr("metric = 'selection_unresolved_rate' and value > 0.05")).alias("_u"), F.max(F.expr("metric = 'verified_baseline_compared_states' and value > 0")).alias("_c"))
    d = d.crossJoin(F.broadcast(known)).where("broken and not (metric = 'selection_uncertain_rate' and coalesce(_u, false)) and (not metric like 'selected_vs_%' or coalesce(_c, false))")  # one row
    return d.select("place", "warning")


def audit_report(errors: DataFrame, warnings: DataFrame, metrics: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row (AU14): distinct errors (place, error) and warnings (place, warning) in
    order, passed, which no error and full feasibility after repair make, and counts, a map
    of the rows of each table that is given."""
    feasible = metrics.where("metric in ('candidate_post_repair_hard_feasible_rate', 'rollout_hard_feasible_rate') and value < 1")
    more = feasible.limit(1).select(F.lit(2**31 - 1).alias("place"), F.lit("post-repair hard feasibility must be 100%").alias("error"))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        first = rows.groupBy(name).agg(F.min("place").alias("place"))
        return first.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", name))), lambda x: x[name]).alias(f"{name}s"))  # rules, not rows of data

    both = listed(errors.unionByName(more), "error").crossJoin(listed(warnings, "warning"))  # one row each
    counts = None
    for name, t in (tables or {}).items():
        one = t.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    out = both.select((F.size("errors") == 0).alias("passed"), "errors", "warnings")
    if counts is None:
        return out.withColumn("counts", F.create_map().cast("map<string,bigint>"))
    return out.crossJoin(counts.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counts")))  # one row each


#: What selections may say of how sure they are and of the baselines after one step.
SURENESS = ("selection_probability", "margin_confidence_lower", "margin_confidence_upper", "greedy_one_step_cost", "random_one_step_cost")


def state_difficulty(states: DataFrame, candidates: DataFrame, selections: DataFrame, keep: list[str]) -> DataFrame:
    """A row a state (QR13): its own columns ``keep``, how its candidates fared, what was
    selected, how sure that was, and the baselines, as far as the selections have these columns; nulls
    where there is nothing."""
    each = candidates.groupBy("state_id").agg(
        F.count("*").alias("candidates"), share("pre_repair_feasible").alias("pre_repair_feasible_rate"), share("hard_feasible").alias("post_repair_hard_feasible_rate"),
        share("fallback_used").alias("fallback_rate"), share("repair_distance > 1e-12D").alias("repair_rate"), mean("repair_distance").alias("mean_repair_distance"), high("repair_distance").alias("p95_repair_distance"),
        *(F.min(F.when(F.col("selected"), F.col(c))).alias(f"selected_{n}") for c, n in (("one_step_stage_cost", "one_step_cost"), ("repair_distance", "repair_distance"), ("fallback_used", "fallback_used"))),
    )
    s = selections.select("state_id", "selected_candidate_index", "selected_risk", "greedy_risk", "random_risk", "verification_rollouts", "adaptive_rounds", "selection_uncertain", F.col("decision_status").alias("_d"), *(c for c in SURENESS if c in selections.columns))
    d = states.select("state_id", *keep).join(each, "state_id", "left").join(s, "state_id", "left")
    d = d.withColumn("decision_status", decision_status("_d", "selection_uncertain")).drop("_d")
    zero = ["candidates", "pre_repair_feasible_rate", "post_repair_hard_feasible_rate", "fallback_rate", "repair_rate", "mean_repair_distance", "p95_repair_distance"]
    return d.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in zero}, "selected_candidate_index": F.coalesce("selected_candidate_index", F.lit(-1))})


def selection_quality(selections: DataFrame) -> DataFrame:
    """One row over accepted selections (QR15)."""
    d = selections.where("acceptance_status = 'accepted'").withColumn("_s", decision_status("decision_status", "selection_uncertain"))
    return aggregate(
        d, [], F.count("*").alias("accepted_count"), share("selection_uncertain").alias("uncertain_rate"), share("_s = 'unresolved'").alias("unresolved_rate"), share("_s = 'practically_equivalent'").alias("practically_equivalent_rate"),
        mean("verification_rollouts").alias("mean_verification_rollouts"), Exact("p95_verification_rollouts", "verification_rollouts", 0.95, default=0.0), F.coalesce(F.max("verification_rollouts"), F.lit(0)).cast("double").alias("max_verification_rollouts"),
        mean("adaptive_rounds").alias("mean_adaptive_rounds"), mean("candidate_pool_count").alias("mean_candidate_pool_size"), mean("verified_candidate_count").alias("mean_verified_candidate_count"),
        mean("coalesce(safe_template_coverage_rate, 0)").alias("safe_template_coverage_rate"), share("greedy_candidate_index is not null").alias("greedy_selectable_rate"),
        share("selected_candidate_source = 'teacher'").alias("teacher_selected_rate"), mean("oracle_regret").alias("mean_oracle_regret"), Exact("p95_oracle_regret", "oracle_regret", 0.95, default=0.0),
    )


def selected_sources(selections: DataFrame) -> DataFrame:
    """Accepted selections by the source of their winner (QR15)."""
    return selections.where("acceptance_status = 'accepted'").groupBy(F.coalesce("selected_candidate_source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def teacher_contribution(demonstrations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of target weight by source, and of states with a target of that source
    (QR11). Targets with bad weights are skipped; an unknown index is of source unknown."""
    t = demonstrations.select("state_id", F.explode("targets").alias("t")).select("state_id", F.col("t.index").alias("candidate_index"), F.col("t.weight").alias("w"))
    t = t.where("w >= 0 and w < double('infinity')").join(candidates.select("state_id", "candidate_index", "candidate_source"), ["state_id", "candidate_index"], "left")
    each = t.groupBy(F.coalesce("candidate_source", F.lit("unknown")).alias("source"), "state_id").agg(F.sum("w").alias("w"))
    d = each.groupBy("source").agg(F.sum("w").alias("w"), F.count("*").alias("states"))
    n = demonstrations.agg(F.count("*").alias("_n"))
    return d.crossJoin(F.broadcast(n)).selectExpr("source", "w / nullif(sum(w) over (), 0) as weight_share", "states / _n as state_share")  # a row a source


def all_gates(metrics: DataFrame) -> DataFrame:
    """(metric, value) against all thresholds, with the verdict over all (QR17); a gate
    without a value fails."""
    wanted = metrics.sparkSession.createDataFrame([(k, way, limit) for k, (way, limit) in GATES.items()], "metric string, way string, threshold double")
    passed = F.when(F.col("way") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    d = wanted.join(metrics, "metric", "left").select("metric", "way", "threshold", "value", F.coalesce(passed, F.lit(False)).alias("passed"))
    return d.selectExpr("*", "bool_and(passed) over () as all_passed")  # a row a gate


def distribution_metric(errors: DataFrame, name: str) -> DataFrame:
    return errors.agg(F.lit(name).alias("metric"), F.coalesce(F.max("error"), F.lit(0.0)).alias("value"))

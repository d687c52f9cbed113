"""Decisions against baselines, gates, templates and scores of a trained policy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The gates a dataset passes before it grows.
GATES = {
    "request_schema_valid_rate": (">=", 0.99),
    "request_normalization_rate": ("<=", 0.05),
    "candidate_unique_ratio": (">=", 0.75),
    "teacher_template_compliance_rate": (">=", 0.95),
    "teacher_template_resolution_repair_rate": ("<=", 0.05),
    "safe_template_coverage_rate": (">=", 1.0),
    "greedy_selectable_rate": (">=", 1.0),
    "executed_candidate_unique_ratio": (">=", 0.75),
    "candidate_post_repair_hard_feasible_rate": (">=", 1.0),
    "candidate_fallback_rate": ("<=", 0.05),
    "candidate_p95_repair_distance": ("<=", 0.25),
    "selected_fallback_rate": ("<=", 0.0),
    "selected_p95_repair_distance": ("<=", 0.05),
    "selection_unresolved_rate": ("<=", 0.05),
    "distillation_target_valid_rate": (">=", 1.0),
    "duplicate_causal_state_rate": ("<=", 0.0),
    "state_distribution_max_abs_error": ("<=", 0.02),
    "split_distribution_max_abs_error": ("<=", 0.02),
    "demonstration_acceptance_rate": (">=", 0.99),
    "selected_vs_greedy_verified_win_rate": (">=", 0.55),
    "selected_no_worse_than_greedy_verified_rate": (">=", 1.0),
    "selected_vs_random_verified_win_rate": (">=", 0.55),
    "mean_greedy_minus_selected_verified_risk": (">=", 0.0),
    "mean_random_minus_selected_verified_risk": (">=", 0.0),
    "teacher_target_weight_share": (">=", 0.10),
}
#: A template of the same pair stands in within so many watts.
NEAREST_WATTS = 8.0


def decision_status(status: str, uncertain: str) -> Column:
    """A known status, else unresolved where uncertain or unknown, else decisive (QR7)."""
    known = F.col(status).isin("decisive", "practically_equivalent", "unresolved")
    return F.when(known, F.col(status)).when(F.coalesce(F.col(uncertain), F.lit(True)), "unresolved").otherwise("decisive")


def baseline_comparison(scores: DataFrame, selected: str, greedy: str, random: str) -> DataFrame:
    """Lower is better; only rows that have all three scores count (QR10)."""
    d = scores.where(f"{selected} is not null and {greedy} is not null and {random} is not null")
    s, g, r = F.col(selected), F.col(greedy), F.col(random)

    def rate(c: Column) -> Column:
        return F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 8)

    return d.agg(
        F.count("*").alias("compared"), rate(s).alias("mean_selected"), rate(g).alias("mean_greedy"), rate(r).alias("mean_random"), rate(s < g).alias("win_greedy"),
        rate(s <= g + 1e-12).alias("no_worse_greedy"), rate(s < r).alias("win_random"), rate(g - s).alias("gap_greedy"), rate(r - s).alias("gap_random"),
    )


def greedy_decision(pair_tokens: str, global_features: str) -> list[Column]:
    """pair (from 1, first of ties), communication, near and processor shares (LK8)."""
    urgency = f"transform({pair_tokens}, t -> t[0] + t[1] + 0.5D * t[13])"
    pair = f"cast(array_position({urgency}, array_max({urgency})) as int)"
    norm = f"sqrt(aggregate(slice({global_features}, 6, 10), 0D, (s, x) -> s + x * x))"
    sensing = f"least(0.7D, greatest(0.2D, 0.2D + 0.4D * {global_features}[0] + 0.1D * {norm}))"
    chosen = f"element_at({pair_tokens}, {pair})"
    near = f"case when {chosen}[1] >= {chosen}[0] then 0.15D else 0.3D end"
    cpu = f"least(1D, greatest(0D, 0.4D + {global_features}[0]))"
    return [F.expr(pair).alias("pair"), F.expr(f"1 - {sensing}").alias("eta_communication"), F.expr(near).alias("eta_near"), F.expr(cpu).alias("eta_cpu")]


def grid_search(states: DataFrame, keys: list[str], axes: dict[str, list[float]], infeasible: str, cost: str, distance: str, selected: str) -> DataFrame:
    """The best point of a small grid for each row by (infeasible, cost, distance), then
    by the grid's order, the number of points tried, and the regret of the ``selected``
    cost against it (LK9). Each task reduces its rows' points before they are shuffled."""
    points = [()]
    for values in axes.values():
        points = [(*p, v) for p in points for v in values]
    made = F.array(*(F.struct(F.lit(i).alias("at"), *(F.lit(float(v)).alias(n) for n, v in zip(axes, p))) for i, p in enumerate(points)))

    tried = states.withColumn("_p", F.explode(made)).select("*", "_p.*").withColumn(
        "_s", F.struct(F.expr(infeasible).cast("int").alias("infeasible"), F.expr(cost).alias("cost"), F.expr(distance).alias("distance"), "at", *axes, F.expr(selected).alias("selected"))
    )
    best = tried.groupBy(*keys).agg(F.min("_s").alias("_s"), F.count("*").alias("evaluated"))
    return best.select(*keys, "evaluated", "_s.infeasible", "_s.cost", (F.col("_s.selected") - F.col("_s.cost")).alias("regret"), *(f"_s.{n}" for n in axes))


def nearest_template(candidates: DataFrame, templates: DataFrame, watts: float = NEAREST_WATTS) -> DataFrame:
    """candidates (state_id, template_id, ...) with resolved: the template of the same
    state and pair that is nearest in sensing watts, ties by its name; null where none
    is within ``watts`` or the name does not parse (TR16). templates has a row a
    template: (state_id, template_id)."""

    def parsed(df: DataFrame) -> DataFrame:
        name = F.regexp_replace(F.lower(F.trim("template_id")), "[- ]", "_")
        shape = r"^p(\d+)_sense(\d+(?:\.\d+)?)w$"
        return df.withColumns({"_pair": F.nullif(F.regexp_extract(name, shape, 1), F.lit("")).cast("int"), "_w": F.nullif(F.regexp_extract(name, shape, 2), F.lit("")).cast("double")})

    offered = parsed(templates).groupBy("state_id", "_pair").agg(F.collect_list(F.struct("_w", "template_id")).alias("_t"))  # the few templates of a pair
    d = parsed(candidates).join(offered, ["state_id", "_pair"], "left")
    best = F.array_min(F.expr("transform(_t, t -> struct(abs(t._w - _w) as d, t.template_id as id))"))
    return d.withColumn("_b", best).withColumn("resolved", F.when(F.col("_b.d") <= watts, F.col("_b.id"))).select(*candidates.columns, "resolved")


def soft_class_targets(targets: str, classes: int) -> Column:
    """Normalised weights of (label, weight) targets by class; a label beyond the head is an error (TD4)."""
    inside = F.expr(f"forall({targets}, t -> t.label >= 0 and t.label < {classes})")
    total = f"aggregate({targets}, 0D, (s, t) -> s + t.weight)"
    sums = F.expr(f"transform(sequence(0, {classes - 1}), k -> aggregate(filter({targets}, t -> t.label = k), 0D, (s, t) -> s + t.weight) / {total})")
    return F.when(inside, sums).otherwise(F.raise_error(F.lit("a label lies beyond the head")))


def score_predictions(preds: DataFrame, heads: dict[str, tuple[str, str]], weight: str, means: str | None = None, selected: str | None = None, heading: int = 4) -> DataFrame:
    """Weighted means over rows (TD9): of each head (name: logits, label) whether its largest
    logit, the first of ties, is the label; and the absolute error of the continuous means
    against the selected values, averaged over the controls, each mean bounded by a
    sigmoid or, the heading's (a place from 0), by a hyperbolic tangent."""
    out = {f"{name}_top1_accuracy": (F.array_position(logits, F.array_max(logits)) - 1 == F.col(label)).cast("double") for name, (logits, label) in heads.items()}
    if means:
        bounded = F.transform(means, lambda x, i: F.when(i == heading, F.tanh(x)).otherwise(1 / (1 + F.exp(-x))))
        errors = F.zip_with(bounded, selected, lambda x, y: F.abs(x - y))
        out["continuous_mae"] = F.aggregate(errors, F.lit(0.0), lambda s, x: s + x) / F.size(means)
    return preds.agg(*(F.round(F.sum(x * F.col(weight)) / F.sum(weight), 8).alias(name) for name, x in out.items()))


def soft_cross_entropy(logits: str, target: str, classes: int, smoothing: float = 0.0) -> Column:
    """Cross-entropy of one row's class targets, smoothed, against its logits (TD10)."""
    top = f"array_max({logits})"
    log_sum = f"({top} + ln(aggregate({logits}, 0D, (s, x) -> s + exp(x - {top}))))"
    smooth = f"(t * {1.0 - smoothing}D + {smoothing / classes}D)"
    return F.expr(f"aggregate(zip_with({target}, {logits}, (t, x) -> {smooth} * ({log_sum} - x)), 0D, (s, x) -> s + x)")


def action_nll(mean: str, log_std: str, target: str, heading: int) -> Column:
    """Negative log likelihood of bounded controls: a normal distribution in logit (at
    ``heading``: atanh) space with its Jacobian, summed over the controls (TD11)."""
    edge = 1e-4
    unit = f"least({1 - edge}D, greatest({edge}D, {target}[i]))"
    angle = f"least({1 - edge}D, greatest({edge - 1}D, {target}[i]))"
    latent = f"case when i = {heading} then atanh({angle}) else ln({unit} / (1 - {unit})) end"
    jacobian = f"case when i = {heading} then ln(1 - {angle} * {angle}) else ln({unit}) + ln(1 - {unit}) end"
    normal = f"0.5D * (pow((({latent}) - m) / exp({log_std}[i]), 2) + 2 * {log_std}[i] + {math.log(2 * math.pi)}D)"
    return F.expr(f"aggregate(transform({mean}, (m, i) -> {normal} - ({jacobian})), 0D, (s, x) -> s + x)")


def extrapolate(x: Column, v: Column, pxx: Column, pxv: Column, pvv: Column, n: Column, dt: float, acceleration: float) -> list[Column]:
    """Position, velocity and covariance n slots on, in closed form: the noise of slot k
    is (dt^2 / 2, dt), carried on n - 1 - k slots (TS12)."""
    q = acceleration**2
    return [
        (x + v * n * dt).alias("x"), v.alias("v"),
        (pxx + 2 * n * dt * pxv + n * n * dt**2 * pvv + q * dt**4 * n * (4 * n * n - 1) / 12).alias("pxx"),
        (pxv + n * dt * pvv + q * dt**3 * n * n / 2).alias("pxv"), (pvv + q * dt**2 * n).alias("pvv"),
    ]


def gain_feature(re: str, im: str) -> Column:
    """A channel's power in decibels, from -180 to -100, as 0 to 1 (FE7)."""
    power = f"aggregate(zip_with({re}, {im}, (a, b) -> a * a + b * b), 0D, (s, x) -> s + x)"
    return F.expr(f"least(1D, greatest(0D, (10 * log10(greatest({power}, 1e-30D)) + 180) / 80))")


def uncommon_states(judged: DataFrame) -> DataFrame:
    """States that not every teacher of (teacher_label, state_id) has judged (MG9)."""
    teachers = judged.select("teacher_label").where("teacher_label is not null").distinct().count()
    return judged.groupBy("state_id").agg(F.count_distinct("teacher_label").alias("teachers")).where(F.col("teachers") < teachers)


def operating_map(points: DataFrame, axes: list[str], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Each point of swept parameters with what limits it (EV6): means of the limits'
    measures over its runs, feasible where all are within their bounds, else limited by the
    one that is furthest beyond, relative to its bound; ties by name."""
    d = points.groupBy(*axes).agg(F.count("*").alias("runs"), *(F.avg(measure).alias(f"mean_{name}") for name, (measure, _) in limits.items()))
    worst = F.array_max(F.array(*(F.struct((F.col(f"mean_{name}") / bound).alias("x"), F.lit(f"{name}_limited").alias("n")) for name, (_, bound) in sorted(limits.items()))))
    return d.withColumn("region", F.when(worst["x"] <= 1, "feasible").otherwise(worst["n"]))

"""Registered queries of audits and reports over selections and demonstrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.operators import audit, evaluation as ev, quality, report, teacher as te, verification as ve
from decisionlake.plans.catalog import NEEDS, STEPS, query, ranked, rounded_sql
from decisionlake.plans.reports import scores
from decisionlake.sources import adapters as a
from decisionlake.sources.tables import shared_folder

#: Proposed controls and what repair makes of them.
_ACTIONS = {
    "pair": ("pair", "pair"), "ris_code": ("l_suppkey % 2", "0"), "eta_haps": ("eta_sensing", "greatest(eta_sensing, 0.05)"), "eta_communication": ("eta_communication", "eta_communication"),
    "eta_near": ("eta_near", "least(eta_near, 0.25)"), "eta_jamming": ("l_tax", "least(l_tax, 0.05)"), "aav_heading_rad": ("l_tax - 0.04", "l_tax - 0.04"), "aav_speed_fraction": ("l_tax * 10", "least(l_tax * 10, 0.5)"),
    "eta_cpu": ("eta_cpu", "eta_cpu"),
}
_OUT = ", ".join(f"{own} AS p_{c}, {done} AS x_{c}" for c, (own, done) in _ACTIONS.items())
_COMPLY = "template_resolution = 'exact' AND l_quantity > 3"
STEPS["acts"] = f"SELECT c.*, {_OUT}, {_COMPLY} AS template_compliant, candidate_index = selected_index AS selected FROM candidates c JOIN selected USING (state_id)"
NEEDS["acts"] = ["candidates", "selected"]
STEPS["selections"] = """SELECT s.state_id, selected_index AS selected_candidate_index, selected_source AS selected_candidate_source, k % 29 <> 0 AS accepted,
  CASE WHEN k % 9 = 0 THEN NULL WHEN verified = 1 THEN 'decisive' WHEN len(equivalent_indices) > 1 THEN 'practically_equivalent' WHEN k % 4 = 0 THEN 'unresolved' ELSE 'decisive' END AS decision_status, k % 4 = 0 AS selection_uncertain,
  verified + (k % 31 = 0)::INT AS candidate_pool_count, verified AS verified_candidate_count, rollouts * (1 + k % 8) AS verification_rollouts, k % 3 AS adaptive_rounds,
  CASE WHEN k % 50 = 0 THEN 0.5 ELSE 1 END AS safe_template_coverage_rate, g.i AS greedy_candidate_index, CASE WHEN k % 3 > 0 THEN s.risk * 0.01 END AS oracle_regret,
  k % 100 / 100 AS selection_probability, s.risk * 0.01 - 0.02 AS margin_confidence_lower, s.risk * 0.01 + 0.02 AS margin_confidence_upper, one.greedy AS greedy_one_step_cost, one.random AS random_one_step_cost,
  s.risk AS selected_risk, b.greedy AS greedy_risk, b.random AS random_risk, one.selected AS selected_one_step, one.greedy AS greedy_one_step, one.random AS random_one_step
  FROM (SELECT *, state_id::BIGINT AS k FROM selected) s JOIN scores b USING (state_id)
  LEFT JOIN (SELECT state_id, max(candidate_index) AS i FROM candidates WHERE candidate_source = 'greedy_baseline' GROUP BY 1) g USING (state_id)
  LEFT JOIN (SELECT state_id, min(one_step_stage_cost) FILTER (selected) AS selected, min(one_step_stage_cost) FILTER (candidate_source = 'greedy_baseline') AS greedy,
    min(one_step_stage_cost) FILTER (candidate_source = 'safe_template') AS random FROM acts GROUP BY 1) one USING (state_id)"""
NEEDS["selections"] = ["selected", "scores", "acts"]
STEPS["status"] = "SELECT *, CASE WHEN decision_status IN ('decisive', 'practically_equivalent', 'unresolved') THEN decision_status WHEN selection_uncertain THEN 'unresolved' ELSE 'decisive' END AS st FROM selections WHERE accepted"
NEEDS["status"] = ["selections"]
STEPS["demos"] = """SELECT r.state_id, candidate_index + CASE WHEN k % 41 = 0 THEN 100 ELSE 0 END AS i, quality_weight / sum(quality_weight) OVER (PARTITION BY r.state_id) * CASE WHEN k % 37 = 0 THEN 2 ELSE 1 END AS w
  FROM (SELECT *, state_id::BIGINT AS k FROM ranked) r JOIN selections USING (state_id) WHERE accepted AND equivalent"""
NEEDS["demos"] = ["ranked", "selections"]


def controls(s, d):
    """Candidates with nine proposed (p_) and executed (x_) controls."""
    return a.candidates(s, d).selectExpr("*", *(f"{x.replace('0.05', '0.05D').replace('0.25', '0.25D').replace('0.04', '0.04D').replace('0.5)', '0.5D)')} as {p}_{n}" for n, pair in _ACTIONS.items() for p, x in zip("px", pair)), f"{_COMPLY} as template_compliant")


#: What selections, scores and targets read of a ranking.
_RANKED = ("state_id", "candidate_index", "candidate_source", "rank", "risk", "score_margin", "quality_weight", "rollouts", "equivalent")
#: What the metrics read of actions() beside the executed controls.
_ACTED = ("state_id", "candidate_index", "candidate_source", "template_compliant", "template_resolution", "pre_repair_feasible", "hard_feasible", "repair_distance", "fallback_used", "pair", "one_step_stage_cost", "selected")


def once(df, tag):
    """A table written once for all that a query makes of it."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(s, d):
    """The ranking, as far as it is read again, written once for all that a query makes of it."""
    return once(ranked(s, d).select(*_RANKED), "ranked")


def actions(s, d, r=None):
    """controls() with whether each candidate was selected."""
    winner = ve.select(ranked(s, d) if r is None else r).select("state_id", "selected_index")
    return controls(s, d).join(winner.hint("merge"), "state_id").withColumn("selected", F.expr("candidate_index = selected_index"))


def executed():
    return te.action_key("x_pair", "x_ris_code", tuple(f"x_{c}" for c in te.CONTINUOUS))


def selections(s, d, r=None, c=None):
    r = kept(s, d) if r is None else r
    c = actions(s, d, r) if c is None else c
    own = "case when candidate_source = '{}' then {} end"
    one = c.groupBy("state_id").agg(
        F.max(F.expr(own.format("greedy_baseline", "candidate_index"))).alias("greedy_candidate_index"), F.min(F.expr("case when selected then one_step_stage_cost end")).alias("selected_one_step"),
        F.min(F.expr(own.format("greedy_baseline", "one_step_stage_cost"))).alias("greedy_one_step"), F.min(F.expr(own.format("safe_template", "one_step_stage_cost"))).alias("random_one_step"),
    )
    w = ve.select(r).withColumn("k", F.col("state_id").cast("long")).join(scores(s, d, r).select("state_id", F.col("greedy").alias("greedy_risk"), F.col("random").alias("random_risk")), "state_id")
    return w.join(one, "state_id").selectExpr(
        "state_id", "selected_index as selected_candidate_index", "selected_source as selected_candidate_source", "case when k % 29 <> 0 then 'accepted' else 'rejected' end as acceptance_status",
        "case when k % 9 = 0 then null when verified = 1 then 'decisive' when size(equivalent_indices) > 1 then 'practically_equivalent' when k % 4 = 0 then 'unresolved' else 'decisive' end as decision_status",
        "k % 4 = 0 as selection_uncertain", "verified + cast(k % 31 = 0 as int) as candidate_pool_count", "verified as verified_candidate_count", "rollouts * (1 + k % 8) as verification_rollouts", "k % 3 as adaptive_rounds",
        "case when k % 50 = 0 then 0.5D else 1D end as safe_template_coverage_rate", "greedy_candidate_index", "case when k % 3 > 0 then risk * 0.01D end as oracle_regret", "risk as selected_risk", "greedy_risk", "random_risk",
        "k % 100 / 100 as selection_probability", "risk * 0.01D - 0.02D as margin_confidence_lower", "risk * 0.01D + 0.02D as margin_confidence_upper", "greedy_one_step as greedy_one_step_cost", "random_one_step as random_one_step_cost",
        "selected_one_step", "greedy_one_step", "random_one_step",
    )


def demonstrations(s, d, r=None, x=None):
    """Accepted states with weighted targets, some broken: doubled weights, unknown indices."""
    r = kept(s, d) if r is None else r
    t = ve.soft_targets(r).join((selections(s, d, r) if x is None else x).where("acceptance_status = 'accepted'").select("state_id", "selected_candidate_index"), "state_id")
    k = "cast(state_id as bigint)"
    return t.selectExpr("state_id", "selected_candidate_index", f"""transform(target_candidates, x -> named_struct('index', x.candidate_index + case when {k} % 41 = 0 then 100 else 0 end,
        'weight', x.weight * case when {k} % 37 = 0 then 2 else 1 end)) as targets""", "target_entropy")


def rollouts(s, d):
    return a.rollouts(s, d).withColumn("retained_trajectory", F.expr("not hard_feasible or rollout_index = 0"))


# counts of candidates and dangling demonstrations


@query("au3_candidate_counts", """SELECT state_id, kind, found, expected FROM (SELECT state_id, pool, teacher, candidate_pool_count AS p FROM (SELECT state_id, count(*) AS pool, count(*) FILTER (candidate_source = 'teacher') AS teacher FROM candidates GROUP BY 1)
  JOIN selections USING (state_id) WHERE state_id::BIGINT % 5 <> 0) t CROSS JOIN LATERAL (VALUES ('teacher', teacher, 2), ('pool', pool, p)) v(kind, found, expected) WHERE found <> expected""", "selections")
def au3(s, d):
    requests = a.states(s, d).selectExpr("state_id", "global_state_index % 5 <> 0 as schema_valid").join(a.candidates(s, d).select("state_id").distinct(), "state_id", "left_semi")
    return report.candidate_counts(requests, a.candidates(s, d), selections(s, d), 2)


@query("au6_dangling_selections", "SELECT state_id, selected_candidate_index + 1 AS candidate_index FROM selections WHERE accepted AND state_id::BIGINT % 6 = 0", "selections")
def au6(s, d):
    r = kept(s, d)
    demos = selections(s, d, r).where("acceptance_status = 'accepted'").selectExpr("state_id", "selected_candidate_index + cast(cast(state_id as bigint) % 6 = 0 as int) as candidate_index")
    return audit.dangling_selections(demos, actions(s, d, r))


@query("au7_target_candidates", """SELECT state_id, abs(sum(w) - 1) <= 1e-6 AND bool_and(c.state_id IS NOT NULL) AS valid FROM demos LEFT JOIN candidates c USING (state_id) WHERE FALSE GROUP BY 1""".replace("LEFT JOIN candidates c USING (state_id) WHERE FALSE", "d LEFT JOIN candidates c ON c.state_id = d.state_id AND c.candidate_index = d.i").replace("SELECT state_id", "SELECT d.state_id"), "demos")
def au7_candidates(s, d):
    return audit.target_candidates(demonstrations(s, d), a.candidates(s, d))


# metrics, warnings, report

_M = "SELECT '{0}' AS metric, round(coalesce({1}, 0), 8) AS value FROM {2}"
_R = {
    "request_schema_valid_rate": "avg(schema_valid::INT)", "request_normalization_rate": "avg((len(response_normalization_notes) > 0)::INT)", "candidate_unique_ratio": "avg(unique_candidates / greatest(1.0, candidates_returned)) FILTER (schema_valid)",
    "mean_request_latency_s": "avg(latency_s)", "p95_request_latency_s": "quantile_cont(latency_s, 0.95)", "mean_completion_tokens": "avg(completion_tokens)",
}
_T = "acts WHERE candidate_source = 'teacher'"
_C = {
    "teacher_template_compliance_rate": "avg(template_compliant::INT)", "teacher_template_resolution_repair_rate": "avg((template_resolution <> 'exact')::INT)", "candidate_pre_repair_feasible_rate": "avg(pre_repair_feasible::INT)",
    "candidate_post_repair_hard_feasible_rate": "avg(hard_feasible::INT)", "candidate_repair_rate": "avg((repair_distance > 1e-12)::INT)", "candidate_mean_repair_distance": "avg(repair_distance)",
    "candidate_p95_repair_distance": "quantile_cont(repair_distance, 0.95)", "candidate_fallback_rate": "avg(fallback_used::INT)",
}
_KEY = "(x_pair, x_ris_code, " + ", ".join(f"round_even(x_{c}, 8)" for c in te.CONTINUOUS) + ")"
_S = {"executed_candidate_unique_ratio": "avg(r)", "candidate_role_compliance_rate": "avg(one::INT)"}
_W = {"selected_fallback_rate": "avg(fallback_used::INT)", "selected_p95_repair_distance": "quantile_cont(repair_distance, 0.95)"}
_A = {
    "safe_template_coverage_rate": "avg(safe_template_coverage_rate)", "greedy_selectable_rate": "avg((greedy_candidate_index IS NOT NULL)::INT)", "selection_uncertain_rate": "avg(selection_uncertain::INT)",
    "selection_unresolved_rate": "avg((st = 'unresolved')::INT)",
}
_B = {
    "verified_baseline_compared_states": "count(*)", "selected_vs_greedy_verified_win_rate": "avg((selected_risk < greedy_risk)::INT)", "selected_no_worse_than_greedy_verified_rate": "avg((selected_risk <= greedy_risk + 1e-12)::INT)",
    "selected_vs_random_verified_win_rate": "avg((selected_risk < random_risk)::INT)", "mean_greedy_minus_selected_verified_risk": "avg(greedy_risk - selected_risk)", "mean_random_minus_selected_verified_risk": "avg(random_risk - selected_risk)",
}
_D = {"distillation_target_valid_rate": "avg(valid::INT)", "demonstration_acceptance_rate": "count(*) / (SELECT count(*) FROM states)"}
_O = {"rollout_hard_feasible_rate": "avg(hard_feasible::INT)", "rollout_retained_trajectory_rate": "avg((NOT hard_feasible OR rollout_index = 0)::INT)"}
_FROM = (
    (_R, "requests"), (_C, _T), (_S, f"(SELECT count(DISTINCT {_KEY}) / count(*) AS r, count(*) FILTER (pair = 0) = 1 AS one FROM {_T} GROUP BY state_id)"), (_W, "acts WHERE selected"), (_A, "status"),
    (_B, "selections WHERE selected_risk IS NOT NULL AND greedy_risk IS NOT NULL AND random_risk IS NOT NULL"), (_D, "(SELECT abs(sum(w) - 1) <= 1e-6 AS valid FROM demos GROUP BY state_id)"), (_O, "rollouts"),
)
STEPS["metrics_all"] = " UNION ALL ".join(_M.format(name, value, source) for metrics, source in _FROM for name, value in metrics.items())
STEPS["metrics"] = "SELECT * FROM metrics_all WHERE metric <> 'selected_no_worse_than_greedy_verified_rate'"
NEEDS["metrics_all"], NEEDS["metrics"] = ["requests", "acts", "status", "selections", "demos", "states", "rollouts"], ["metrics_all"]


def metrics(s, d):
    r = kept(s, d)
    c = once(actions(s, d, r).select(*_ACTED, *(f"x_{n}" for n in _ACTIONS)), "actions")
    x = once(selections(s, d, r, c), "selections")
    m = report.audit_metrics(a.requests(s, d), c, rollouts(s, d), x, demonstrations(s, d, r, x), a.states(s, d), executed())
    return m.withColumn("value", F.round("value", 8))


@query("au12_audit_metrics", "SELECT metric, value FROM metrics", "metrics")
def au12(s, d):
    return metrics(s, d)


STEPS["rules"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m}', '{way}', {limit}::DOUBLE, '{text}')" for i, (m, way, limit, text, low, top) in enumerate(report.WARNINGS) if low <= 5 <= top) + ") t(place, metric, way, threshold, warning)"
STEPS["warned"] = """SELECT place, warning FROM rules JOIN metrics USING (metric) WHERE CASE WHEN way = '<' THEN value < threshold ELSE value > threshold END
  AND NOT (metric = 'selection_uncertain_rate' AND (SELECT value FROM metrics WHERE metric = 'selection_unresolved_rate') > 0.05)"""
NEEDS["warned"] = ["rules", "metrics"]


@query("au13_audit_warnings", "SELECT place, warning FROM warned", "warned")
def au13(s, d):
    return report.audit_warnings(once(metrics(s, d), "metrics"))


@query("au14_audit_report", """SELECT len(coalesce(e.errors, [])) = 0 AS passed, coalesce(e.errors, []) AS errors, coalesce(w.warnings, []) AS warnings, (SELECT 'candidates=' || count(*) FROM candidates) || ',' || (SELECT 'rollouts=' || count(*) FROM rollouts) || ',' || (SELECT 'states=' || count(*) FROM states) AS counts
  FROM (SELECT list(warning ORDER BY place) AS warnings FROM warned) w, (SELECT list(error ORDER BY place) AS errors FROM (SELECT 1 AS place, n || ' scenarios cross dataset splits' AS error FROM (SELECT count(*) AS n FROM (SELECT scenario_id FROM states GROUP BY 1
    HAVING count(DISTINCT CASE WHEN global_state_index % 101 = 0 THEN 'test' ELSE split END) > 1)) WHERE n > 0
  UNION ALL SELECT 2, 'post-repair hard feasibility must be 100%' WHERE (SELECT min(value) FROM metrics WHERE metric IN ('candidate_post_repair_hard_feasible_rate', 'rollout_hard_feasible_rate')) < 1)) e""", "warned", "states")
def au14(s, d):
    m = once(metrics(s, d), "metrics")
    broken = a.states(s, d).withColumn("split", F.expr("case when global_state_index % 101 = 0 then 'test' else split end"))
    errors = audit.split_leakage(broken).where("leaking > 0").select(F.lit(1).alias("place"), F.concat("leaking", F.lit(" scenarios cross dataset splits")).alias("error"))
    out = report.audit_report(errors, report.audit_warnings(m), m, {"states": broken, "candidates": a.candidates(s, d), "rollouts": a.rollouts(s, d)})
    return out.withColumn("counts", F.expr("array_join(transform(array_sort(map_entries(counts)), x -> concat(x.key, '=', x.value)), ',')"))


# quality report

_KEEP = ["scenario_id", "split", "state_category", "mean_aoi", "queue_max"]
_NUM = ["pre_repair_feasible_rate", "post_repair_hard_feasible_rate", "fallback_rate", "repair_rate", "mean_repair_distance", "p95_repair_distance", "selected_one_step_cost", "selected_repair_distance", "selected_risk", "greedy_risk", "random_risk", "selection_probability", "margin_confidence_lower", "margin_confidence_upper", "greedy_one_step_cost", "random_one_step_cost"]
_EACH = """SELECT state_id, count(*) AS candidates, avg(pre_repair_feasible::INT) AS pre_repair_feasible_rate, avg(hard_feasible::INT) AS post_repair_hard_feasible_rate, avg(fallback_used::INT) AS fallback_rate, avg((repair_distance > 1e-12)::INT) AS repair_rate,
  avg(repair_distance) AS mean_repair_distance, quantile_cont(repair_distance, 0.95) AS p95_repair_distance, min(one_step_stage_cost) FILTER (selected) AS selected_one_step_cost, min(repair_distance) FILTER (selected) AS selected_repair_distance FROM acts GROUP BY 1"""


@query("qr13_state_difficulty", f"""SELECT state_id, {', '.join(_KEEP)}, coalesce(candidates, 0) AS candidates, {', '.join(f"round({'coalesce(' + c + ', 0)' if i < 6 else c}, 10) AS {c}" for i, c in enumerate(_NUM))},
  coalesce(selected_candidate_index, -1) AS selected_candidate_index, verification_rollouts, adaptive_rounds, CASE WHEN decision_status IN ('decisive', 'practically_equivalent', 'unresolved') THEN decision_status
  WHEN coalesce(selection_uncertain, TRUE) THEN 'unresolved' ELSE 'decisive' END AS decision_status FROM states LEFT JOIN ({_EACH}) USING (state_id) LEFT JOIN selections USING (state_id)""", "states", "selections")
def qr13(s, d):
    r = kept(s, d)
    out = report.state_difficulty(a.states(s, d), actions(s, d, r), selections(s, d, r), _KEEP)
    return out.select("state_id", *_KEEP, "candidates", *(F.round(c, 10).alias(c) for c in _NUM), "selected_candidate_index", "verification_rollouts", "adaptive_rounds", "decision_status")


_Q15 = {
    "uncertain_rate": "avg(selection_uncertain::INT)", "unresolved_rate": "avg((st = 'unresolved')::INT)", "practically_equivalent_rate": "avg((st = 'practically_equivalent')::INT)", "mean_verification_rollouts": "avg(verification_rollouts)",
    "p95_verification_rollouts": "quantile_cont(verification_rollouts, 0.95)", "max_verification_rollouts": "max(verification_rollouts)::DOUBLE", "mean_adaptive_rounds": "avg(adaptive_rounds)", "mean_candidate_pool_size": "avg(candidate_pool_count)",
    "mean_verified_candidate_count": "avg(verified_candidate_count)", "safe_template_coverage_rate": "avg(safe_template_coverage_rate)", "greedy_selectable_rate": "avg((greedy_candidate_index IS NOT NULL)::INT)",
    "teacher_selected_rate": "avg((selected_candidate_source = 'teacher')::INT)", "mean_oracle_regret": "avg(oracle_regret)", "p95_oracle_regret": "quantile_cont(oracle_regret, 0.95)",
}


@query("qr15_selection_quality", "SELECT count(*) AS accepted_count, " + ", ".join(f"round({v}, 8) AS {k}" for k, v in _Q15.items()) + " FROM status", "status")
def qr15(s, d):
    return report.selection_quality(selections(s, d)).select("accepted_count", *(F.round(c, 8).alias(c) for c in _Q15))


@query("qr15_selected_sources", "SELECT selected_candidate_source AS source, count(*) AS n FROM status GROUP BY 1", "status")
def qr15_sources(s, d):
    return report.selected_sources(selections(s, d))


@query("qr10_baseline_comparison", " UNION ALL ".join(f"""SELECT '{kind}' AS kind, count(*) AS compared, round(avg({x}), 8) AS mean_selected, round(avg({g}), 8) AS mean_greedy, round(avg({r}), 8) AS mean_random, round(avg(({x} < {g})::INT), 8) AS win_greedy,
  round(avg(({x} <= {g} + 1e-12)::INT), 8) AS no_worse_greedy, round(avg(({x} < {r})::INT), 8) AS win_random, round(avg({g} - {x}), 8) AS gap_greedy, round(avg({r} - {x}), 8) AS gap_random FROM selections
  WHERE {x} IS NOT NULL AND {g} IS NOT NULL AND {r} IS NOT NULL""" for kind, x, g, r in (("verified_risk", "selected_risk", "greedy_risk", "random_risk"), ("one_step_cost", "selected_one_step", "greedy_one_step", "random_one_step"))), "selections")
def qr10(s, d):
    x = selections(s, d)
    one = ev.baseline_comparison(x, "selected_one_step", "greedy_one_step", "random_one_step").withColumn("kind", F.lit("one_step_cost"))
    return ev.baseline_comparison(x, "selected_risk", "greedy_risk", "random_risk").withColumn("kind", F.lit("verified_risk")).unionByName(one)


@query("qr11_teacher_contribution", """SELECT source, round(sum(w) / (SELECT sum(w) FROM demos), 8) AS weight_share, round(count(DISTINCT state_id) / (SELECT count(DISTINCT state_id) FROM demos), 8) AS state_share FROM (
  SELECT d.state_id, w, coalesce(candidate_source, 'unknown') AS source FROM demos d LEFT JOIN candidates c ON c.state_id = d.state_id AND c.candidate_index = d.i) GROUP BY 1""", "demos")
def qr11(s, d):
    return report.teacher_contribution(demonstrations(s, d), a.candidates(s, d)).select("source", *(F.round(c, 8).alias(c) for c in ("weight_share", "state_share")))


@query("qr16_target_shape", """SELECT count(*) AS n, round(avg(k), 8) AS mean_targets, sum(valid::INT)::BIGINT AS valid, round(avg(e), 8) + 0.0 AS mean_entropy FROM (SELECT state_id, count(*) AS k, abs(sum(w) - 1) <= 1e-6 AS valid,
  -sum(p * ln(greatest(p, 2.2250738585072014e-308))) AS e FROM (SELECT *, w / sum(w) OVER (PARTITION BY state_id) AS p FROM demos) GROUP BY 1)""", "demos")
def qr16(s, d):
    t = quality.target_shape(demonstrations(s, d))
    return t.select("n", F.round("mean_targets", 8).alias("mean_targets"), "valid", (F.round("mean_entropy", 8) + 0.0).alias("mean_entropy"))


@query("qr3_action_diversity", f"""SELECT side, count(*) AS states, round(avg(r), 8) AS mean_ratio, sum((r < 0.75)::INT)::BIGINT AS below FROM (
  SELECT state_id, 'executed' AS side, count(DISTINCT {_KEY}) / count(*) AS r FROM acts GROUP BY 1 UNION ALL SELECT state_id, 'proposed', count(DISTINCT {_KEY.replace('x_', 'p_')}) / count(*) FROM acts GROUP BY 1) GROUP BY 1""", "acts")
def qr3(s, d):
    c = controls(s, d)
    sides = {"executed": executed(), "proposed": te.action_key("p_pair", "p_ris_code", tuple(f"p_{x}" for x in te.CONTINUOUS))}
    out = [quality.action_diversity(c, key).withColumn("side", F.lit(side)) for side, key in sides.items()]
    return out[0].unionByName(out[1])


@query("qr5_action_field_changes", "SELECT field, count(*) AS n, sum((x > 1e-12)::INT)::BIGINT AS changed, round(avg((x > 1e-12)::INT), 8) AS rate, round(avg(x), 8) AS mean_change, round(quantile_cont(x, 0.95), 8) AS p95_change FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS field, abs(x_{c} - p_{c})::DOUBLE AS x FROM acts" for c in _ACTIONS) + ") GROUP BY 1", "acts")
def qr5(s, d):
    return quality.action_field_changes(controls(s, d), {c: (f"p_{c}", f"x_{c}") for c in _ACTIONS})


@query("qr12_repair_reasons", """SELECT reason, n, round(n / (SELECT count(*) FROM candidates), 8) AS rate, row_number() OVER (ORDER BY n DESC, reason) AS place FROM (
  SELECT reason, count(*) AS n FROM (SELECT unnest(repair_reasons) AS reason FROM candidates) GROUP BY 1)""", "candidates")
def qr12(s, d):
    return quality.repair_reasons(a.candidates(s, d))


@query("qr14_template_resolution", """SELECT template_resolution, count(*) AS n, round(count(*) / (SELECT count(*) FROM acts), 8) AS share, round(avg(template_compliant::INT), 8) AS compliance FROM acts GROUP BY GROUPING SETS ((), (template_resolution))""", "acts")
def qr14(s, d):
    return quality.template_resolution(controls(s, d))


@query("qr19_difficulty_cube", f"""SELECT state_category, split, selected_candidate_source AS source, count(*) AS n, round(avg(mean_aoi), 6) AS mean_aoi, round(avg(queue_max), 6) AS queue_max, round(avg(selected_risk), 6) AS selected_risk
  FROM states LEFT JOIN selections USING (state_id) GROUP BY CUBE (state_category, split, selected_candidate_source)""", "states", "selections")
def qr19(s, d):
    joined = a.states(s, d).join(selections(s, d).select("state_id", F.col("selected_candidate_source").alias("source"), "selected_risk"), "state_id", "left")
    return quality.difficulty_cube(joined, ["state_category", "split", "source"], ["mean_aoi", "queue_max", "selected_risk"])


_SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}
_CATEGORIES = {"ordinary": 0.35, "freshness_stress": 0.25, "sensing_stress": 0.15, "secrecy_stress": 0.15, "boundary_rare": 0.10}
_ERROR = "SELECT '{0}' AS metric, max(abs(coalesce(n, 0) / (SELECT count(*) FROM states) - coalesce(target, 0))) AS value FROM (VALUES {1}) t(label, target) FULL JOIN (SELECT {2} AS label, count(*) AS n FROM states GROUP BY 1) USING (label)"
_MORE = " UNION ALL ".join([
    "SELECT metric, value FROM metrics_all",
    "SELECT 'duplicate_causal_state_rate', sum(n - 1) / sum(n) FROM (SELECT count(*) AS n FROM states GROUP BY causal_state_hash)",
    *(_ERROR.format(name, ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in target.items()), column) for name, column, target in (("state_distribution_max_abs_error", "state_category", _CATEGORIES), ("split_distribution_max_abs_error", "split", _SPLITS))),
    "SELECT 'teacher_target_weight_share', coalesce(sum(w) FILTER (candidate_source = 'teacher') / sum(w), 0) FROM demos d LEFT JOIN candidates c ON c.state_id = d.state_id AND c.candidate_index = d.i",
])
_PASS = "coalesce(CASE WHEN way = '>=' THEN value >= threshold ELSE value <= threshold END, FALSE)"


@query("qr17_scale_up_gates", f"""SELECT metric, way, threshold, value, {_PASS} AS passed, bool_and({_PASS}) OVER () AS all_passed FROM (VALUES {', '.join(f"('{k}', '{way}', {limit}::DOUBLE)" for k, (way, limit) in ev.GATES.items())}) g(metric, way, threshold)
  LEFT JOIN (SELECT metric, round(value, 8) AS value FROM ({_MORE})) USING (metric)""", "metrics_all")
def qr17(s, d):
    r = kept(s, d)
    x, states, demos = selections(s, d, r), a.states(s, d), demonstrations(s, d, r)
    m = report.audit_metrics(a.requests(s, d), actions(s, d, r), rollouts(s, d), x, demos, states, executed())
    m = m.unionByName(report.selection_metrics(x).where("metric = 'selected_no_worse_than_greedy_verified_rate'"))
    m = m.unionByName(quality.duplicate_rate(states).selectExpr("'duplicate_causal_state_rate' as metric", "duplicate_rate as value"))
    for name, column, target in (("state_distribution_max_abs_error", "state_category", _CATEGORIES), ("split_distribution_max_abs_error", "split", _SPLITS)):
        m = m.unionByName(report.distribution_metric(quality.distribution_error(states, column, target), name))
    share = report.teacher_contribution(demos, a.candidates(s, d)).agg(F.coalesce(F.max(F.when(F.col("source") == "teacher", F.col("weight_share"))), F.lit(0.0)).alias("value"))
    return report.all_gates(m.unionByName(share.select(F.lit("teacher_target_weight_share").alias("metric"), "value")).withColumn("value", F.round("value", 8)))


_NINE = ["pair", "ris_code", *te.CONTINUOUS]


@query("ve17_demonstrations", f"""SELECT s.state_id, scenario_id, split, global_state_index, selected_candidate_index AS selected_index, {', '.join(f"round(x_{c}, 8)::DOUBLE AS {c}" for c in _NINE)}, round(s.selected_risk, 8) AS risk, repair_distance,
  (SELECT count(*) FROM demos d WHERE d.state_id = s.state_id) AS targets FROM selections s JOIN acts c ON c.state_id = s.state_id AND selected JOIN states ON states.state_id = s.state_id WHERE accepted""", "states", "selections", "acts", "demos")
def ve17(s, d):
    r = kept(s, d)
    w = ve.select(r).join(selections(s, d, r).select("state_id", "acceptance_status"), "state_id")
    out = ve.demonstrations(w, ve.soft_targets(r), actions(s, d, r), a.states(s, d), [f"x_{c}" for c in _NINE])
    return out.select(
        "state_id", "scenario_id", "split", "global_state_index", "selected_index", *(F.round(F.col(f"selected_action.x_{c}").cast("double"), 8).alias(c) for c in _NINE), F.round("risk", 8).alias("risk"), "repair_distance",
        F.size("target_candidates").cast("long").alias("targets"),
    )

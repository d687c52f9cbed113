"""All registered queries of the library's own operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.functions import freshness, links
from decisionlake.operators import adaptive, audit, quality, sampling, shards, training, verification as ve
from decisionlake.sources import adapters as a
from decisionlake.sources.tables import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Further steps of the oracle, on top of the adapters.
STEPS = dict(a.SQL) | {
    "summary": """SELECT *, mean_cost + 0.25 * (cvar_cost - mean_cost) + 2 * violation + 0.25 * repair + 2 * fallback + 1000 * (1 - feasible_probability) AS risk FROM (
        SELECT *, list_avg(list_filter(c, lambda x: x >= q)) AS cvar_cost FROM (
        SELECT state_id, candidate_index, any_value(candidate_source) AS candidate_source, count(*) AS rollouts, avg(discounted_cost) AS mean_cost,
        coalesce(stddev_samp(discounted_cost), 0) AS std_cost, list(discounted_cost) AS c, quantile_cont(discounted_cost, 0.9) AS q, quantile_cont(discounted_cost, 0.5) AS median_cost,
        quantile_cont(discounted_cost, 0.05) AS p05_cost, quantile_cont(discounted_cost, 0.1) AS p10_cost, quantile_cont(discounted_cost, 0.95) AS p95_cost, max(discounted_cost) AS max_cost,
        avg(hard_feasible::INT) AS feasible_probability, avg(mean_constraint_violation) AS violation, avg(mean_repair_distance) AS repair, avg(fallback_rate) AS fallback
        FROM rollouts GROUP BY ALL))""".replace("GROUP BY ALL", "GROUP BY state_id, candidate_index"),
    "ranked": """SELECT *, e / sum(e) OVER (PARTITION BY state_id) AS quality_weight,
        risk - first_value(risk) OVER (PARTITION BY state_id ORDER BY rank) <= 0.01 + 1e-12 AS equivalent,
        coalesce(lead(risk) OVER (PARTITION BY state_id ORDER BY rank) - risk, 'infinity'::DOUBLE) AS score_margin FROM (
        SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY feasible_probability < 1, risk, repair, candidate_index) AS rank,
        exp(greatest(-700, (min(risk) OVER (PARTITION BY state_id) - risk) / 0.1)) AS e FROM summary)""",
    "selected": """SELECT state_id, arg_min(candidate_index, rank) AS selected_index, arg_min(candidate_source, rank) AS selected_source, min(rollouts) AS rollouts, count(*) AS verified,
        arg_min(risk, rank) AS risk, arg_min(score_margin, rank) AS score_margin, arg_min(quality_weight, rank) AS quality_weight,
        list(candidate_index ORDER BY rank) FILTER (equivalent) AS equivalent_indices FROM ranked GROUP BY state_id""",
}
NEEDS = {"rollouts": ["candidates"], "summary": ["rollouts"], "ranked": ["summary"], "selected": ["ranked"], "sensing_jobs": ["slot_log"]}


def _with(sql: str, *names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({STEPS[n]})" for n in order) + " " + sql


def query(name: str, sql: str | None = None, *needs: str):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _with(sql, *needs) if needs else sql
        return f

    return keep


def rounded(*names: str):
    return [F.round(n, 10).alias(n) for n in names]


def rounded_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 10) AS {n}" for n in names)


# sampling


@query("sp1_assign_split", "SELECT state_id, split FROM states", "states")
def sp1(s, d):
    return a.states(s, d).select("state_id", "split")


@query("sp2_stable_seed", "SELECT o_orderkey AS id, ('0x' || substr(sha256('42:' || o_orderkey), 1, 8))::BIGINT AS seed FROM orders")
def sp2(s, d):
    return a.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), sampling.stable_seed(F.col("o_orderkey").cast("string"), 42).alias("seed"))


@query("sp4_exact_assignments", """WITH h AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY sha256('7:part:' || o_orderkey)) - 1 AS k, count(*) OVER () AS n FROM orders)
  SELECT id, CASE WHEN k < n // 2 THEN 'a' ELSE 'b' END AS part FROM h""")
def sp4(s, d):
    o = a.table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    n = o.count()
    return sampling.exact_assignments(o, "id", n, {"a": (n // 2) / n, "b": 1 - (n // 2) / n}, 7, "part")


@query("sp5_assign_shard", """WITH t AS (SELECT o_orderkey AS id, count(*) OVER () AS n FROM orders)
  SELECT id, CASE WHEN id < (n % 7) * (n // 7 + 1) THEN id // (n // 7 + 1) ELSE n % 7 + (id - (n % 7) * (n // 7 + 1)) // (n // 7) END AS shard FROM t""")
def sp5(s, d):
    o = a.table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return o.withColumn("shard", sampling.assign_shard(F.col("id"), o.count(), 7))


@query("sp7_common_seeds", "SELECT state_id, i AS rollout_index, ('0x' || substr(sha256('42:' || state_id || ':' || i), 1, 8))::BIGINT AS rollout_seed FROM states CROSS JOIN range(8) r(i)", "states")
def sp7(s, d):
    return sampling.common_seeds(a.states(s, d), 8, 42)


@query("sp8_audit_sample", "SELECT state_id, candidate_index FROM candidates WHERE ('0x' || substr(sha256(state_id || ':' || candidate_index || ':audit'), 1, 8))::UBIGINT / 4294967296.0 < 0.05", "candidates")
def sp8(s, d):
    return sampling.audit_sample(a.candidates(s, d), ["state_id", "candidate_index"], 0.05).select("state_id", "candidate_index")


# verification

_SUMMARY = ["mean_cost", "std_cost", "median_cost", "p05_cost", "p10_cost", "p95_cost", "max_cost", "cvar_cost", "feasible_probability", "violation", "repair", "fallback", "risk"]


def summary(s, d):
    return ve.summarize_rollouts(a.rollouts(s, d))


def ranked(s, d):
    return ve.rank_candidates(summary(s, d))


@query("ve2_summarize_rollouts", f"SELECT state_id, candidate_index, rollouts, {rounded_sql(*_SUMMARY)} FROM summary", "summary")
def ve2(s, d):
    return summary(s, d).select("state_id", "candidate_index", "rollouts", *rounded(*_SUMMARY))


@query("ve3_cvar", "SELECT state_id, candidate_index, round(cvar_cost, 10) AS cvar_cost FROM summary", "summary")
def ve3(s, d):
    return summary(s, d).select("state_id", "candidate_index", *rounded("cvar_cost"))


_PRE = "one_step_stage_cost + 2 * one_step_constraint_violation + 0.25 * repair_distance + 2 * fallback_used::INT + 1000 * (NOT hard_feasible)::INT"


@query("ve5_preliminary_score", f"SELECT state_id, candidate_index, round({_PRE}, 10) AS preliminary_score FROM candidates", "candidates")
def ve5(s, d):
    return a.candidates(s, d).select("state_id", "candidate_index", F.round(ve.preliminary_score(), 10).alias("preliminary_score"))


@query("ve6_shortlist", f"""SELECT state_id, candidate_index FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY {_PRE}, candidate_index) AS rn FROM candidates)
  WHERE rn <= 3 OR candidate_source = 'greedy_baseline'""", "candidates")
def ve6(s, d):
    return ve.shortlist(a.candidates(s, d)).select("state_id", "candidate_index")


@query("ve7_rank_candidates", "SELECT state_id, candidate_index, rank, round(quality_weight, 10) AS quality_weight, equivalent FROM ranked", "ranked")
def ve7(s, d):
    return ranked(s, d).select("state_id", "candidate_index", F.col("rank").cast("long"), *rounded("quality_weight"), "equivalent")


@query("ve10_score_margin", "SELECT state_id, candidate_index, CASE WHEN isfinite(score_margin) THEN round(score_margin, 10) ELSE score_margin END AS score_margin FROM ranked", "ranked")
def ve10(s, d):
    return ranked(s, d).select("state_id", "candidate_index", *rounded("score_margin"))


def seeded(s, d):
    """Rollouts with the common seeds of their state."""
    return a.rollouts(s, d).withColumn("rollout_seed", sampling.stable_seed(F.concat_ws(":", "state_id", F.col("rollout_index").cast("string")), 42))


@query("ve11_paired_bootstrap")
def ve11(s, d):
    return ve.paired_bootstrap(seeded(s, d), ranked(s, d))


@query("ve12_decision_status")
def ve12(s, d):
    return ve.select_with_confidence(ranked(s, d), seeded(s, d)).select("state_id", "selected_index", "confidence_low", "confidence_high", "probability", "decision_status", "uncertain", "standardized_margin")


def longer(s, d, count):
    """Rollouts with their seeds, ``count`` of each candidate."""
    r = a.rollouts(s, d).where("rollout_index = 0").drop("rollout_index").withColumn("rollout_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    r = r.withColumn("discounted_cost", F.expr("discounted_cost + (cast(conv(substr(sha2(concat(state_id, ':', candidate_index, ':', rollout_index), 256), 1, 6), 16, 10) as double) / 16777216D - 0.5D) * 0.15D"))
    return r.withColumn("rollout_seed", sampling.stable_seed(F.concat_ws(":", "state_id", F.col("rollout_index").cast("string")), 42))


@query("ve14_adaptive_rounds")
def ve14_rounds(s, d):
    """Up to three rounds of 8 rollouts, each for the states that the one before left open."""
    settings, root = ve.Settings(cap=24, resamples=200), shared_folder(s, "rounds")
    every = longer(s, d, 24)
    new = every.where("rollout_index < 8")
    for number in range(3):
        work = adaptive.verify_round(s, root, new, number, settings)
        new = every.join(work, ["state_id", "candidate_index", "rollout_index"], "left_semi")
    return adaptive.verified(s, root).select("state_id", "selected_index", "rollouts", "adaptive_rounds", "decision_status")


@query("ve13_select", "SELECT state_id, selected_index, selected_source, rollouts, verified, len(equivalent_indices) AS equivalent, round(risk, 10) AS risk, round(quality_weight, 10) AS quality_weight FROM selected", "selected")
def ve13(s, d):
    return ve.select(ranked(s, d)).select("state_id", "selected_index", "selected_source", "rollouts", "verified", F.size("equivalent_indices").alias("equivalent"), *rounded("risk", "quality_weight"))


_BASE = {"one_step_stage_cost": "one_step_cost", "risk": "verified_risk_score", "mean_cost": "mean_cost", "cvar_cost": "cvar_cost", "violation": "constraint_violation", "repair": "repair_distance", "fallback": "fallback_rate"}


@query("ve15_baseline_scores", "SELECT state_id, key, round(value, 8) AS value FROM (" + " UNION ALL ".join(
    f"SELECT state_id, split_part(candidate_source, '_', 1) || '_{n}' AS key, arg_min({c}, candidate_index)::DOUBLE AS value FROM (SELECT summary.*, c.one_step_stage_cost FROM summary JOIN candidates c USING (state_id, candidate_index)) WHERE candidate_source IN ('greedy_baseline', 'safe_template') GROUP BY state_id, candidate_source"
    for c, n in _BASE.items()) + ")", "summary", "candidates")
def ve15(s, d):
    b = ve.baseline_scores(summary(s, d), a.candidates(s, d), ("greedy_baseline", "safe_template"))
    return b.select("state_id", F.explode("baseline_scores")).select("state_id", "key", F.round("value", 8).alias("value"))


_TARGETS = """SELECT state_id, count(*) AS targets, round(-sum(w * ln(greatest(w, 2.2250738585072014e-308))), 10) + 0.0 AS target_entropy FROM (
  SELECT state_id, quality_weight / sum(quality_weight) OVER (PARTITION BY state_id) AS w FROM ranked WHERE equivalent) GROUP BY state_id"""


@query("ve16_soft_targets", _TARGETS, "ranked")
def ve16(s, d):
    t = ve.soft_targets(ranked(s, d))
    return t.select("state_id", F.size("target_candidates").cast("long").alias("targets"), (F.round("target_entropy", 10) + 0.0).alias("target_entropy"))


@query("ve18_rejection_reason", """SELECT coalesce(reason, 'selected') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN rank IS NULL THEN 'not_shortlisted' WHEN rank > 1 THEN 'higher_verified_risk_score' END AS reason
  FROM candidates LEFT JOIN ranked USING (state_id, candidate_index)) GROUP BY 1""", "candidates", "ranked")
def ve18(s, d):
    out = ve.rejection_reason(a.candidates(s, d), ranked(s, d))
    return out.groupBy(F.coalesce("rejection_reason", F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


# audit


@query("au2_orphans", "SELECT count(DISTINCT state_id) AS orphans FROM candidates WHERE state_id NOT IN (SELECT state_id FROM states WHERE global_state_index % 97 <> 0)", "states", "candidates")
def au2(s, d):
    return audit.orphans(a.candidates(s, d), a.states(s, d).where("global_state_index % 97 <> 0"))


@query("au8_index_coverage", """SELECT 'missing' AS problem, i AS global_state_index FROM range((SELECT max(global_state_index) + 1 FROM states)) r(i)
  WHERE i NOT IN (SELECT global_state_index FROM states WHERE global_state_index % 83 <> 5)
  UNION ALL SELECT 'repeated', global_state_index FROM states WHERE global_state_index % 83 = 7""", "states")
def au8(s, d):
    x = a.states(s, d).select("global_state_index")
    broken = x.where("global_state_index % 83 <> 5").union(x.where("global_state_index % 83 = 7"))
    stop = x.agg(F.max("global_state_index") + 1).first()[0]
    return audit.index_coverage(broken, 0, stop)


@query("au9_duplicate_states", "SELECT causal_state_hash, count(*) AS n FROM states GROUP BY 1 HAVING count(*) > 1", "states")
def au9(s, d):
    return audit.duplicate_states(a.states(s, d))


@query("au10_rollout_transactions", """SELECT state_id, expected, found FROM (SELECT c.state_id, CASE WHEN k % 31 = 0 THEN 0 ELSE 8 END AS each, (c.n + (k % 43 = 0)::INT) * CASE WHEN k % 31 = 0 THEN 0 ELSE 8 END AS expected, coalesce(r.n, 0) AS found
  FROM (SELECT state_id, state_id::BIGINT AS k, count(*) FILTER (state_id::BIGINT % 37 <> 0 OR candidate_index > 0) AS n FROM candidates GROUP BY 1) c
  LEFT JOIN (SELECT state_id, count(*) AS n FROM rollouts WHERE state_id::BIGINT % 89 <> 0 OR rollout_index <> 7 GROUP BY 1) r USING (state_id) WHERE k % 29 <> 0) WHERE each <= 0 OR expected <> found""", "rollouts")
def au10(s, d):
    """Some states say no rollouts, an external baseline that is not there, a candidate that was not verified; some have too few."""
    k = "cast(state_id as bigint)"
    r = a.rollouts(s, d).where(f"{k} % 89 <> 0 or rollout_index <> 7")
    c = a.candidates(s, d).withColumn("rollout_verified", F.expr(f"{k} % 37 <> 0 or candidate_index > 0"))
    x = c.select("state_id").distinct().selectExpr("state_id", f"case when {k} % 29 <> 0 then 'accepted' else 'rejected' end as acceptance_status", f"case when {k} % 31 = 0 then 0 else 8 end as verification_rollouts",
                                                   f"cast({k} % 43 = 0 as int) as external_baseline_rollout_count")
    return audit.rollout_transactions(x, c, r)


@query("ve12_status_of_sure_states", """SELECT state_id, candidate_index AS selected_index, verified = 1 AS alone, CASE WHEN verified = 1 THEN 'decisive' ELSE 'practically_equivalent' END AS decision_status, CASE WHEN verified = 1 THEN 1.0::DOUBLE END AS probability,
  verified = 1 AS endless, sources FROM (SELECT state_id, count(*) AS verified, count(*) FILTER (equivalent) AS eq, arg_min(candidate_index, rank) AS candidate_index, count(DISTINCT candidate_source) AS sources FROM ranked GROUP BY 1) WHERE verified = 1 OR eq > 1""", "ranked")
def ve12_sure(s, d):
    """States whose status does not hang on the generator: alone, or with equivalents."""
    sure = "count(*) over (partition by state_id) = 1 or count_if(equivalent) over (partition by state_id) > 1"
    x = ve.select_with_confidence(ranked(s, d).withColumn("_sure", F.expr(sure)).where("_sure").drop("_sure"), seeded(s, d))  # the condition of the result, before the resampling
    endless = "score_margin = double('infinity') and standardized_margin = double('infinity') and confidence_low = double('infinity') and confidence_high = double('infinity')"
    return x.selectExpr("state_id", "selected_index", "verified = 1 as alone", "decision_status", "case when verified = 1 then probability end as probability", f"coalesce(({endless}), false) as endless", "cast(size(candidate_source_counts) as bigint) as sources")


@query("au11_split_leakage", """SELECT count(*) AS leaking FROM (SELECT scenario_id FROM (
  SELECT scenario_id, CASE WHEN global_state_index % 101 = 0 THEN 'test' ELSE split END AS split FROM states) GROUP BY 1 HAVING count(DISTINCT split) > 1)""", "states")
def au11(s, d):
    broken = a.states(s, d).withColumn("split", F.expr("case when global_state_index % 101 = 0 then 'test' else split end"))
    return audit.split_leakage(broken)


# quality report

_CAND = """count(*) AS n, round(avg(pre_repair_feasible::INT), 6) AS pre_feasible, round(avg(hard_feasible::INT), 6) AS feasible, round(avg(fallback_used::INT), 6) AS fallback,
  round(avg((repair_distance > 1e-12)::INT), 6) AS repaired, round(avg(repair_distance), 9) AS mean_distance, round(quantile_cont(repair_distance, 0.95), 6) AS p95_distance"""


@query("qr1_candidate_summary", f"""SELECT candidate_source, bucket, {_CAND} FROM (
  SELECT *, CASE WHEN teacher_confidence < 0.5 THEN 'low' WHEN teacher_confidence < 0.8 THEN 'medium' ELSE 'high' END AS bucket FROM candidates)
  GROUP BY GROUPING SETS ((), (candidate_source), (bucket))""", "candidates")
def qr1(s, d):
    return quality.candidate_summary(a.candidates(s, d)).drop("part")


@query("qr1_selected_summary", f"SELECT {_CAND} FROM candidates JOIN selected ON selected.state_id = candidates.state_id AND selected_index = candidate_index", "candidates", "selected")
def qr1_selected(s, d):
    won = ve.select(ranked(s, d)).select("state_id", "selected_index")
    c = a.candidates(s, d).join(won.hint("merge"), "state_id").withColumn("won", F.expr("candidate_index = selected_index"))
    return quality.candidate_summary(c, "won", ("selected",)).drop("part", "candidate_source", "bucket")


@query("qr4_role_compliance", "SELECT round(avg((k = 1)::INT), 6) AS compliance FROM (SELECT state_id, count(*) FILTER (pair = 0) AS k FROM candidates GROUP BY 1)", "candidates")
def qr4(s, d):
    return quality.role_compliance(a.candidates(s, d))


_TARGET = {"ordinary": 0.35, "freshness_stress": 0.25, "sensing_stress": 0.15, "secrecy_stress": 0.15, "boundary_rare": 0.10}


@query("qr6_distribution_error", "SELECT label, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM states), 8) AS actual, target, round(abs(coalesce(n, 0) / (SELECT count(*) FROM states) - target), 8) AS error FROM (VALUES "
       + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _TARGET.items()) + ") t(label, target) FULL JOIN (SELECT state_category AS label, count(*) AS n FROM states GROUP BY 1) USING (label)", "states")
def qr6(s, d):
    return quality.distribution_error(a.states(s, d), "state_category", _TARGET)


@query("qr9_duplicate_rate", "SELECT round(sum(n - 1) / sum(n), 8) AS duplicate_rate FROM (SELECT count(*) AS n FROM states GROUP BY causal_state_hash)", "states")
def qr9(s, d):
    return quality.duplicate_rate(a.states(s, d))


@query("qr18_latency_report", "SELECT round(avg(latency_s), 6) AS mean_latency, round(quantile_cont(latency_s, 0.95), 6) AS p95_latency, round(avg(completion_tokens), 6) AS mean_tokens FROM requests", "requests")
def qr18(s, d):
    return quality.latency_report(a.requests(s, d))


# merge and tournament


@query("tr5_cache_upsert", "SELECT cache_key, arg_max(request_id, (source <> 'src1', state_id::BIGINT)) AS request_id FROM requests GROUP BY 1", "requests")
def tr5(s, d):
    r = a.requests(s, d).select("cache_key", "request_id", "source", F.col("state_id").cast("long").alias("at"))
    old = F.coalesce(F.col("source") == "src1", F.lit(False))
    return shards.cache_upsert(r.where(old), r.where(~old), "at").select("cache_key", "request_id")


@query("tr4_cache_misses", "SELECT DISTINCT cache_key FROM requests WHERE cache_key NOT IN (SELECT cache_key FROM requests WHERE source = 'src1')", "requests")
def tr4(s, d):
    r = a.requests(s, d)
    return shards.cache_misses(r, r.where("source = 'src1'"))


# slot logs


@query("ts1_age_of_information", """SELECT entity, slot, CASE WHEN l IS NULL THEN least(5 + slot, 20) ELSE least(1 + slot - l, 20) END AS age FROM (
  SELECT entity, slot, max(CASE WHEN delivered THEN slot END) OVER (PARTITION BY entity ORDER BY slot) AS l FROM slot_log)""", "slot_log")
def ts1(s, d):
    return freshness.age(a.slot_log(s, d), "delivered", 20, 5).select("entity", "slot", "age")


@query("ts4_waiting_time", """SELECT entity, slot, CASE WHEN l IS NULL THEN least(slot, 20) ELSE least(slot - l, 20) END AS waiting FROM (
  SELECT entity, slot, max(CASE WHEN scheduled THEN slot END) OVER (PARTITION BY entity ORDER BY slot) AS l FROM slot_log)""", "slot_log")
def ts4(s, d):
    return freshness.waiting(a.slot_log(s, d), "scheduled", 20).select("entity", "slot", "waiting")


@query("ts6_virtual_queue", """SELECT entity, count(*) AS slots, round(list_reduce(list_prepend(0.0::DOUBLE, list(increment ORDER BY slot)), lambda q, g: least(25, greatest(0, q + g))), 6) AS queue FROM slot_log GROUP BY entity""", "slot_log")
def ts6(s, d):
    q = freshness.virtual_queue(a.slot_log(s, d), 25.0)
    return q.groupBy("entity").agg(F.count("*").alias("slots"), F.round(F.max_by("queue", "slot"), 6).alias("queue"))


@query("ts7_sensing_availability", """SELECT s.entity, s.slot, max(j.timestamp) AS newest FROM slot_log s LEFT JOIN sensing_jobs j ON j.entity = s.entity AND j.ready_slot <= s.slot GROUP BY 1, 2""", "sensing_jobs")
def ts7(s, d):
    return freshness.sensing_availability(a.slot_log(s, d), a.sensing_jobs(s, d)).select("entity", "slot", F.col("available.timestamp").alias("newest"))


@query("ts13_episode_kpis", """SELECT policy, count(*) AS n, round(avg(value), 6) AS mean_stage_cost, round(avg(slot), 6) AS mean_aoi, round(avg(slot / 2), 6) AS mean_aoli, round(avg(slot / 4), 6) AS mean_aosi, round(avg(abs(increment)), 6) AS mean_repair_distance,
  round(avg(intercepted::INT), 6) AS fallback_rate, round(avg((value > 60)::INT), 6) AS hard_failure_rate, round(sum(delivered::INT * 2) / count(*), 6) AS deliveries_per_transition, round(avg(covariance_trace), 6) AS trace, round(avg(energy), 6) AS energy, round(avg(delivered::INT), 6) AS delivery_rate,
  round(avg(detected::INT), 6) AS detection_rate FROM slot_log GROUP BY 1""", "slot_log")
def ts13(s, d):
    log = a.slot_log(s, d).selectExpr("*", "value as stage_cost", "cast(slot as double) as mean_aoi", "slot / 2 as mean_aoli", "slot / 4 as aosi", "abs(increment) as repair_distance", "intercepted as fallback_used", "value <= 60 as hard_feasible", "cast(delivered as int) * 2 as deliveries")
    return freshness.episode_kpis(log)


# links


@query("lk1_path_loss", "SELECT l_partkey, max(round(20 * log10(4 * pi() * 2e9 * distance / 299792458.0), 6)) AS loss_db FROM links GROUP BY 1", "links")
def lk1(s, d):
    return a.links(s, d).groupBy("l_partkey").agg(F.max(F.round(links.path_loss_db("distance", 2e9), 6)).alias("loss_db"))


@query("lk3_noma_kpis", """SELECT l_orderkey, round(sum(log2(1 + least(far_power * far_gain / (near_power * far_gain + 2 * disturbance), far_power * near_gain / (near_power * near_gain + disturbance)))), 4) AS far_rate, round(sum(near), 4) AS near_rate,
  sum((0.5 * near >= 1.5)::INT)::BIGINT AS completed, round(sum(CASE WHEN near_gain > 0 THEN ((near_power + far_power) * near_gain - 0.2 * disturbance) / (near_gain * 1.2) END) / 7, 6) AS near_cap, count(*) FILTER (near_gain = 0) AS endless
  FROM (SELECT *, log2(1 + near_power * near_gain / (0.1 * far_power * near_gain + disturbance)) AS near FROM (SELECT * REPLACE (CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE near_gain END AS near_gain) FROM links)) GROUP BY 1""", "links")
def lk3(s, d):
    x = a.links(s, d).withColumns({"near_gain": F.expr("case when l_suppkey % 7 = 0 then 0D else near_gain end"), "near_disturbance": F.col("disturbance"), "far_disturbance": 2 * F.col("disturbance")})
    k = links.noma_kpis(x, residual=0.1).withColumns({"done": links.packet_completed("near_rate", 0.5, 1.5), "cap": links.near_power_cap(0.2)})
    endless = F.col("cap") == float("-inf")
    return k.groupBy("l_orderkey").agg(
        F.round(F.sum("far_rate"), 4).alias("far_rate"), F.round(F.sum("near_rate"), 4).alias("near_rate"), F.count_if("done").alias("completed"), F.round(F.sum(F.when(~endless, F.col("cap"))) / 7, 6).alias("near_cap"), F.count_if(endless).alias("endless"))


# training and evaluation


@query("td2_training_batches", """SELECT state_id, (row_number() OVER (ORDER BY sha256('3:' || state_id)) - 1) // 256 AS batch FROM states WHERE split = 'train'""", "states")
def td2(s, d):
    return training.training_batches(a.states(s, d).where("split = 'train'"), 256, 3).select("state_id", "batch")


@query("td8_split_counts", "SELECT split, count(*) AS n FROM states GROUP BY 1", "states")
def td8(s, d):
    return training.split_counts(a.states(s, d))


@query("ev1_seed_means_ci", """SELECT method, count(*) AS seeds, round(avg(m), 4) AS mean, round(2.262 * stddev_samp(m) / sqrt(count(*)), 4) AS half_width, round(quantile_cont(m, 0.5), 4) AS median, round(quantile_cont(m, 0.95), 4) AS tail FROM (
  SELECT method, seed, avg(cost) AS m FROM seed_results GROUP BY 1, 2) GROUP BY 1""", "seed_results")
def ev1(s, d):
    return training.seed_means_ci(a.seed_results(s, d))


@query("ev2_paired_comparison", """SELECT count(*) AS seeds, round(avg(gap), 4) AS mean_gap, round(2.262 * stddev_samp(gap) / sqrt(count(*)), 4) AS half_width, round(avg(win), 6) AS win_rate FROM (SELECT seed, avg(x.m - y.m) AS gap, avg((x.m < y.m)::INT) AS win
  FROM (SELECT seed, scenario, avg(cost) AS m FROM seed_results WHERE method = 'A' GROUP BY 1, 2) x JOIN (SELECT seed, scenario, avg(cost) AS m FROM seed_results WHERE method = 'N' GROUP BY 1, 2) y USING (seed, scenario) GROUP BY 1)""", "seed_results")
def ev2(s, d):
    return training.paired_comparison(a.seed_results(s, d), "A", "N")


@query("ev4_fifth_percentile_rate", "SELECT method, seed, round(sum(rate), 2) AS sum_rate, round(quantile_cont(rate, 0.05), 2) AS p05_rate FROM seed_results GROUP BY 1, 2", "seed_results")
def ev4(s, d):
    return training.fifth_percentile_rate(a.seed_results(s, d))

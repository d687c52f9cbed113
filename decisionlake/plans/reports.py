"""Further registered queries: decisions against baselines, gates, templates, scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.operators import evaluation as ev
from decisionlake.plans.catalog import NEEDS, STEPS, query, ranked
from decisionlake.sources import adapters as a

STEPS["scores"] = """SELECT state_id, arg_min(risk, rank) AS selected, min(risk) FILTER (candidate_source = 'greedy_baseline') AS greedy,
  min(risk) FILTER (candidate_source = 'safe_template') AS random FROM ranked GROUP BY state_id"""

NEEDS["scores"] = ["ranked"]


def scores(s, d, r=None):
    own = "case when candidate_source = '{}' then risk end"
    return (ranked(s, d) if r is None else r).groupBy("state_id").agg(
        F.min_by("risk", "rank").alias("selected"), F.min(F.expr(own.format("greedy_baseline"))).alias("greedy"), F.min(F.expr(own.format("safe_template"))).alias("random")
    )


@query("qr7_decision_counts", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'practically_equivalent' WHEN o_orderstatus = 'F' THEN 'decisive'
  WHEN o_orderkey % 3 = 2 OR o_orderkey % 3 = 1 THEN 'unresolved' ELSE 'decisive' END AS status FROM orders) GROUP BY 1""")
def qr7(s, d):
    o = a.table(s, d, "orders").selectExpr(
        "case o_orderstatus when 'P' then 'practically_equivalent' when 'F' then 'decisive' else 'other' end as decision_status",
        "case o_orderkey % 3 when 0 then false when 1 then true end as selection_uncertain",
    )
    return o.select(ev.decision_status("decision_status", "selection_uncertain").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("lk8_greedy_decision", """SELECT vec_id, pair, round(1 - least(0.7, greatest(0.2, 0.2 + 0.4 * e[40] + 0.1 * sqrt(list_sum(list_transform(e[45:54], lambda x: x * x))))), 8) AS eta_communication,
  CASE WHEN e[14 * (pair - 1) + 2] >= e[14 * (pair - 1) + 1] THEN 0.15 ELSE 0.3 END::DOUBLE AS eta_near, round(least(1, greatest(0, 0.4 + e[40])), 8) AS eta_cpu FROM (
  SELECT *, list_position(u, list_max(u))::INT AS pair FROM (SELECT vec_id, embedding::DOUBLE[] AS e, [e[14 * k + 1] + e[14 * k + 2] + 0.5::DOUBLE * e[14 * k + 14] FOR k IN range(4)] AS u FROM embeddings))""")
def lk8(s, d):
    v = a.table(s, d, "embeddings").selectExpr("vec_id", "transform(embedding, x -> cast(x as double)) as e")
    v = v.selectExpr("vec_id", "transform(sequence(0, 3), k -> slice(e, 14 * k + 1, 14)) as pair_tokens", "slice(e, 40, 25) as global_features")
    pair, communication, near, cpu = ev.greedy_decision("pair_tokens", "global_features")
    return v.select("vec_id", pair, communication, near, cpu).withColumns({"eta_communication": F.round("eta_communication", 8), "eta_cpu": F.round("eta_cpu", 8)})


@query("lk9_grid_search", """SELECT o_orderkey, 9::BIGINT AS evaluated, infeasible::INT AS infeasible, round(cost, 10) AS cost, round(sel - cost, 10) AS regret, x, y FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY infeasible, cost, distance, x, y) AS rn FROM (
  SELECT o_orderkey, x, y, x + y > w AS infeasible, abs(x * 400000 - o_totalprice) / 400000 + 0.1::DOUBLE * y AS cost, abs(x - y) AS distance, abs(0.5 * 400000 - o_totalprice) / 400000 + 0.04::DOUBLE AS sel
  FROM (SELECT *, 0.3::DOUBLE + (o_custkey % 5) / 4.0::DOUBLE AS w FROM orders) CROSS JOIN (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS x) CROSS JOIN (SELECT unnest([0.0, 0.4, 0.9])::DOUBLE AS y))) WHERE rn = 1""")
def lk9(s, d):
    o = a.table(s, d, "orders").selectExpr("o_orderkey", "o_totalprice", "0.3D + (o_custkey % 5) / 4.0D as w")
    best = ev.grid_search(o, ["o_orderkey"], {"x": [0.2, 0.5, 0.8], "y": [0.0, 0.4, 0.9]}, "x + y > w", "abs(x * 400000 - o_totalprice) / 400000 + 0.1D * y", "abs(x - y)", "abs(0.5D * 400000 - o_totalprice) / 400000 + 0.04D")
    return best.withColumns({c: F.round(c, 10) for c in ("cost", "regret")})


@query("tr16_nearest_template", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'p' || p || '_sense' || w || 'w' AS resolved FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p, CASE WHEN p IS NULL OR (p = 1 AND l_suppkey % 2 = 0 AND q > 18) THEN NULL WHEN q < 6 THEN 2 WHEN q <= 14 THEN 10
    WHEN p = 1 AND l_suppkey % 2 = 0 THEN 10 WHEN q <= 26 THEN 18 END AS w
  FROM (SELECT *, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 5 END AS p, l_quantity::INT AS q FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)))""")
def tr16(s, d):
    line = a.table(s, d, "lineitem").join(a.table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
    line = line.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_suppkey as string) as state_id", "concat(' P', l_partkey % 5, '-Sense', cast(l_quantity as int), 'W') as template_id")
    offered = a.table(s, d, "supplier").selectExpr("s_suppkey", "explode(sequence(1, 4)) as p").selectExpr("s_suppkey", "p", "explode(array(2, 10, 18)) as w")
    offered = offered.where("not (p = 1 and w = 18 and s_suppkey % 2 = 0)").selectExpr("cast(s_suppkey as string) as state_id", "concat('p', p, '_sense', w, 'w') as template_id")
    return ev.nearest_template(line, offered).drop("state_id", "template_id")


_LOGITS = "SELECT vec_id, label, embedding::DOUBLE[] AS e, (vec_id % 10 + 1) / 10.0::DOUBLE AS w FROM embeddings"


def predictions(s, d):
    return a.table(s, d, "embeddings").selectExpr("vec_id", "label % 5 as pair", "label % 3 as ris", "transform(embedding, x -> cast(x as double)) as e", "(vec_id % 10 + 1) / 10.0D as w")


@query("td9_score_predictions", f"""SELECT round(sum((list_position(e[33:37], list_max(e[33:37])) - 1 = label % 5)::INT * w) / sum(w), 8) AS pair_top1_accuracy, round(sum((list_position(e[38:40], list_max(e[38:40])) - 1 = label % 3)::INT * w) / sum(w), 8) AS ris_top1_accuracy,
  round(sum(list_avg([abs(CASE WHEN i = 4 THEN (exp(2 * e[41 + i]) - 1) / (exp(2 * e[41 + i]) + 1) ELSE 1 / (1 + exp(-e[41 + i])) END - e[48 + i]) FOR i IN range(7)]) * w) / sum(w), 8) AS continuous_mae FROM ({_LOGITS})""")
def td9(s, d):
    p = predictions(s, d).withColumns({"logits": F.slice("e", 33, 5), "ris_logits": F.slice("e", 38, 3), "means": F.slice("e", 41, 7), "chosen": F.slice("e", 48, 7)})
    return ev.score_predictions(p, {"pair": ("logits", "pair"), "ris": ("ris_logits", "ris")}, "w", "means", "chosen")


@query("td10_soft_cross_entropy", f"""SELECT vec_id, round(list_sum([(0.9 * (k = label % 5)::INT + 0.02) * (ln(list_sum([exp(x) FOR x IN e[33:37]])) - e[33 + k]) FOR k IN range(5)]), 6) AS loss FROM ({_LOGITS})""")
def td10(s, d):
    p = predictions(s, d).withColumns({"logits": F.slice("e", 33, 5), "target": F.expr("transform(sequence(0, 4), k -> case when k = pair then 1D else 0D end)")})
    return p.select("vec_id", F.round(ev.soft_cross_entropy("logits", "target", 5, 0.1), 6).alias("loss"))


@query("td11_action_nll", f"""SELECT vec_id, round(list_sum([0.5 * (power((CASE WHEN i = 4 THEN atanh(least(0.9999, greatest(-0.9999, e[52 + i]))) ELSE ln(u(e[52 + i]) / (1 - u(e[52 + i]))) END - e[38 + i]) / exp(e[45 + i]), 2)
  + 2 * e[45 + i] + ln(2 * pi())) - CASE WHEN i = 4 THEN ln(1 - power(least(0.9999, greatest(-0.9999, e[52 + i])), 2)) ELSE ln(u(e[52 + i])) + ln(1 - u(e[52 + i])) END FOR i IN range(7)]), 5) AS loss FROM ({_LOGITS})"""
  .replace("u(e[52 + i])", "least(0.9999, greatest(0.0001, e[52 + i]))"))
def td11(s, d):
    p = predictions(s, d).withColumns({"mean": F.slice("e", 38, 7), "log_std": F.slice("e", 45, 7), "target": F.slice("e", 52, 7)})
    return p.select("vec_id", F.round(ev.action_nll("mean", "log_std", "target", 4), 5).alias("loss"))


@query("td4_soft_class_targets", """SELECT state_id, k AS class, round(coalesce(sum(l_quantity) FILTER (pair = k), 0) / sum(l_quantity), 8) AS target FROM candidates CROSS JOIN range(5) r(k) GROUP BY 1, 2""", "candidates")
def td4(s, d):
    c = a.candidates(s, d).groupBy("state_id").agg(F.collect_list(F.struct(F.col("pair").alias("label"), F.col("l_quantity").cast("double").alias("weight"))).alias("targets"))
    c = c.select("state_id", F.posexplode(ev.soft_class_targets("targets", 5)).alias("class", "target"))
    return c.select("state_id", F.col("class").cast("long").alias("class"), F.round("target", 8).alias("target"))


@query("ts12_extrapolate", """SELECT event_id, round(value + value / 10 * n * 0.1, 8) AS x, round(value / 10, 8) AS v, round(4 + 0.2 * n * 0.5 + n * n * 0.01 * 2 + 2.25 * 0.0001 * n * (4 * n * n - 1) / 12, 8) AS pxx,
  round(0.5 + n * 0.2 + 2.25 * 0.001 * n * n / 2, 8) AS pxv, round(2 + 2.25 * 0.01 * n, 8) AS pvv FROM (SELECT event_id, value, (event_id % 6)::DOUBLE AS n FROM events)""")
def ts12(s, d):
    e = a.table(s, d, "events")
    x, n = F.col("value"), (F.col("event_id") % 6).cast("double")
    parts = ev.extrapolate(x, x / 10, F.lit(4.0), F.lit(0.5), F.lit(2.0), n, 0.1, 1.5)
    return e.select("event_id", *parts).select("event_id", *(F.round(c, 8).alias(c) for c in ("x", "v", "pxx", "pxv", "pvv")))


@query("fe7_gain_feature", """SELECT vec_id, round(least(1, greatest(0, (10 * log10(greatest(list_sum([x * x FOR x IN e[1:32]]) * 1e-14, 1e-30)) + 180) / 80)), 8) AS gain FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def fe7(s, d):
    v = a.table(s, d, "embeddings").selectExpr("vec_id", "transform(embedding, x -> cast(x as double) * 1e-7D) as e").withColumns({"re": F.slice("e", 1, 16), "im": F.slice("e", 17, 16)})
    return v.select("vec_id", F.round(ev.gain_feature("re", "im"), 8).alias("gain"))


@query("mg9_common_state_check", """SELECT cache_key AS state_id, count(DISTINCT teacher_label) AS teachers FROM requests GROUP BY 1 HAVING count(DISTINCT teacher_label) < (SELECT count(DISTINCT teacher_label) FROM requests)""", "requests")
def mg9(s, d):
    return ev.uncommon_states(a.requests(s, d).select("teacher_label", F.col("cache_key").alias("state_id")))



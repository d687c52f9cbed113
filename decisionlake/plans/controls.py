"""Further registered queries: controls, costs, responses, audits, training, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decisionlake.functions import control, freshness, links
from decisionlake.operators import audit, quality, responses, shards, teacher as te, training
from decisionlake.plans.catalog import STEPS, query, ranked, rounded, rounded_sql, summary
from decisionlake.sources import adapters as a
from decisionlake.sources import tables
from decisionlake.sources.store import BucketTable
from decisionlake.sources.tables import shared_folder
from decisionlake.streaming import streams

_CONTROLS = ["eta_haps", "eta_communication", "eta_near", "eta_jamming", "heading", "speed", "eta_cpu"]
STEPS["actions"] = """SELECT l_orderkey, l_linenumber, l_partkey % 7 - 1 AS pair, l_quantity / 40 AS eta_haps, (l_suppkey % 11) / 9.0::DOUBLE AS eta_communication, l_discount * 10 AS eta_near,
  l_tax * 20 AS eta_jamming, l_linenumber - 4.0::DOUBLE AS heading, l_quantity / 45 - 0.1::DOUBLE AS speed, (l_partkey % 3) / 2.0::DOUBLE AS eta_cpu FROM lineitem"""
_CLIPPED = """SELECT l_orderkey, l_linenumber, CASE WHEN pair BETWEEN 0 AND 4 THEN pair ELSE -1 END AS pair, least(1, greatest(0, eta_haps)) AS eta_haps, least(1, greatest(0, eta_communication)) AS eta_communication,
  least(0.5, greatest(0, eta_near)) AS eta_near, least(1, greatest(0, eta_jamming)) AS eta_jamming, least(pi(), greatest(-pi(), heading)) AS heading, least(1, greatest(0, speed)) AS speed, least(1, greatest(0, eta_cpu)) AS eta_cpu FROM actions"""


def actions(s, d):
    return a.table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey % 7 - 1 as pair", "l_quantity / 40 as eta_haps", "(l_suppkey % 11) / 9.0D as eta_communication", "l_discount * 10 as eta_near",
        "l_tax * 20 as eta_jamming", "l_linenumber - 4.0D as heading", "l_quantity / 45 - 0.1D as speed", "(l_partkey % 3) / 2.0D as eta_cpu",
    )


@query("fe12_clip_action", f"SELECT l_orderkey, l_linenumber, 0 AS ris_code, pair, {rounded_sql(*_CONTROLS)} FROM ({_CLIPPED})", "actions")
def fe12(s, d):
    return control.clip_action(actions(s, d).withColumn("ris_code", F.col("l_linenumber") % 3), 4).select("l_orderkey", "l_linenumber", "ris_code", "pair", *rounded(*_CONTROLS))


@query("fe11_decode_action", """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-eta_haps)), 10) AS eta_haps, round(0.5 / (1 + exp(-eta_near)), 10) AS eta_near,
  round(pi() * (exp(2 * heading) - 1) / (exp(2 * heading) + 1), 8) AS heading, round(1 / (1 + exp(-speed)), 10) AS speed FROM actions""", "actions")
def fe11(s, d):
    return control.decode_action(actions(s, d)).select("l_orderkey", "l_linenumber", *rounded("eta_haps", "eta_near"), F.round("heading", 8).alias("heading"), *rounded("speed"))


@query("fe13_repair_distance", """SELECT l_orderkey, round(sum((CASE WHEN pair BETWEEN 0 AND 4 THEN 0 ELSE abs(pair + 1) / 4 END + abs(eta_haps - least(1, greatest(0, eta_haps))) + abs(eta_communication - least(1, greatest(0, eta_communication)))
  + 2 * abs(eta_near - least(0.5, greatest(0, eta_near))) + abs(eta_jamming - least(1, greatest(0, eta_jamming))) + abs(heading - least(pi(), greatest(-pi(), heading))) / pi()
  + abs(speed - least(1, greatest(0, speed))) + abs(eta_cpu - least(1, greatest(0, eta_cpu)))) / 8), 8) AS distance FROM actions GROUP BY 1""", "actions")
def fe13(s, d):
    names = ["pair", *_CONTROLS]
    both = actions(s, d).withColumn("before", F.struct(*names))
    both = control.clip_action(both, 4).withColumn("after", F.struct(*names))
    return both.groupBy("l_orderkey").agg(F.round(F.sum(control.repair_distance("before", "after", 4)), 8).alias("distance"))


@query("fe6_queue_features", "SELECT event_id, round(least(1, ln(1 + least(60, greatest(0, value))) / ln(1 + 50.0::DOUBLE)), 10) AS feature FROM events")
def fe6(s, d):
    return a.table(s, d, "events").select("event_id", F.round(control.queue_features(F.array("value"), 50.0, 60.0)[0], 10).alias("feature"))


@query("fe14_unit_conversions", "SELECT p_partkey, round(10 * log10(p_retailprice), 8) AS db, round(power(10, p_size / 10.0::DOUBLE), 4) AS linear, round(-204 + 10 * log10(p_retailprice * 1000), 8) AS noise_db FROM part")
def fe14(s, d):
    price = F.col("p_retailprice")
    return a.table(s, d, "part").select(
        "p_partkey", F.round(control.linear_to_db(price), 8).alias("db"), F.round(control.db_to_linear(F.col("p_size")), 4).alias("linear"),
        F.round(control.linear_to_db(control.thermal_noise_watts(price * 1000)), 8).alias("noise_db"),
    )


@query("lk6_complete_action", f"""SELECT l_orderkey, round(sum(c), 6) AS communication_power, round(sum(eta_haps * 50 - c), 6) AS sensing_power, round(sum(eta_near * c), 6) AS near_power, round(sum(1e9 + eta_cpu * 2e9), 2) AS cpu_hz
  FROM (SELECT *, CASE WHEN pair = 0 THEN 0 ELSE eta_communication * eta_haps * 50 END AS c FROM ({_CLIPPED})) GROUP BY 1""", "actions")
def lk6(s, d):
    done = control.complete_action(control.clip_action(actions(s, d), 4), 50.0, 1e9, 3e9)
    return done.groupBy("l_orderkey").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("communication_power", "sensing_power", "near_power")], F.round(F.sum("cpu_hz"), 2).alias("cpu_hz"))


@query("lk4_secrecy_kpis", """SELECT l_orderkey, round(sum(greatest(0, far_rate - tf)), 4) AS far_secrecy, round(sum(greatest(0, near_rate - tn)), 4) AS near_secrecy, sum((near_rate - tn < 0.5)::INT)::BIGINT AS outages FROM (
  SELECT l_orderkey, least(log2(1 + far_power * far_gain / (near_power * far_gain + disturbance)), log2(1 + far_power * near_gain / (near_power * near_gain + disturbance))) AS far_rate,
  log2(1 + near_power * near_gain / disturbance) AS near_rate, log2(1 + far_power * t / (near_power * t + disturbance)) AS tf, log2(1 + near_power * t / (0.1 * far_power * t + disturbance)) AS tn
  FROM (SELECT *, 0.5 * far_gain AS t FROM links)) GROUP BY 1""", "links")
def lk4(s, d):
    k = links.secrecy_kpis(links.noma_kpis(a.links(s, d)).withColumn("target_gain", 0.5 * F.col("far_gain")), 0.1, 0.5, 1.0, 2.0)
    return k.groupBy("l_orderkey").agg(F.round(F.sum("far_secrecy"), 4).alias("far_secrecy"), F.round(F.sum("near_secrecy"), 4).alias("near_secrecy"), F.count_if("near_outage").alias("outages"))


@query("lk5_sensing_kpis", "SELECT l_orderkey, sum((near_power / disturbance >= 3)::INT)::BIGINT AS detected, round(sum(2 / greatest(near_power / disturbance, 0.5)), 6) AS range_variance FROM links GROUP BY 1", "links")
def lk5(s, d):
    k = links.sensing_kpis(a.links(s, d).withColumn("sinr", F.col("near_power") / F.col("disturbance")), 3.0, 0.5, {"range": 2.0, "angle": 0.1, "doppler": 0.5})
    return k.groupBy("l_orderkey").agg(F.count_if("detected").alias("detected"), F.round(F.sum("range_variance"), 6).alias("range_variance"))


@query("ts2_age_of_leakage", """SELECT entity, slot, CASE WHEN l IS NULL THEN least(20 + slot, 50) ELSE least(1 + slot - l, 50) END AS age FROM (
  SELECT entity, slot, max(CASE WHEN intercepted THEN slot END) OVER (PARTITION BY entity ORDER BY slot) AS l FROM slot_log)""", "slot_log")
def ts2(s, d):
    return freshness.age(a.slot_log(s, d), "intercepted", 50, 20).select("entity", "slot", "age")


@query("ts3_age_of_sensing", """SELECT entity, slot, CASE WHEN l IS NULL THEN least(5 + slot, 30) ELSE least(least(greatest(1, 2), 30) + slot - l, 30) END AS age FROM (
  SELECT entity, slot, max(CASE WHEN detected THEN slot END) OVER (PARTITION BY entity ORDER BY slot) AS l FROM slot_log)""", "slot_log")
def ts3(s, d):
    log = a.slot_log(s, d).withColumn("accepted", F.expr("case when detected then slot - 2 end"))
    return freshness.sensing_age(log, "accepted", 30, 5).select("entity", "slot", "age")


@query("ts8_processing_delay", """SELECT event_id, greatest(1, ceil(value * 1e7 / (1e9 * 0.1)))::BIGINT AS delay, round(0.1 * (value + 2) + 1e-28 * value * 1e7 * 1e18, 10) AS energy FROM events""")
def ts8(s, d):
    cycles, hz = F.col("value") * 1e7, F.lit(1e9)
    return a.table(s, d, "events").select("event_id", control.processing_delay(cycles, hz, 0.1).alias("delay"), F.round(control.slot_energy(F.col("value"), F.lit(2.0), 0.1, 1e-28, cycles, hz), 10).alias("energy"))


_PARTS = ("increment", "0.2 - increment", "energy - 0.5", "0.1 - energy", "increment * 2", "slot % 3 - 1.5")


@query("ts9_stage_cost", f"""SELECT policy, round(avg(0.3 * (slot % 20 + slot % 7) / 2 / 50 + 0.2 * (slot % 11) / 50 + 0.3 * covariance_trace / 50000 + 0.2 * energy / 2), 8) AS cost, round(avg({' + '.join(f'greatest({x}, 0)' for x in _PARTS)}), 8) AS violation,
  round(avg(CASE WHEN increment > 0 THEN (increment + 1) / 2 ELSE 1 END), 8) AS growth FROM slot_log GROUP BY 1""", "slot_log")
def ts9(s, d):
    names = control.VIOLATIONS
    log = a.slot_log(s, d).selectExpr("*", "array(slot % 20, slot % 7) as aoi", "slot % 11 as aosi", "array(increment, 1D, -2D) as increments", *(f"{x} as {n}" for n, x in zip(names, _PARTS)))
    log = log.withColumn("mean_aoi", control.mean_age("aoi"))
    cost = control.stage_cost({"mean_aoi": (0.3, 50.0), "aosi": (0.2, 50.0), "covariance_trace": (0.3, 50000.0), "energy": (0.2, 2.0)})
    return log.groupBy("policy").agg(*(F.round(F.avg(x), 8).alias(n) for n, x in (("cost", cost), ("violation", control.violation_total()), ("growth", control.mean_positive("increments")))))


@query("ts14_non_finite_check", "SELECT count(*) AS bad FROM slot_log WHERE increment IS NULL OR increment = 0 OR NOT isfinite(increment) OR value > 90", "slot_log")
def ts14(s, d):
    return a.slot_log(s, d).withColumn("inverse", F.expr("try_divide(1D, increment)")).where(control.non_finite(["increment", "inverse"], {"value": (float("-inf"), 90.0)})).agg(F.count("*").alias("bad"))


# responses


@query("tr2_cache_key", """SELECT request_id, sha256('{"model_id":' || coalesce('"' || teacher_label || '"', 'null') || ',"model_revision":' || coalesce('"' || source || '"', 'null') || ',"prompt_hash":' || coalesce('"' || cache_key || '"', 'null') || ',"sampling":{"max_tokens":' || coalesce(completion_tokens::VARCHAR, 'null') || ',"top_k":40},"seed":7}') AS key FROM requests""", "requests")
def tr2(s, d):
    key = responses.cache_key(F.col("teacher_label"), F.col("source"), F.col("cache_key"), {"top_k": F.lit(40), "max_tokens": F.col("completion_tokens")}, F.lit(7))
    return a.requests(s, d).select("request_id", key.alias("key"))


def cached(s, d):
    """A cache of the responses of one source, in buckets, and all requests, written."""
    r = a.requests(s, d).withColumns({"text": F.concat("source", F.lit(":"), "state_id"), "k": F.col("state_id").cast("long")})
    r.write.parquet(path := shared_folder(s, "requests"))
    r = s.read.schema(r.schema).parquet(path)
    cache = shards.response_cache(s, shared_folder(s, "cache"), 16).create()
    mine = r.where("source = 'src1'").selectExpr("cache_key", "text", "cast(null as string) as reasoning_text", "k % 50 as prompt_tokens", "completion_tokens", "k")
    shards.put(cache, mine, "k")
    return r, cache


@query("tr3_cache_lookup", """SELECT request_id, k.cache_key IS NOT NULL AS cached, CASE WHEN k.cache_key IS NULL THEN latency_s ELSE 0 END AS latency_s, CASE WHEN k.cache_key IS NULL THEN r.source || ':' || r.state_id ELSE k.text END AS text,
  CASE WHEN k.cache_key IS NULL THEN r.completion_tokens ELSE k.tokens END AS completion_tokens, k.prompt AS prompt_tokens FROM requests r LEFT JOIN (
  SELECT cache_key, arg_max(source || ':' || state_id, state_id::BIGINT) AS text, max(state_id::BIGINT) % 50 AS prompt, arg_max_null(completion_tokens, state_id::BIGINT) AS tokens FROM requests WHERE source = 'src1' GROUP BY 1) k USING (cache_key)""", "requests")
def tr3(s, d):
    r, cache = cached(s, d)
    return shards.look_up(r, cache).select("request_id", "cached", "latency_s", "text", "completion_tokens", "prompt_tokens")


@query("tr5_cache_table", "SELECT cache_key, arg_max(source || ':' || state_id, (source <> 'src1', state_id::BIGINT)) AS text FROM requests WHERE source IS NOT NULL GROUP BY 1", "requests")
def tr5(s, d):
    r, cache = cached(s, d)
    new = r.where("source <> 'src1'").selectExpr("cache_key", "text", "cast(null as string) as reasoning_text", "cast(null as bigint) as prompt_tokens", "completion_tokens", "k")
    shards.put(cache, new, "k")
    return cache.read().select("cache_key", "text")


@query("tr7_split_reasoning", r"""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS answer, CASE WHEN doc_id % 3 <> 0 THEN source END AS reasoning FROM documents""")
def tr7(s, d):
    r = a.table(s, d, "documents").withColumn("t", F.expr("case when doc_id % 3 = 0 then coalesce(text, '') else concat('<think> ', source, '</think>\n', coalesce(text, '')) end"))
    answer, reasoning = responses.split_reasoning(F.col("t"))
    return r.select("doc_id", F.md5(answer).alias("answer"), reasoning.alias("reasoning"))


@query("tr8_extract_json_object", """SELECT doc_id, CASE WHEN doc_id % 8 < 6 THEN lang END AS lang, CASE WHEN doc_id % 8 < 6 THEN n_chars END AS n_chars, CASE doc_id % 8 WHEN 4 THEN '} {' END AS note FROM documents""")
def tr8(s, d):
    """Objects alone, in a fence, among words, before others, with braces in texts; and none, and null."""
    docs = a.table(s, d, "documents")
    one, noted = F.to_json(F.struct("lang", "n_chars")), F.to_json(F.struct("lang", "n_chars", F.lit("} {").alias("note")))
    shapes = [
        one, F.concat(F.lit("```json\n"), one, F.lit("\n```")), F.concat(F.lit("Sure: "), one, F.lit(" as asked")), F.concat(F.lit("{ not yet "), one, F.lit(" and more {")), F.concat(F.lit("so "), noted, F.lit(' then {"lang":"x"}')),
        F.concat(one, F.lit(' {"lang":"second"}')), F.concat(F.lit("no object: {"), F.substring(one, 2, 4)), F.lit(None).cast("string"),
    ]
    body = F.get(F.array(*shapes), (F.col("doc_id") % 8).cast("int"))
    return docs.select("doc_id", F.from_json(responses.extract_json_object(body), "lang string, n_chars long, note string").alias("r")).select("doc_id", "r.lang", "r.n_chars", "r.note")


@query("tr14_unique_candidates", """SELECT state_id, count(*) AS candidates, count(DISTINCT (pair, l_suppkey % 2, round_even(eta_sensing, 8), round_even(eta_communication, 8), round_even(eta_near, 8), round_even(l_tax, 8), round_even(l_tax - 0.04, 8), round_even(l_tax * 10, 8), round_even(eta_cpu, 8))) AS unique_candidates
  FROM candidates GROUP BY 1""", "candidates")
def tr14(s, d):
    c = a.candidates(s, d).selectExpr("state_id", "pair", "l_suppkey % 2 as ris_code", "eta_sensing as eta_haps", "eta_communication", "eta_near", "l_tax as eta_jamming", "l_tax - 0.04D as aav_heading_rad", "l_tax * 10 as aav_speed_fraction", "eta_cpu")
    return te.unique_ratio(c)


@query("tr18_expand_templates", "SELECT p_partkey, c AS eta_cpu, least((p_size % 10) / 10.0::DOUBLE, 0.3) AS eta_near, 'safe_template' AS candidate_source FROM part CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0)) v(c)")
def tr18(s, d):
    t = a.table(s, d, "part").selectExpr("p_partkey", "(p_size % 10) / 10.0D as recommended_near", "0.3D as max_near")
    return responses.expand_templates(t, [0.0, 0.5, 1.0]).select("p_partkey", "eta_cpu", "eta_near", "candidate_source")


@query("tr21_normalization_notes", "SELECT note, count(*) AS n FROM (SELECT unnest(response_normalization_notes) AS note FROM requests) GROUP BY 1", "requests")
def tr21(s, d):
    return responses.normalization_notes(a.requests(s, d))


# audits and reports


@query("au4_hard_infeasible", "SELECT state_id, candidate_index FROM candidates WHERE NOT hard_feasible", "candidates")
def au4(s, d):
    return audit.hard_infeasible(a.candidates(s, d))


@query("au5_selections_per_state", """SELECT state_id, coalesce(n, 0) AS n FROM states LEFT JOIN (SELECT state_id, count(*) AS n FROM candidates WHERE candidate_source = 'teacher' GROUP BY 1) USING (state_id) WHERE coalesce(n, 0) <> 1""", "states", "candidates")
def au5(s, d):
    return audit.selections_per_state(a.states(s, d), a.candidates(s, d).where("candidate_source = 'teacher'"))


STEPS["targets"] = """SELECT state_id, count(*) AS k, sum(w) AS total, count(DISTINCT i) AS different FROM (SELECT state_id, candidate_index // (CASE WHEN state_id::BIGINT % 7 = 0 THEN 2 ELSE 1 END) AS i,
  CASE WHEN state_id::BIGINT % 5 = 0 THEN teacher_confidence ELSE 1 / count(*) OVER (PARTITION BY state_id) END AS w FROM candidates) GROUP BY 1"""


def targets(s, d):
    """Weighted targets a state, some of them broken on purpose."""
    t = a.candidates(s, d).groupBy("state_id").agg(F.sort_array(F.collect_list(F.struct("candidate_index", "teacher_confidence"))).alias("c"))
    return t.select("state_id", F.expr("""transform(c, x -> named_struct('index', x.candidate_index div (case when cast(state_id as bigint) % 7 = 0 then 2 else 1 end),
      'weight', case when cast(state_id as bigint) % 5 = 0 then x.teacher_confidence else 1D / size(c) end))""").alias("targets"))


@query("au7_targets_valid", "SELECT state_id, abs(total - 1) <= 1e-6 AND different = k AS valid FROM targets", "candidates", "targets")
def au7(s, d):
    return targets(s, d).select("state_id", audit.targets_valid("targets").alias("valid"))


# training and evaluation


@query("td5_continuous_targets", f"SELECT l_orderkey, l_linenumber, pair, {rounded_sql('eta_haps')}, round(least(1, 2 * eta_near), 10) AS eta_near, round(heading / pi(), 10) AS heading FROM ({_CLIPPED})", "actions")
def td5(s, d):
    t = training.continuous_targets(control.clip_action(actions(s, d), 4))
    return t.select("l_orderkey", "l_linenumber", "pair", *rounded("eta_haps", "eta_near", "heading"))


@query("td7_head_size", "SELECT max(pair) + 1 AS classes FROM candidates", "candidates")
def td7(s, d):
    return training.head_size(a.candidates(s, d), "pair")


# sources and streams


@query("io3_json_round_trip", "SELECT * FROM (SELECT state_id, candidate_index, hard_feasible, repair_distance FROM candidates)", "candidates")
def io3(s, d):
    c = a.candidates(s, d).select("state_id", "candidate_index", "hard_feasible", "repair_distance")
    path = tables.shared_folder(s, "candidates")
    tables.write_table(c, path)
    return tables.read_table(s, path, c.schema)


@query("io5_flatten_export", "SELECT l_orderkey, pair AS \"action.pair\", eta_cpu AS \"action.continuous.eta_cpu\" FROM actions", "actions")
def io5(s, d):
    nested = actions(s, d).select("l_orderkey", F.struct("pair", F.struct("eta_cpu").alias("continuous")).alias("action"))
    path = tables.shared_folder(s, "flat")
    tables.flatten_export(nested, path)
    return s.read.parquet(path)


def _events(s, d):
    schema = a.table(s, d, "events").schema
    return streams.stream_table(s, f"{d}/events.parquet*", schema, files=None).withColumn("ts", F.col("ts").cast("timestamp"))


def _time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("st2_windows", """SELECT strftime(time_bucket(INTERVAL 20 MINUTE, ts) - k * INTERVAL 20 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 8) AS mean_value, max(value) AS top_value,
  round(avg(user_id % 100), 8) AS mean_memory, max(user_id % 100) AS top_memory FROM events CROSS JOIN range(3) r(k) GROUP BY 1, 2""")
def st2(s, d):
    events = _events(s, d).withColumn("memory", F.expr("user_id % 100"))
    out = streams.drain(streams.windows(events, ["event_type"], ["value", "memory"], "1 hour", "20 minutes"), ["start", "event_type"], "st2")
    return out.select(_time("start"), "event_type", "n", *(F.round(c, 8).alias(c) for c in ("mean_value", "mean_memory")), "top_value", "top_memory")


@query("st3_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS requests, sum(floor(value * 10)::BIGINT % 100)::BIGINT AS tokens, coalesce(round(sum(floor(value * 10)::BIGINT % 100) / nullif(sum(value), 0), 6), 0) AS tokens_per_second, count(*) FILTER (event_type = 'error') AS errors
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g""")
def st3(s, d):
    events = streams.with_end(_events(s, d))
    out = streams.drain(streams.sessions(events, "user_id", "6 hours", "1 hour", "cast(floor(value * 10) as bigint) % 100", "value", "event_type = 'error'"), ["start", "end", "user_id"], "st3", "append")
    return out.select("user_id", _time("start"), "requests", "tokens", F.round("tokens_per_second", 6).alias("tokens_per_second"), "errors")


@query("st4_distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def st4(s, d):
    return streams.drain(streams.distinct_keys(_events(s, d), ["user_id", "event_type"]).select("user_id", "event_type"), ["user_id", "event_type"], "st4")


@query("st4_once", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def st4_once(s, d):
    """Twice over the same events: the second run finds all keys in the table."""
    schema = StructType.fromDDL("user_id long, event_type string, first_batch long")
    seen = BucketTable(s, shared_folder(s, "seen"), ["user_id", "event_type"], schema, 16).create()
    out, log = shared_folder(s, "once"), shared_folder(s, "once-log")
    events = _events(s, d)
    for _ in range(2):
        streams.once(events, seen, ["event_id"], out, log)
    return s.read.schema(events.schema.add("_batch", "long")).parquet(out).select("user_id", "event_type", "event_id")


@query("st5_rates", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg((event_type = 'error')::INT), 8) AS failed FROM events GROUP BY 1")
def st5(s, d):
    out = streams.drain(streams.rates(_events(s, d).withColumn("failed", F.col("event_type") == "error"), ["failed"], "1 hour"), ["start"], "st5")
    return out.select(_time("start"), "n", F.round("failed", 8).alias("failed"))

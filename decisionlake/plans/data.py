"""Registered queries of features, shards, training inputs, streams and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlake.functions import links
from decisionlake.operators import evaluation as ev, features as fe, merge as me, report, sampling, training, verification as ve
from decisionlake.plans.audits import demonstrations, kept, once, selections
from decisionlake.plans.catalog import NEEDS, STEPS, query, ranked
from decisionlake.sources import adapters as a, tables
from decisionlake.streaming import streams

# features: a vector is an observation of two pairs, to three digits


def vectors(s, d):
    return a.table(s, d, "embeddings").selectExpr("vec_id", "transform(embedding, x -> round(cast(x as double), 3) + 0D) as e")


STEPS["v"] = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x, 3) + 0.0) AS e FROM embeddings"
STEPS["payload"] = """SELECT vec_id, e, '{"global_features":' || to_json(e[29:53]) || ',"pair_mask":[' || (vec_id % 2) || ',1],"pair_tokens":[' || to_json(e[1:14]) || ',' || to_json(e[15:28]) || '],"previous_action":' || to_json(e[54:62])
  || ',"virtual_queues":' || to_json(list_transform(e[1:14], lambda x: abs(x))) || '}' AS j FROM v"""
NEEDS["payload"] = ["v"]


def observations(s, d):
    return vectors(s, d).select("vec_id", F.expr("""named_struct('pair_tokens', array(slice(e, 1, 14), slice(e, 15, 14)), 'pair_mask', array(cast(vec_id % 2 as int), 1), 'global_features', slice(e, 29, 25),
        'virtual_queues', transform(slice(e, 1, 14), x -> abs(x)), 'previous_action', slice(e, 54, 9))""").alias("observation"))


@query("fe1_causal_payload", "SELECT vec_id, e[16] AS token, vec_id % 2 AS mask, e[39] AS g, abs(e[6]) AS queue, e[62] AS previous FROM v", "v")
def fe1(s, d):
    c = fe.causal_payload(observations(s, d))
    return c.select("vec_id", F.expr("causal.pair_tokens[1][1]").alias("token"), F.expr("cast(causal.pair_mask[0] as bigint)").alias("mask"), F.expr("causal.global_features[10]").alias("g"),
                    F.expr("causal.virtual_queues[5]").alias("queue"), F.expr("causal.previous_action[8]").alias("previous"))


@query("fe2_state_hash", "SELECT vec_id, sha256(j) AS hash FROM payload", "payload")
def fe2(s, d):
    return fe.causal_payload(observations(s, d)).select("vec_id", fe.state_hash().alias("hash"))


@query("fe3_name_features", "SELECT vec_id, e[25] AS packet, e[28] AS waiting, e[29] AS aosi, e[39] AS l21, abs(e[12]) AS secrecy, abs(e[13]) AS sensing, e[62] AS eta_cpu FROM v", "v")
def fe3(s, d):
    n = fe.name_features(fe.causal_payload(observations(s, d)), 2)
    return n.select("vec_id", F.expr("named.pairs[1].near_packet_fraction").alias("packet"), F.expr("named.pairs[1].waiting_time_fraction").alias("waiting"), F.expr("named.global.aosi_fraction").alias("aosi"),
                    F.expr("named.global.target_covariance_cholesky_lower_normalized.L22").alias("l21"), F.expr("named.virtual_queues.per_pair[1].far.secrecy_outage_deficit").alias("secrecy"),
                    F.expr("named.virtual_queues.sensing_outage_deficit").alias("sensing"), F.expr("named.previous_action.eta_cpu").alias("eta_cpu"))


@query("fe4_state_metrics", """SELECT vec_id, round(list_sum(e[1:4]) / 4, 8) + 0 AS mean_aoi, list_max(e[1:4]) AS max_aoi, round(list_sum(e[5:8]) / 4, 8) + 0 AS mean_aoli, list_min(e[5:8]) AS min_aoli, round(list_sum(e[9:22]), 8) + 0 AS queue_l1,
  round(sqrt(list_sum([x * x FOR x IN e[9:22]])), 8) AS queue_l2, list_max(e[9:22]) AS queue_max, round(e[23] + e[28] + e[33] + e[38], 8) + 0 AS tracking_covariance_trace, round(list_sum([x * x FOR x IN e[39:46]]), 8) AS power FROM v""", "v")
def fe4(s, d):
    v = vectors(s, d).selectExpr("vec_id", "array(slice(e, 1, 2), slice(e, 3, 2)) as aoi", "array(slice(e, 5, 2), slice(e, 7, 2)) as aoli", "slice(e, 9, 14) as q",
                                 "transform(sequence(0, 3), i -> slice(e, 23 + 4 * i, 4)) as p", "array(slice(e, 39, 4)) as re", "array(slice(e, 43, 4)) as im")
    m = v.select("vec_id", *fe.state_metrics("aoi", "aoli", "q", "p", "re", "im"))
    names = ["mean_aoi", "max_aoi", "mean_aoli", "min_aoli", "queue_l1", "queue_l2", "queue_max", "tracking_covariance_trace"]
    return m.select("vec_id", *(F.round(c, 8).alias(c) for c in names), F.round(F.col("estimated_channel_power")[0], 8).alias("power"))


@query("fe5_tracking_errors", """SELECT vec_id, round(power(e[1] - e[5], 2) + power(e[2] - e[6], 2), 8) AS position_squared_error, round(list_sum([power(e[i] - e[i + 4], 2) / (1 + e[i + 8] * e[i + 8]) FOR i IN range(1, 5)]), 6) AS nees FROM v""", "v")
def fe5(s, d):
    v = vectors(s, d).selectExpr("vec_id", "slice(e, 1, 4) as mean", "slice(e, 5, 4) as truth", "transform(sequence(0, 3), i -> transform(sequence(0, 3), j -> case when i = j then 1 + e[i + 8] * e[i + 8] else 0D end)) as covariance")
    return fe.tracking_errors(v, ["vec_id"]).select("vec_id", F.round("position_squared_error", 8).alias("position_squared_error"), F.round("nees", 6).alias("nees"))


@query("fe15_serialize_observation", "SELECT vec_id, sha256('CAUSAL_STATE_V1' || chr(10) || j || chr(10) || '<ACTION>') AS hash FROM payload", "payload")
def fe15(s, d):
    return fe.causal_payload(observations(s, d)).select("vec_id", F.sha2(fe.serialize_observation(), 256).alias("hash"))


@query("ts5_constraint_increments", """SELECT vec_id, i, round(CASE WHEN i < 4 THEN (5 - 10 * e[i + 1]) / 50 WHEN i < 8 THEN 0.9 - (e[i - 3] > 0)::INT WHEN i < 12 THEN CASE WHEN (i - 8) // 2 + 1 = vec_id % 3 THEN (e[i - 3] > 0)::INT - 0.1 ELSE 0 END
  WHEN i = 12 THEN (vec_id % 2 <> 0)::INT - 0.05 ELSE (100 + e[9]) / 120 - 1 END::DOUBLE, 8) AS g FROM v CROSS JOIN range(14) r(i)""", "v")
def ts5(s, d):
    v = vectors(s, d).selectExpr("vec_id", "transform(slice(e, 1, 4), x -> 10 * x) as aoli", "transform(slice(e, 1, 4), x -> x > 0) as delivered", "transform(slice(e, 5, 4), x -> x > 0) as secrecy_outage",
                                 "vec_id % 3 as scheduled_pair", "vec_id % 2 = 0 as detected", "100 + e[8] as covariance_trace")
    g = fe.constraint_increments(v, 5.0, 50.0, 0.9, 0.1, 0.05, 120.0).select("vec_id", F.posexplode("increments").alias("i", "g"))
    return g.select("vec_id", F.col("i").cast("long").alias("i"), F.round("g", 8).alias("g"))


@query("lk2_beam_gain", """SELECT vec_id, round(power(list_sum([e[i] * e[i + 32] + e[i + 16] * e[i + 48] FOR i IN range(1, 17)]), 2) + power(list_sum([e[i] * e[i + 48] - e[i + 16] * e[i + 32] FOR i IN range(1, 17)]), 2), 6) AS gain FROM v""", "v")
def lk2(s, d):
    return vectors(s, d).select("vec_id", F.round(links.beam_gain(*(F.slice("e", k, 16) for k in (1, 17, 33, 49))), 6).alias("gain"))


# sampling plans


_CATEGORIES = {"ordinary": 0.35, "freshness_stress": 0.25, "sensing_stress": 0.15, "secrecy_stress": 0.15, "boundary_rare": 0.10}


@query("sp6_plan_states", """SELECT i AS global_state_index, CASE WHEN 20 * c < 2 * n THEN 'boundary_rare' WHEN 20 * c < 7 * n THEN 'freshness_stress' WHEN 20 * c < 14 * n THEN 'ordinary' WHEN 20 * c < 17 * n THEN 'secrecy_stress' ELSE 'sensing_stress' END AS state_category,
  CASE WHEN 20 * p < 3 * n THEN 'test' WHEN 20 * p < 17 * n THEN 'train' ELSE 'validation' END AS split, ('0x' || substr(sha256('7:state:' || printf('%08d', i)), 1, 8))::BIGINT AS sampling_seed,
  ('0x' || substr(sha256('7:rollin:' || printf('%08d', i)), 1, 8))::BIGINT % 65 AS rollin_slots, CASE WHEN i % 2 = 0 THEN 'greedy' ELSE 'random' END AS rollin_policy, 'scenario-7-' || printf('%08d', i) AS scenario_id FROM (
  SELECT i, row_number() OVER (ORDER BY sha256('7:state_category:' || i)) - 1 AS c, row_number() OVER (ORDER BY sha256('7:split:' || i)) - 1 AS p, count(*) OVER () AS n FROM range((SELECT count(*) FROM orders)) r(i))""")
def sp6(s, d):
    return sampling.plan_states(s, a.table(s, d, "orders").count(), 7, _CATEGORIES)


@query("sp3_largest_remainder_quotas", """SELECT name, (base + (row_number() OVER (ORDER BY exact - base DESC, sha256('7:priority:' || name), name) <= 1000 - sum(base) OVER ())::INT)::BIGINT AS quota FROM (SELECT *, floor(exact)::BIGINT AS base FROM (
  SELECT o_orderpriority AS name, round(count(*) / (SELECT count(*) FROM orders), 4) * 1000 AS exact FROM orders GROUP BY 1))""")
def sp3(s, d):
    o = a.table(s, d, "orders")
    n = o.count()
    shares = {r[0]: round(r[1] / n, 4) for r in o.groupBy("o_orderpriority").count().collect()}  # five rows
    return sampling.largest_remainder_quotas(s, 1000, shares, 7, "priority")


@query("sp9_retain_trajectories", """SELECT r.state_id, r.candidate_index, rollout_index, r.candidate_index = selected_index OR NOT hard_feasible OR ('0x' || substr(sha256('run:' || r.state_id || ':' || r.candidate_index || ':' || rollout_index || ':audit'), 1, 8))::UBIGINT / 4294967296.0 < 0.05 AS retained_trajectory
  FROM rollouts r JOIN selected USING (state_id)""", "rollouts", "selected")
def sp9(s, d):
    r = a.rollouts(s, d).withColumn("trajectory", F.array(F.struct(F.col("rollout_index").alias("step"))))
    out = sampling.retain_trajectories(r, ve.select(ranked(s, d)).select("state_id", F.col("selected_index").alias("candidate_index")), "run", 0.05)
    kept = F.col("retained_trajectory") & (F.size("trajectory") == 1) | ~F.col("retained_trajectory") & (F.size("trajectory") == 0)
    return out.where(kept).select("state_id", "candidate_index", "rollout_index", "retained_trajectory")


@query("sp11_grid", "SELECT n_nationkey, x, y FROM nation CROSS JOIN (SELECT unnest([0.2, 0.5])::DOUBLE AS x) CROSS JOIN (SELECT unnest([1, 2, 3]) AS y)")
def sp11(s, d):
    return a.table(s, d, "nation").select("n_nationkey").crossJoin(F.broadcast(sampling.grid(s, {"x": [0.2, 0.5], "y": [1, 2, 3]})))  # six rows


# verification


@query("ve1_reduce_steps", """SELECT l_orderkey, count(*) AS steps, round(sum(power(0.995, step) * cost) / sum(power(0.995, step)), 8) AS discounted_cost, max(l_quantity) AS max_mean_aoi, round(sum(l_quantity / 10), 6) AS energy, round(sum(l_partkey % 3) / sum(4), 8) AS delivery_rate,
  round(sum(l_suppkey % 2) / sum(4), 8) AS outage_rate, round(avg(l_discount), 8) AS mean_constraint_violation, round(avg((l_discount > 0.09)::INT), 8) AS fallback_rate, bool_and(l_quantity < 49) AS hard_feasible FROM (
  SELECT *, l_linenumber - 1 AS step, l_extendedprice / 10000 AS cost, min(CASE WHEN l_linenumber = 5 AND l_orderkey % 2 = 0 THEN 4 END) OVER (PARTITION BY l_orderkey) AS stop FROM lineitem) WHERE step < 32 AND (stop IS NULL OR step <= stop) GROUP BY 1""")
def ve1(s, d):
    steps = a.table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber - 1 as step", "l_extendedprice / 10000 as cost", "l_quantity as mean_aoi", "l_partkey % 3 as delivered", "l_suppkey % 2 as outages", "4 as users", "l_tax as queue", "l_quantity / 10 as energy",
        "l_discount as violation", "l_discount as repair", "l_discount > 0.09D as fallback", "l_quantity < 49 as feasible", "l_linenumber = 5 and l_orderkey % 2 = 0 as terminated")
    r = ve.reduce_steps(steps, ["l_orderkey"])
    eight = ["discounted_cost", "delivery_rate", "outage_rate", "mean_constraint_violation", "fallback_rate"]
    return r.select("l_orderkey", "steps", "max_mean_aoi", F.round("energy", 6).alias("energy"), "hard_feasible", *(F.round(c, 8).alias(c) for c in eight))


@query("ve14_next_verification_round", "SELECT state_id, candidate_index, m AS rollout_index FROM candidates CROSS JOIN range(8, 16) r(m) WHERE state_id::BIGINT % 4 = 0", "candidates")
def ve14(s, d):
    w = ve.select(ranked(s, d)).withColumn("decision_status", F.expr("case when cast(state_id as bigint) % 4 = 0 then 'unresolved' else 'decisive' end"))
    return ve.next_verification_round(w, a.rollouts(s, d)).select("state_id", "candidate_index", F.col("rollout_index").cast("long").alias("rollout_index"))


# files and shards


@query("io2_read_valid_prefix", """SELECT o_orderkey AS x FROM (SELECT o_orderkey, o_custkey % 4 AS b, min(CASE WHEN o_orderkey % 500 = 499 THEN o_orderkey END) OVER (PARTITION BY o_custkey % 4) AS stop FROM orders) WHERE stop IS NULL OR o_orderkey < stop""")
def io2(s, d):
    path = tables.shared_folder(s, "prefix")
    lines = a.table(s, d, "orders").selectExpr("o_custkey % 4 as b", "o_orderkey", "case when o_orderkey % 500 = 499 then '{\"x\":' else concat('{\"x\":', o_orderkey, '}') end as value")
    lines.repartition("b").sortWithinPartitions("b", "o_orderkey").select("b", "value").write.partitionBy("b").text(path)
    return tables.read_valid_prefix(s, path, s.range(0).selectExpr("id as x").schema)


@query("io4_special_doubles", """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'infinity'::DOUBLE WHEN o_orderkey % 50 = 1 THEN '-infinity'::DOUBLE ELSE o_totalprice END AS x, o_orderkey % 50 < 2 AS quoted FROM orders""")
def io4(s, d):
    path = tables.shared_folder(s, "doubles")
    o = a.table(s, d, "orders").selectExpr("o_orderkey", "case o_orderkey % 50 when 0 then double('infinity') when 1 then double('-infinity') else o_totalprice end as x")
    tables.write_table(tables.encode_special_doubles(o), path)
    back = s.read.text(path).select("value", F.from_json("value", "o_orderkey long, x double").alias("r"))
    return back.select("r.o_orderkey", "r.x", F.col("value").rlike('"x":"').alias("quoted"))


def shard_folder(s, d):
    """A folder with a shard a region, each with a manifest, and telemetry of all but one."""
    root = tables.shared_folder(s, "shards")
    regions = a.table(s, d, "region").selectExpr("r_regionkey as shard_index", "r_name as run_id")
    nations = a.table(s, d, "nation")
    for k in range(regions.count()):
        regions.where(F.col("shard_index") == k).coalesce(1).write.json(f"{root}/shard-{k:04d}/manifest.json")
        if k != 2:
            nations.where(F.col("n_regionkey") == k).selectExpr("n_nationkey as gpu", "n_name as event").coalesce(1).write.json(f"{root}/shard-{k:04d}/metrics.jsonl")
            nations.where(F.col("n_regionkey") == k).selectExpr("n_nationkey as gpu", "n_name as event").coalesce(1).write.option("header", True).csv(f"{root}/shard-{k:04d}/gpu.csv")
    return root


@query("io6_discover_shards", "SELECT printf('shard-%04d', r_regionkey) AS shard, r_regionkey AS shard_index, r_name AS run_id FROM region")
def io6(s, d):
    return me.discover_shards(s, shard_folder(s, d), a.table(s, d, "region").selectExpr("r_regionkey as shard_index", "r_name as run_id").schema).select("shard", "shard_index", "run_id")


@query("io7_read_telemetry", "SELECT kind, n_regionkey::INT AS shard_index, n_nationkey AS gpu, n_name AS event FROM nation CROSS JOIN (VALUES ('csv'), ('jsonl')) k(kind) WHERE n_regionkey <> 2")
def io7(s, d):
    root, schema = shard_folder(s, d), a.table(s, d, "nation").selectExpr("n_nationkey as gpu", "n_name as event").schema
    one = me.read_telemetry(s, root, "metrics.jsonl", schema).withColumn("kind", F.lit("jsonl"))
    return one.unionByName(me.read_telemetry(s, root, "gpu.csv", schema).withColumn("kind", F.lit("csv"))).unionByName(me.read_telemetry(s, root, "none.jsonl", schema).withColumn("kind", F.lit("none")))


@query("au1_missing_tables", "SELECT 'nation' AS name, count(*) AS n, NULL::VARCHAR AS error FROM nation UNION ALL SELECT 'selections', 0, 'missing canonical table: selections.jsonl'")
def au1(s, d):
    root = tables.shared_folder(s, "dataset")
    n = a.table(s, d, "nation").select("n_nationkey", "n_name")
    tables.write_table(n, f"{root}/nation.jsonl")
    read, errors = report.missing_tables(s, root, {"nation": n.schema, "selections": n.schema})
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in read.items()]
    return counts[0].unionByName(counts[1]).join(errors.withColumn("name", F.regexp_extract("error", r": (\w+)\.jsonl", 1)), "name", "left")


def manifests(s, d):
    """A shard a nation, with some defects."""
    return a.table(s, d, "nation").selectExpr(
        "n_nationkey as shard_index", "25L as shard_count", "2500L as total_requested_states", "42L as master_seed", "'model' as teacher_model_id", "named_struct('b', 1, 'a', n_regionkey div 4) as candidate_pool_config",
        "case n_nationkey when 20 then 'other' else 'commit' end as git_commit", "false as git_dirty", "case when n_nationkey = 7 then n_nationkey * 100 + 1 else n_nationkey * 100 end as global_state_start",
        "(n_nationkey + 1) * 100 as global_state_stop", "case when n_nationkey <> 3 then 'done' end as completed_at", "map('states', case n_nationkey when 11 then 99L else 100L end) as table_counts")


@query("mg1_config_fingerprint", """SELECT n_nationkey AS shard_index, sha256('{"candidate_pool_config":{"a":' || (n_regionkey // 4) || ',"b":1},"master_seed":42,"max_monte_carlo_rollouts":null,"monte_carlo_rollouts":null,"num_candidates":null,"prompt_version":null,"rollout_horizon_slots":null,"sampling_strategy":null,"schema_version":null,"split_fractions":null,"state_distribution":null,"system_config_path":null,"teacher_config_path":null,"teacher_model_id":"model","teacher_model_revision":null,"teacher_provider":null}') AS fingerprint FROM nation""")
def mg1(s, d):
    m = manifests(s, d)
    return m.select("shard_index", me.config_fingerprint(m).alias("fingerprint"))


@query("mg2_validate_shards", """WITH m AS (SELECT n_nationkey AS i, n_nationkey = 20 AS other, n_regionkey // 4 AS made, n_nationkey * 100 + (n_nationkey = 7)::INT AS start, (n_nationkey + 1) * 100 AS stop, n_nationkey = 3 AS unfinished, 100 - (n_nationkey = 11)::INT AS states FROM nation),
  l AS (SELECT *, coalesce(lag(stop) OVER (ORDER BY i), 0) AS before FROM m)
  SELECT 'configuration, total or seed differs' AS problem, NULL::BIGINT AS shard_index FROM m HAVING count(DISTINCT made) > 1 UNION ALL SELECT 'shards are not of one clean commit', NULL FROM m HAVING count(DISTINCT other) > 1
  UNION ALL SELECT 'shards are missing', NULL FROM m HAVING count(*) <> 25 UNION ALL SELECT 'shard indices are incomplete or duplicated', NULL FROM m HAVING count(DISTINCT i) <> count(*) OR max(i) <> count(*) - 1 UNION ALL SELECT 'shards do not cover the plan', NULL FROM m HAVING max(stop) <> 2500
  UNION ALL SELECT 'global ranges are not contiguous', i FROM l WHERE start <> before OR stop <= start UNION ALL SELECT 'state count does not match the range', i FROM l WHERE states <> stop - start UNION ALL SELECT 'shard is not finalized', i FROM l WHERE unfinished""")
def mg2(s, d):
    return me.validate_shards(manifests(s, d))


@query("mg3_merge_shards", "SELECT name, 'merged' AS run_id, n FROM (SELECT 'states' AS name, count(*) AS n FROM states UNION ALL SELECT 'candidates', count(*) FROM candidates)", "states", "candidates")
def mg3(s, d):
    states = sampling.global_rank(a.states(s, d).drop("global_state_index"), "state_id", "global_state_index")
    merged = me.merge_shards({"states": states.withColumn("run_id", F.lit("one")), "candidates": a.candidates(s, d)}, "merged", states.count())
    parts = [t.groupBy("run_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, t in merged.items()]
    return parts[0].unionByName(parts[1])


def sharded(s, d, n=4):
    """A folder of n shards of orders and their lines, with manifests, and the tables' schemas."""
    root = tables.shared_folder(s, "sharded")
    o = sampling.global_rank(a.table(s, d, "orders").select("o_orderkey"), "o_orderkey", "global_state_index")
    total = o.count()
    o = o.select(F.col("o_orderkey").cast("string").alias("state_id"), F.col("global_state_index").cast("long"), F.lit("old").alias("run_id"))
    lines = a.table(s, d, "lineitem").selectExpr("cast(l_orderkey as string) as state_id", "l_linenumber", "l_partkey").join(o.select("state_id", "global_state_index"), "state_id")
    for k in range(n):
        start, stop = k * total // n, (k + 1) * total // n
        mine = f"global_state_index >= {start} and global_state_index < {stop}"
        o.where(mine).repartitionByRange(2, "global_state_index").sortWithinPartitions("global_state_index").write.json(f"{root}/shard-{n - k:04d}/states.jsonl")
        lines.where(mine).drop("global_state_index").write.json(f"{root}/shard-{n - k:04d}/lines.jsonl")
        m = s.range(1).selectExpr(f"{k}L as shard_index", f"{n}L as shard_count", f"{total}L as total_requested_states", "42L as master_seed", "'model' as teacher_model_id", "'commit' as git_commit", "false as git_dirty",
                                  f"{start}L as global_state_start", f"{stop}L as global_state_stop", "'done' as completed_at", f"map('states', {stop - start}L) as table_counts")
        m.coalesce(1).write.json(f"{root}/shard-{n - k:04d}/manifest.json")
    return root, m.schema, {"states": o.schema, "lines": lines.drop("global_state_index").schema}


@query("mg3_merge_folder", """SELECT o_orderkey::VARCHAR AS state_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS global_state_index, 'merged' AS run_id, n, parts FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def mg3_folder(s, d):
    root, manifest, schemas = sharded(s, d)
    out = tables.shared_folder(s, "merged")
    me.merge_folder(s, root, out, "merged", schemas, manifest, 4)
    lines = me.read_merged(s, out, "lines", schemas["lines"]).groupBy("state_id").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))
    return me.read_merged(s, out, "states", schemas["states"]).join(lines, "state_id", "left").select("state_id", "global_state_index", "run_id", "n", "parts")


def dataset(s, d):
    """Six linked tables of the states that have a selection, some incomplete."""
    r = kept(s, d)
    own = once(selections(s, d, r), "selections")
    x = own.withColumns({"k": F.col("state_id").cast("long"), "verification_rollouts": F.lit(8), "candidate_pool_count": F.col("verified_candidate_count")})
    x = x.withColumn("candidate_pool_count", F.expr("candidate_pool_count + cast(k % 1009 = 1008 as int)"))
    accepted = x.where("acceptance_status = 'accepted'").select("state_id")
    parts = {"candidates": a.candidates(s, d), "rollouts": a.rollouts(s, d), "demonstrations": demonstrations(s, d, r, own)}
    out = {name: t.join(accepted, "state_id", "left_semi") for name, t in parts.items()}
    states = a.states(s, d).join(x.select("state_id"), "state_id", "left_semi")
    return {"states": states, "selections": x, "requests": states.select("state_id", F.concat("state_id", F.lit(":request")).alias("request_id"))} | out


STEPS["trimmed"] = "SELECT *, state_id::BIGINT AS k FROM selections WHERE state_id::BIGINT < coalesce((SELECT min(state_id::BIGINT) FROM selections WHERE accepted AND state_id::BIGINT % 1009 = 1008), 9e18)"
NEEDS["trimmed"] = ["selections"]


@query("mg4_trim_incomplete", """SELECT 'states' AS name, count(*) AS n FROM trimmed UNION ALL SELECT 'selections', count(*) FROM trimmed UNION ALL SELECT 'requests', count(*) FROM trimmed UNION ALL SELECT 'demonstrations', count(*) FROM trimmed WHERE accepted
  UNION ALL SELECT 'candidates', count(*) FROM candidates JOIN trimmed USING (state_id) WHERE accepted UNION ALL SELECT 'rollouts', 8 * count(*) FROM candidates JOIN trimmed USING (state_id) WHERE accepted""", "trimmed", "candidates")
def mg4(s, d):
    out = None
    for name, t in me.trim_incomplete(dataset(s, d)).items():
        part = t.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("mg5_distillation_view", "SELECT state_id, abs(sum(w) - 1) <= 1e-6 AS usable FROM demos GROUP BY 1", "demos")
def mg5(s, d):
    usable, excluded = me.distillation_view(demonstrations(s, d))
    return usable.select("state_id", F.lit(True).alias("usable")).unionByName(excluded.select("state_id", F.lit(False).alias("usable")))


@query("mg6_view_summary", "SELECT sum(ok::INT)::BIGINT AS usable, sum((NOT ok)::INT)::BIGINT AS excluded, round(sum(ok::INT) / (SELECT count(*) FROM states), 8) AS coverage, sum(ok::INT) > 0 AS ready, array_to_string(list(state_id ORDER BY state_id) FILTER (NOT ok)[1:20], ',') AS excluded_ids FROM (SELECT state_id, abs(sum(w) - 1) <= 1e-6 AS ok FROM demos GROUP BY state_id)", "demos", "states")
def mg6(s, d):
    return me.view_summary(demonstrations(s, d), a.states(s, d).count(), 20).withColumns({"coverage": F.round("coverage", 8), "excluded_ids": F.array_join("excluded_ids", ",")})


def records(s, d):
    r = a.requests(s, d).join(a.table(s, d, "documents").selectExpr("cast(doc_id as string) as state_id", "n_chars"), "state_id")
    return r.selectExpr("*", "n_chars % 5 / 5 as feasible_rate", "n_chars % 7 / 100 as repair_distance", "n_chars % 3 = 0 as fallback_rate", "cast(n_chars % 11 as double) as risk", "n_chars % 2 = 0 as uncertain")


STEPS["teachers"] = """SELECT teacher_label, count(*) AS n, avg(schema_valid::INT) AS valid_rate, avg(unique_candidates / 8) FILTER (schema_valid) AS unique_ratio, avg(n_chars % 5 / 5) FILTER (schema_valid) AS feasible_rate, avg(n_chars % 7 / 100) FILTER (schema_valid) AS repair_distance,
  avg((n_chars % 3 = 0)::INT) FILTER (schema_valid) AS fallback_rate, avg(n_chars % 11) FILTER (schema_valid) AS risk, avg((n_chars % 2 = 0)::INT) FILTER (schema_valid) AS uncertain_rate, avg(latency_s) AS latency
  FROM requests JOIN (SELECT doc_id::VARCHAR AS state_id, n_chars FROM documents) USING (state_id) GROUP BY 1"""
NEEDS["teachers"] = ["requests"]
_RATES = ["valid_rate", "unique_ratio", "feasible_rate", "repair_distance", "fallback_rate", "risk", "uncertain_rate", "latency"]


@query("mg7_summarize_teacher", f"SELECT teacher_label, n, {', '.join(f'round({c}, 8) AS {c}' for c in _RATES)} FROM teachers", "teachers")
def mg7(s, d):
    return me.summarize_teacher(records(s, d), 8).select("teacher_label", "n", *(F.round(c, 8).alias(c) for c in _RATES))


@query("mg8_tournament_rank", "SELECT teacher_label, row_number() OVER (ORDER BY valid_rate DESC, feasible_rate DESC, risk, repair_distance, latency, teacher_label) AS rank FROM teachers", "teachers")
def mg8(s, d):
    return me.tournament_rank(me.summarize_teacher(records(s, d), 8))


# training inputs


@query("td1_demonstrations", "SELECT DISTINCT state_id FROM demos JOIN states USING (state_id) WHERE split = 'validation'", "demos", "states")
def td1(s, d):
    return training.demonstrations(demonstrations(s, d).join(a.states(s, d).select("state_id", "split"), "state_id"), "validation").select("state_id")


def weighted(s, d):
    """States in batches of neighbours, with targets (none for one of six) and a selected action."""
    t = a.candidates(s, d).groupBy("state_id").agg(F.sort_array(F.collect_list(F.struct("candidate_index", "pair", "eta_cpu"))).alias("c"))
    return t.selectExpr("state_id", "cast(state_id as bigint) div 64 as batch", "named_struct('pair', c[0].pair, 'eta_cpu', c[0].eta_cpu) as selected_action",
                        "case when cast(state_id as bigint) % 6 <> 0 then transform(c, x -> named_struct('weight', 1D / size(c), 'action', named_struct('pair', x.pair, 'eta_cpu', x.eta_cpu))) end as targets")


@query("td3_pad_targets", """SELECT state_id, max(k) OVER (PARTITION BY batch) AS width, k AS filled, 1.0::DOUBLE AS weight, pairs, cpu FROM (SELECT state_id, state_id::BIGINT // 64 AS batch, CASE WHEN state_id::BIGINT % 6 = 0 THEN 1 ELSE count(*) END AS k,
  CASE WHEN state_id::BIGINT % 6 = 0 THEN arg_min(pair, candidate_index) ELSE sum(pair) END::BIGINT AS pairs, CASE WHEN state_id::BIGINT % 6 = 0 THEN arg_min(eta_cpu, candidate_index) ELSE sum(eta_cpu) END AS cpu FROM candidates GROUP BY 1)""", "candidates")
def td3(s, d):
    p = training.pad_targets(weighted(s, d))
    total = "aggregate({0}, {1}, (s, x) -> s + x)"
    return p.select("state_id", F.expr("cast(size(target_weight) as bigint)").alias("width"), F.expr("aggregate(target_mask, 0L, (s, x) -> s + x)").alias("filled"), F.round(F.expr(total.format("target_weight", "0D")), 8).alias("weight"),
                    F.expr(total.format("target_pair", "0L")).alias("pairs"), F.expr(total.format("target_eta_cpu", "0D")).alias("cpu"))


@query("td6_auxiliary_targets", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN l_tax WHEN 1 THEN 0 ELSE l_discount END AS value, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE least(1, l_quantity / 40) END AS c0,
  (l_suppkey % 3 <> 0)::INT AS constraint_mask, greatest(0.001, least(1, CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE l_quantity / 40 - 0.1 END)) AS weight FROM lineitem""")
def td6(s, d):
    x = a.table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "case l_partkey % 4 when 0 then l_tax when 1 then double('infinity') end as value_target", "l_discount as verifier_score",
        "case when l_suppkey % 3 <> 0 then array(l_quantity / 40, -1D) end as constraint_targets", "case when l_suppkey % 5 <> 0 then l_quantity / 40 - 0.1D end as quality_weight")
    y = training.auxiliary_targets(x, 2)
    return y.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value", F.col("constraint_target")[0].alias("c0"), "constraint_mask", "weight")


# evaluation


@query("ev3_latency_percentiles", """SELECT teacher_label, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(avg((latency_s > 2)::INT), 6) AS missed,
  round(sum(coalesce(completion_tokens, 0)) FILTER (latency_s > 0) / sum(latency_s), 6) AS tokens_per_s FROM requests GROUP BY 1""", "requests")
def ev3(s, d):
    return training.latency_percentiles(a.requests(s, d), 2.0)


_WEIGHTS = {"entropy": 1.0, "risk": 0.1, "repair": 2.0, "fallback": 1.0, "growth": 0.05, "over_greedy": 0.5}


@query("ev5_active_query_ranking", """SELECT state_id, round(coalesce(entropy, 0) + 0.1 * coalesce(selected_risk, 0) + 2 * coalesce(repair, 0) + coalesce(fallback, 0) + 0.05 * coalesce(growth, 0) + 0.5 * coalesce(selected_risk - greedy_risk, 0), 6) AS score FROM (
  SELECT state_id, queue_max - lag(queue_max) OVER (PARTITION BY episode_id ORDER BY slot) AS growth FROM states) LEFT JOIN selections USING (state_id)
  LEFT JOIN (SELECT state_id, -sum(p * ln(greatest(p, 2.2250738585072014e-308))) AS entropy FROM (SELECT state_id, quality_weight / sum(quality_weight) OVER (PARTITION BY state_id) AS p FROM ranked WHERE equivalent) GROUP BY 1) USING (state_id)
  LEFT JOIN (SELECT state_id, min(repair_distance) AS repair, max(fallback_used::INT) AS fallback FROM acts WHERE selected GROUP BY 1) USING (state_id) ORDER BY score DESC, state_id LIMIT 100""", "states", "selections", "ranked", "acts")
def ev5(s, d):
    from decisionlake.plans.audits import actions

    r = kept(s, d)
    x = a.states(s, d).selectExpr("state_id", "queue_max - lag(queue_max) over (partition by episode_id order by slot) as growth")
    x = x.join(selections(s, d, r).selectExpr("state_id", "selected_risk as risk", "selected_risk - greedy_risk as over_greedy"), "state_id", "left")
    x = x.join(ve.soft_targets(r).select("state_id", F.col("target_entropy").alias("entropy")), "state_id", "left")
    w = actions(s, d, r).where("selected").groupBy("state_id").agg(F.min("repair_distance").alias("repair"), F.max(F.col("fallback_used").cast("int")).alias("fallback"))
    return training.active_query_ranking(x.join(w, "state_id", "left"), _WEIGHTS, 100)


@query("ev6_operating_map", """SELECT l_linenumber, l_returnflag, runs, CASE WHEN greatest(c, r, t) <= 1 THEN 'feasible' WHEN t >= c AND t >= r THEN 'sensing_limited' WHEN r >= c THEN 'radio_limited' ELSE 'compute_limited' END AS region FROM (
  SELECT l_linenumber, l_returnflag, count(*) AS runs, avg(l_discount) / 0.05 AS c, avg(l_quantity) / 25.3 AS r, avg(l_tax) / 0.0402 AS t FROM lineitem GROUP BY 1, 2)""")
def ev6(s, d):
    m = ev.operating_map(a.table(s, d, "lineitem"), ["l_linenumber", "l_returnflag"], {"radio": ("l_quantity", 25.3), "compute": ("l_discount", 0.05), "sensing": ("l_tax", 0.0402)})
    return m.select("l_linenumber", "l_returnflag", "runs", "region")


# streams


def _stream(s, d, name):
    return streams.stream_table(s, f"{d}/{name}.parquet*", a.table(s, d, name).schema, files=None)


@query("st6_stream_ages", """SELECT user_id, count(*) AS slots, arg_max(CASE WHEN l IS NULL THEN least(k, 20) ELSE least(1 + k - l, 20) END, k) AS age, round(list_reduce(list_prepend(0.0::DOUBLE, list((value - 35) / 100 ORDER BY k)), lambda q, g: least(25, greatest(0, q + g))), 6) AS queue FROM (
  SELECT *, max(CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY user_id ORDER BY k) AS l FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)) GROUP BY 1""")
def st6(s, d):
    e = _stream(s, d, "events").selectExpr("user_id", "event_id as slot", "event_type = 'purchase' as event", "(value - 35) / 100 as increment", "cast(ts as timestamp) as ts")
    out = streams.drain(streams.ages(e, "user_id", 20, 25.0, idle="7 days"), ["user_id", "slot"], "ages", "append")
    return out.groupBy("user_id").agg(F.count("*").alias("slots"), F.max_by("age", "slot").alias("age"), F.round(F.max_by("queue", "slot"), 6).alias("queue"))


@query("st7_complete_states", "SELECT o_orderkey, o_orderkey % 8 AS expected, coalesce(n, 0) AS found FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) >= o_orderkey % 8")
def st7(s, d):
    """All lines that ever come: dates of an order and its lines lie up to 2478 days apart."""
    return _complete(s, d, "3000 days")


@query("st7_states_within_hold", """SELECT o_orderkey, o_orderkey % 8 AS expected, count(DISTINCT line) AS found FROM (
  SELECT *, sum(gap) OVER (PARTITION BY o_orderkey ORDER BY ts, line NULLS FIRST) AS session FROM (
    SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY o_orderkey ORDER BY ts, line NULLS FIRST) + INTERVAL 200 DAY THEN 0 ELSE 1 END AS gap FROM (
      SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts, NULL AS line FROM orders UNION ALL SELECT l_orderkey, l_shipdate::TIMESTAMP, l_linenumber FROM lineitem)))
  GROUP BY o_orderkey, session HAVING count(*) > count(line) AND count(DISTINCT line) >= o_orderkey % 8""")
def st7_within_hold(s, d):
    """Lines that come with their order, no further than 200 days from the next row; state goes after that."""
    return _complete(s, d, "200 days")


def _complete(s, d, hold):
    """Every other line comes twice."""
    o = streams.with_end(_stream(s, d, "orders").selectExpr("o_orderkey", "cast(o_orderdate as timestamp) as ts", "o_orderkey % 8 as expected"))
    lines = _stream(s, d, "lineitem").selectExpr("l_orderkey as o_orderkey", "l_linenumber", "cast(l_shipdate as timestamp) as ts", "explode(sequence(0, cast(l_linenumber % 2 as int)))")
    return streams.drain(streams.complete_states(o, lines, "o_orderkey", "expected", "l_linenumber", hold=hold), ["o_orderkey"], "complete", "append").select("o_orderkey", "expected", "found")

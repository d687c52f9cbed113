"""Projections of the driver tables onto the library's schemas.

Each adapter is told twice: as a Spark DataFrame, and as a SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: State categories by order priority.
CATEGORIES = {"1-URGENT": "freshness_stress", "2-HIGH": "sensing_stress", "3-MEDIUM": "ordinary", "4-NOT SPECIFIED": "secrecy_stress", "5-LOW": "boundary_rare"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category(quote: str = "'") -> str:
    return "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in CATEGORIES.items()) + " end"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decisionlake.operators.sampling import assign_split

    o = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as state_id", "o_orderkey as global_state_index", "concat('scenario-', o_custkey) as scenario_id",
        "o_custkey as episode_id", "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as slot",
        f"{_category()} as state_category",
        "sha2(concat(o_custkey, '-', o_orderstatus, '-', cast(floor(o_totalprice / 20000) as int)), 256) as causal_state_hash",
        "o_totalprice / 10000 as mean_aoi", "(o_custkey % 250) / 10.0D as queue_max",
    )
    return assign_split(o, "scenario_id", 42)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt out by state_id itself, so that what is joined, grouped or ranked by state
    later is not dealt out again, and their other columns as one array: however few of them a
    use reads, its lines are the same, and all uses in a plan share one exchange."""
    order = "l_linenumber, l_partkey, l_suppkey"
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as state_id", "l_linenumber", "l_partkey", "l_suppkey",
        """array(cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as double), cast(l_linestatus = 'F' as double), l_quantity, l_discount, l_tax, l_extendedprice) as _v""",
    ).selectExpr("*", f"row_number() over (partition by state_id order by {order}) - 1 as candidate_index").selectExpr(
        "state_id", "candidate_index", "l_partkey", "l_suppkey", "_v[0] as _source", "_v[1] = 1 as _f", "_v[2] as l_quantity", "_v[3] as l_discount", "_v[4] as l_tax", "_v[5] as l_extendedprice",
    ).selectExpr(
        "state_id", "candidate_index", "case _source when 0 then 'teacher' when 1 then 'safe_template' else 'greedy_baseline' end as candidate_source",
        "l_quantity < 49 as hard_feasible", "l_discount < 0.05D as pre_repair_feasible",
        "_f and l_discount >= 0.095D as fallback_used", "l_discount + 0.0D as repair_distance",
        "l_extendedprice / 100000 as one_step_stage_cost", "l_tax + 0.0D as one_step_constraint_violation",
        "l_quantity / 50 as teacher_confidence", "l_partkey % 5 as pair", "l_quantity / 50 as eta_sensing", "(l_suppkey % 11) / 10.0D as eta_communication",
        "l_discount * 5 + 0.0D as eta_near", "(l_partkey % 3) / 2.0D as eta_cpu",
        "case when l_suppkey % 20 = 0 then 'nearest_available_template' else 'exact' end as template_resolution",
        "l_partkey", "l_suppkey", "l_quantity", "l_tax",
    )
    return line.withColumns({
        "executed_near": F.expr("least(eta_near, 0.25D)"), "executed_sensing": F.expr("greatest(eta_sensing, 0.05D)"),
        "repair_reasons": F.expr("filter(array(case when eta_near > 0.25D then 'near_power_sic_repair' end, case when eta_sensing < 0.05D then 'minimum_sensing_power' end), x -> x is not null)"),
    })


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).selectExpr(
        "state_id", "candidate_index", "candidate_source", "explode(sequence(0, 7)) as m", "one_step_stage_cost", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "repair_distance", "fallback_used",
    ).selectExpr(
        "state_id", "candidate_index", "candidate_source", "m as rollout_index",
        "one_step_stage_cost + ((l_partkey * 31 + l_suppkey * 17 + m * 13) % 101) / 1000.0D as discounted_cost",
        "l_tax / 10 as mean_constraint_violation", "repair_distance as mean_repair_distance", "cast(fallback_used as double) as fallback_rate",
        "l_quantity < 49 or m % 4 <> 0 as hard_feasible", "concat('selectable_', candidate_source) as policy_label",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.selectExpr(
        "cast(doc_id as string) as state_id", "concat(doc_id, ':request-000') as request_id", "lang as teacher_label",
        "coalesce(quality, 1) = 1 as schema_valid", "case when coalesce(quality, 1) = 1 then 'ok' else 'parse_error' end as status",
        "n_chars / 1000.0D as latency_s", "case when n_chars % 7 <> 0 then cast(floor(n_chars / 4) as bigint) end as completion_tokens",
        "8 as candidates_returned", "8 - n_chars % 3 as unique_candidates",
        "case when toxic = 1 then array('candidate[0].reason_codes_string_to_array') else array() end as response_normalization_notes",
        "sha2(coalesce(text, ''), 256) as cache_key", "source", "text",
    )


def slot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as entity", "row_number() over (partition by user_id order by ts, event_id) as slot", "ts", "event_id", "value",
        "event_type = 'purchase' as delivered", "event_type = 'error' as intercepted", "event_type = 'click' as scheduled", "event_type = 'signup' as detected",
        "(value - 35) / 100 as increment", "value * 1000 as covariance_trace", "value / 100 as energy",
        "case user_id % 3 when 0 then 'random' when 1 then 'greedy' else 'student' end as policy",
    )


def sensing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_log(spark, sf_dir).where("detected").selectExpr("entity", "slot as timestamp", "slot + 1 + event_id % 3 as ready_slot", "value * 1000 as trace")


def seed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as method", "l_suppkey % 10 as seed", "l_orderkey % 50 as scenario", "l_extendedprice as cost", "l_quantity as latency", "l_extendedprice * (1 - l_discount) as rate",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity * 0.2D as near_power", "l_quantity * 0.6D as far_power", "1.0D + l_partkey % 7 as near_gain",
        "1.0D + l_suppkey % 3 as far_gain", "1 + l_tax as disturbance", "20000.0D + l_partkey as distance",
    )


#: The same adapters for the oracle.
SQL = {
    "states": f"""SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (
        SELECT o_orderkey::VARCHAR AS state_id, o_orderkey AS global_state_index, 'scenario-' || o_custkey AS scenario_id, o_custkey AS episode_id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS slot, {_category()} AS state_category,
        sha256(o_custkey || '-' || o_orderstatus || '-' || floor(o_totalprice / 20000)::INT) AS causal_state_hash,
        o_totalprice / 10000 AS mean_aoi, (o_custkey % 250) / 10.0 AS queue_max,
        ('0x' || substr(sha256('42:scenario-' || o_custkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM orders)""",
    "candidates": """SELECT *, least(eta_near, 0.25) AS executed_near, greatest(eta_sensing, 0.05) AS executed_sensing,
        list_filter([CASE WHEN eta_near > 0.25 THEN 'near_power_sic_repair' END, CASE WHEN eta_sensing < 0.05 THEN 'minimum_sensing_power' END], lambda x: x IS NOT NULL) AS repair_reasons FROM (
        SELECT l_orderkey::VARCHAR AS state_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS candidate_index,
        CASE l_returnflag WHEN 'A' THEN 'teacher' WHEN 'N' THEN 'safe_template' ELSE 'greedy_baseline' END AS candidate_source,
        l_quantity < 49 AS hard_feasible, l_discount < 0.05 AS pre_repair_feasible, l_linestatus = 'F' AND l_discount >= 0.095 AS fallback_used,
        l_discount + 0.0 AS repair_distance, l_extendedprice / 100000 AS one_step_stage_cost, l_tax + 0.0 AS one_step_constraint_violation,
        l_quantity / 50 AS teacher_confidence, l_partkey % 5 AS pair, l_quantity / 50 AS eta_sensing, (l_suppkey % 11) / 10.0::DOUBLE AS eta_communication,
        l_discount * 5 + 0.0 AS eta_near, (l_partkey % 3) / 2.0::DOUBLE AS eta_cpu,
        CASE WHEN l_suppkey % 20 = 0 THEN 'nearest_available_template' ELSE 'exact' END AS template_resolution, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem)""",
    "rollouts": """SELECT state_id, candidate_index, candidate_source, m AS rollout_index,
        one_step_stage_cost + ((l_partkey * 31 + l_suppkey * 17 + m * 13) % 101) / 1000.0::DOUBLE AS discounted_cost, l_tax / 10 AS mean_constraint_violation,
        repair_distance AS mean_repair_distance, fallback_used::INT::DOUBLE AS fallback_rate, l_quantity < 49 OR m % 4 <> 0 AS hard_feasible
        FROM candidates CROSS JOIN range(8) r(m)""",
    "requests": """SELECT doc_id::VARCHAR AS state_id, doc_id || ':request-000' AS request_id, lang AS teacher_label, coalesce(quality, 1) = 1 AS schema_valid,
        CASE WHEN coalesce(quality, 1) = 1 THEN 'ok' ELSE 'parse_error' END AS status, n_chars / 1000.0::DOUBLE AS latency_s,
        CASE WHEN n_chars % 7 <> 0 THEN n_chars // 4 END AS completion_tokens, 8 AS candidates_returned, 8 - n_chars % 3 AS unique_candidates,
        CASE WHEN toxic = 1 THEN ['candidate[0].reason_codes_string_to_array'] ELSE [] END AS response_normalization_notes, sha256(coalesce(text, '')) AS cache_key, source
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "slot_log": """SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS slot, ts, event_id, value,
        event_type = 'purchase' AS delivered, event_type = 'error' AS intercepted, event_type = 'click' AS scheduled, event_type = 'signup' AS detected,
        (value - 35) / 100 AS increment, value * 1000 AS covariance_trace, value / 100 AS energy,
        CASE user_id % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'greedy' ELSE 'student' END AS policy FROM events""",
    "sensing_jobs": "SELECT entity, slot AS timestamp, slot + 1 + event_id % 3 AS ready_slot, value * 1000 AS trace FROM slot_log WHERE detected",
    "seed_results": "SELECT l_returnflag AS method, l_suppkey % 10 AS seed, l_orderkey % 50 AS scenario, l_extendedprice AS cost, l_quantity AS latency, l_extendedprice * (1 - l_discount) AS rate FROM lineitem",
    "links": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 0.2 AS near_power, l_quantity * 0.6 AS far_power, 1.0::DOUBLE + l_partkey % 7 AS near_gain,
        1.0::DOUBLE + l_suppkey % 3 AS far_gain, 1 + l_tax AS disturbance, 20000.0::DOUBLE + l_partkey AS distance FROM lineitem""",
}

"""Merging shards of a dataset, resuming it, and views for training."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from decisionlake.operators.audit import index_coverage, targets_valid
from decisionlake.operators.teacher import canonical
from decisionlake.sources.tables import parsed, read_table

#: What of a manifest says how its shard was made.
CONFIGURATION = (
    "schema_version", "system_config_path", "teacher_config_path", "teacher_provider", "teacher_model_id", "teacher_model_revision", "prompt_version", "master_seed", "num_candidates",
    "rollout_horizon_slots", "monte_carlo_rollouts", "max_monte_carlo_rollouts", "sampling_strategy", "state_distribution", "split_fractions", "candidate_pool_config",
)


def discover_shards(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The manifests of all shards under a folder, with the shard's folder, in order of its name (IO6)."""
    path = F.col("_metadata.file_path")
    found = spark.read.schema(schema).option("multiLine", True).json(f"{root}/shard-*/manifest.json")
    return found.withColumn("shard", F.regexp_extract(path, r"(shard-[^/]*)/manifest\.json", 1))


def read_telemetry(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """One telemetry file of all shards that have it, with the shard's index (IO7): JSON
    lines, or CSV with a header, by the name. No file at all gives no rows."""
    reader = spark.read.schema(schema)
    path = f"{root}/shard-*/{name}"
    try:
        rows = reader.json(path) if name.endswith(".jsonl") else reader.option("header", True).csv(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], StructType([*schema.fields])).withColumn("shard_index", F.lit(None).cast("int"))
    return rows.withColumn("shard_index", F.regexp_extract(F.col("_metadata.file_path"), r"shard-0*(\d+)[^/]*/", 1).cast("int"))


def config_fingerprint(manifests: DataFrame) -> Column:
    """SHA-256 of the canonical JSON of CONFIGURATION; a column that is absent is null (MG1)."""
    kinds = {f.name: f.dataType for f in manifests.schema.fields}
    fields = [(canonical(F.col(c), kinds[c]) if c in kinds else F.lit(None).cast("string")).alias(c) for c in sorted(CONFIGURATION)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def validate_shards(manifests: DataFrame) -> DataFrame:
    """What keeps shards from being merged, a row a problem (MG2): (problem, shard_index,
    null where all are meant). Manifests are a row a shard."""
    d = manifests.withColumn("_f", config_fingerprint(manifests))
    one = d.agg(
        F.count("*").alias("n"), F.max("shard_count").alias("want"), F.count_distinct("_f").alias("f"), F.count_distinct("total_requested_states").alias("t"), F.count_distinct("master_seed").alias("s"),
        F.count_distinct("git_commit").alias("c"), F.bool_or(F.coalesce("git_dirty", F.lit(True))).alias("dirty"), F.count_distinct("shard_index").alias("i"), F.min("shard_index").alias("low"), F.max("shard_index").alias("top"),
        F.max("global_state_stop").alias("end"), F.max("total_requested_states").alias("total"),
    )
    whole = {
        "no shard manifests were found": "n = 0", "shards are missing": "n > 0 and n <> want", "configuration, total or seed differs": "f > 1 or t > 1 or s > 1",
        "shards are not of one clean commit": "c > 1 or dirty", "shard indices are incomplete or duplicated": "n > 0 and (i <> n or low <> 0 or top <> n - 1)", "shards do not cover the plan": "end <> total",
    }
    overall = one.select(F.explode(F.array_compact(F.array(*(F.when(F.expr(test), F.lit(text)) for text, test in whole.items())))).alias("problem"), F.lit(None).cast("long").alias("shard_index"))
    each = d.selectExpr("*", "coalesce(lag(global_state_stop) over (order by shard_index), 0) as _start")  # a row a shard
    single = {
        "global ranges are not contiguous": "global_state_start <> _start or global_state_stop <= global_state_start", "shard is not finalized": "completed_at is null",
        "state count does not match the range": "coalesce(table_counts['states'], -1) <> global_state_stop - global_state_start",
    }
    by_shard = each.select(F.explode(F.array_compact(F.array(*(F.when(F.expr(test), F.lit(text)) for text, test in single.items())))).alias("problem"), F.col("shard_index").cast("long").alias("shard_index"))
    return overall.unionByName(by_shard)


def merge_shards(tables: dict[str, DataFrame], run_id: str, total: int) -> dict[str, DataFrame]:
    """The shards' tables under one run_id (MG3); a global index of the states that is
    missing, repeated or beyond ``total`` is an error when the states are read."""
    out = {name: d.withColumn("run_id", F.lit(run_id)) for name, d in tables.items()}
    bad = index_coverage(tables["states"], 0, total).agg(F.count("*").alias("_bad"))
    checked = out["states"].crossJoin(F.broadcast(bad))  # one row
    out["states"] = checked.where(F.when(F.col("_bad") > 0, F.raise_error(F.lit("global state indices are missing or repeated"))).otherwise(F.lit(True))).drop("_bad")
    return out


#: Where a merged dataset's tables are: a row a merge, the last counts.
_MERGED = StructType([StructField("place", LongType()), StructField("folder", StringType()), StructField("run_id", StringType()), StructField("shards", LongType()), StructField("states", LongType())])


def merge_folder(spark: SparkSession, root: str, out: str, run_id: str, schemas: dict[str, StructType], manifest: StructType, expected: int | None = None) -> DataFrame:
    """Merge all shard-* folders under ``root`` into one dataset at ``out`` (MG3).

    The shards' manifests must pass validate_shards() and be ``expected`` in number. Every
    table is read strictly and written as JSON lines in the order of shards, and of the
    lines in each, with the merge's run_id: lines are placed by shard, block of the file and
    place in the block, and sorted over all tasks. The states' global indices must cover
    the plan once each. Only then is the merge published, by one row in one file that names
    the folder of all its tables: a failure before leaves what was there, and readers never
    see some tables without others. Returns that row."""
    found = discover_shards(spark, root, manifest)
    problems = [r.problem for r in validate_shards(found).orderBy("shard_index").collect()]  # a few a shard
    shards, total = found.agg(F.count("*"), F.max("total_requested_states")).first()
    if expected is not None and shards != expected:
        problems.append(f"expected {expected} shards, found {shards}")
    if problems:
        raise ValueError("; ".join(problems))
    place = len(spark.read.schema(_MERGED).json(f"{out}/merges").select("place").collect()) if _exists(spark, f"{out}/merges") else 0
    folder = f"{out}/data-{uuid.uuid4().hex}"
    for name, schema in schemas.items():
        lines = spark.read.text(f"{root}/shard-*/{name}.jsonl").select(
            F.regexp_extract(F.col("_metadata.file_path"), r"/(shard-[^/]*)/", 1).alias("shard"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value")
        lines = lines.join(F.broadcast(found.select("shard", F.col("shard_index").alias("_shard"))), "shard").drop("shard")  # a row a shard
        rows = parsed(lines.select("_shard", "_block", "_line", "value"), schema).withColumn("run_id", F.lit(run_id))
        ordered = rows.repartitionByRange("_shard", "_block", "_line").sortWithinPartitions("_shard", "_block", "_line").drop("_shard", "_block", "_line")
        ordered.select(*sorted(ordered.columns)).write.json(f"{folder}/{name}.jsonl")
    states = spark.read.schema(schemas["states"]).json(f"{folder}/states.jsonl")
    bad = index_coverage(states, 0, total).take(1)
    if bad:
        raise ValueError(f"global state indices are missing or repeated: {bad[0].problem} {bad[0].global_state_index}")
    row = spark.createDataFrame([(place, folder, run_id, shards, total)], _MERGED)
    row.coalesce(1).write.mode("append").json(f"{out}/merges")
    return row


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return False
    return True


def read_merged(spark: SparkSession, out: str, name: str, schema: StructType) -> DataFrame:
    """A table of the merge that was published last."""
    folder = spark.read.schema(_MERGED).json(f"{out}/merges").agg(F.max_by("folder", "place")).first()[0]
    return read_table(spark, f"{folder}/{name}.jsonl", schema)


def complete_states(tables: dict[str, DataFrame], external: int = 0, schema: int = 5, candidates: int = 0, shortlist: int = 0) -> DataFrame:
    """(state_id, global_state_index, complete): an accepted state has a demonstration, as
    many candidates as its selection says, and rollouts for each verified candidate and
    external baseline (external_baseline_rollout_count of the selection, where there is such a
    column, else ``external``); another one has neither candidates nor a demonstration (MG4). Before
    schema 5 a state has ``candidates`` candidates and rollouts for ``shortlist`` + 2. A state
    without a selection or, where that table is given, a request is not complete."""
    c = tables["candidates"].groupBy("state_id").agg(F.count("*").alias("_c"))
    r = tables["rollouts"].groupBy("state_id").agg(F.count("*").alias("_r"))
    m = tables["demonstrations"].groupBy("state_id").agg(F.count("*").alias("_m"))
    own = [x for x in ("candidate_pool_count", "verified_candidate_count", "verification_rollouts", "external_baseline_rollout_count") if x in tables["selections"].columns]
    s = tables["selections"].select("state_id", "acceptance_status", *own)
    outside = f"coalesce(external_baseline_rollout_count, {external})" if "external_baseline_rollout_count" in own else str(external)
    pool, rolled = ("candidate_pool_count", f"(verified_candidate_count + {outside})") if schema >= 5 else (str(candidates), str(shortlist + 2))
    asked = tables["requests"].select("state_id").distinct().withColumn("_q", F.lit(True)) if "requests" in tables else None
    d = tables["states"].select("state_id", "global_state_index")
    for part in (s, c, r, m, *([] if asked is None else [asked])):
        d = d.join(part, "state_id", "left")
    d = d if asked is not None else d.withColumn("_q", F.lit(True))
    d = d.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("_c", "_r", "_m")})
    good = F.expr(
        f"case when _q is null or acceptance_status is null then false when acceptance_status = 'accepted' then _m > 0 and _c = {pool} and verification_rollouts > 0 and _r = {rolled} * verification_rollouts"
        " else _c = 0 and _m = 0 end"
    )
    return d.select("state_id", "global_state_index", F.coalesce(good, F.lit(False)).alias("complete"))


def trim_incomplete(tables: dict[str, DataFrame], external: int = 0, **older: int) -> dict[str, DataFrame]:
    """All tables cut to the states before the first that is not complete (MG4); ``older`` are
    complete_states()'s settings for datasets before schema 5."""
    d = complete_states(tables, external, **older)
    stop = d.where("not complete").agg(F.min("global_state_index").alias("_stop"))
    keep = d.crossJoin(F.broadcast(stop)).where("_stop is null or global_state_index < _stop").select("state_id")  # one row
    return {name: t.join(keep, "state_id", "left_semi") for name, t in tables.items()}


def distillation_view(demonstrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, excluded) demonstrations, by whether their targets are valid (MG5)."""
    d = demonstrations.withColumn("_ok", targets_valid("targets"))
    return d.where("_ok").drop("_ok"), d.where("not _ok").drop("_ok")


def view_summary(demonstrations: DataFrame, states: int, first: int = 100) -> DataFrame:
    """One row (MG6): usable and excluded demonstrations, coverage of the source's states,
    whether there is anything to train on, and the ``first`` excluded ids in order; all of
    them are the excluded part of distillation_view()."""
    d = demonstrations.agg(F.count("*").alias("n"), F.count_if(targets_valid("targets")).alias("ok"))
    ids = demonstrations.where(~targets_valid("targets")).select("state_id").orderBy("state_id").limit(first)  # a top-k report
    ids = ids.agg(F.sort_array(F.collect_list("state_id")).alias("excluded_ids"))
    return d.crossJoin(ids).selectExpr("ok as usable", "n - ok as excluded", f"ok / {max(1, states)} as coverage", "ok > 0 as ready", "excluded_ids")  # one row each


def summarize_teacher(records: DataFrame, expected: int) -> DataFrame:
    """A teacher's rates over valid records, its valid rate and latency over all (MG7); the
    mean risk of none is infinite."""
    valid = F.col("schema_valid")

    def of_valid(c: str) -> Column:
        return F.coalesce(F.avg(F.when(valid, F.expr(c).cast("double"))), F.lit(0.0))

    return records.groupBy("teacher_label").agg(
        F.count("*").alias("n"), F.avg(valid.cast("double")).alias("valid_rate"), of_valid(f"unique_candidates / {expected}").alias("unique_ratio"), of_valid("feasible_rate").alias("feasible_rate"),
        of_valid("repair_distance").alias("repair_distance"), of_valid("fallback_rate").alias("fallback_rate"), F.coalesce(F.avg(F.when(valid, F.col("risk"))), F.lit(float("inf"))).alias("risk"),
        of_valid("uncertain").alias("uncertain_rate"), F.avg("latency_s").alias("latency"),
    )


def tournament_rank(summaries: DataFrame) -> DataFrame:
    """Teachers from the best (MG8): a row a teacher."""
    order = "valid_rate desc, feasible_rate desc, risk, repair_distance, latency, teacher_label"
    return summaries.selectExpr("teacher_label", f"cast(row_number() over (order by {order}) as bigint) as rank")

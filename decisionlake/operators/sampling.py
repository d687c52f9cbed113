"""Deterministic splits, seeds, quotas and shards by SHA-256: no result depends on
partitioning or on a random generator."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def unit_hash(text: Column, digits: int = 16) -> Column:
    """The first hex digits of a text's SHA-256 as a number from 0 to 1."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(16**digits))


def assign_split(df: DataFrame, key: str, seed: int, fractions: Mapping[str, float] = SPLITS, out: str = "split") -> DataFrame:
    """train, validation or test by the key's hash; rows of one key agree (SP1)."""
    if abs(sum(fractions.values()) - 1) > 1e-9 or min(fractions.values()) < 0:
        raise ValueError("fractions must be non-negative and sum to 1")
    u = unit_hash(F.concat(F.lit(f"{seed}:"), F.col(key)))
    train, last = fractions["train"], fractions["train"] + fractions["validation"]
    return df.withColumn(out, F.when(u < train, "train").when(u < last, "validation").otherwise("test"))


def stable_seed(label: Column, seed: int) -> Column:
    """Unsigned 32-bit seed of a label (SP2)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), label), 256), 1, 8), 16, 10).cast("long")


def largest_remainder_quotas(spark: SparkSession, total: int, fractions: Mapping[str, float], seed: int, label: str) -> DataFrame:
    """(name, quota) that sum to total: floors, then the largest remainders (SP3)."""
    rows = spark.createDataFrame(sorted(fractions.items()), "name string, fraction double")
    d = rows.withColumn("exact", F.col("fraction") * total).withColumn("base", F.floor("exact"))
    d = d.withColumn("tie", F.sha2(F.concat(F.lit(f"{seed}:{label}:"), F.col("name")), 256))
    d = d.selectExpr("name", "base", "row_number() over (order by exact - base desc, tie, name) as rn", f"{total} - sum(base) over () as rest")
    return d.select("name", (F.col("base") + F.when(F.col("rn") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("quota"))


def _range_of(number: str, bounds: list, first: int = 0) -> Column:
    """How many bounds a number reaches, found by halves; null is before all."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(F.col(number) >= F.lit(bounds[half]), _range_of(number, bounds[half + 1:], first + half + 1)).otherwise(_range_of(number, bounds[:half], first))


def global_rank(df: DataFrame, order: str, out: str = "rank", rows_each: int = 250_000) -> DataFrame:
    """Rank from 0 over all rows by a hex hash column, or by a number: counted by hash prefix,
    or by ranges of the numbers between their quantiles (1024 at most), offset by those
    before, ranked within. There are as many as keep about ``rows_each`` rows in each, so no
    task holds more, whatever the table."""
    buckets = min(65536, max(1, -(-df.count() // rows_each)))
    if isinstance(df.schema[order].dataType, NumericType):
        buckets = min(1024, buckets)
        bounds = df.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
        b = df.withColumn("_b", _range_of(order, sorted(set(bounds or []))))
    else:
        b = df.withColumn("_b", (F.conv(F.substring(order, 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n")).selectExpr("_b", "coalesce(sum(_n) over (order by _b rows between unbounded preceding and 1 preceding), 0) as _before")
    ranked = b.selectExpr("*", f"row_number() over (partition by _b order by {order}) - 1 as _at")
    return ranked.join(F.broadcast(sizes), "_b").withColumn(out, F.col("_at") + F.col("_before")).drop("_b", "_at", "_before")  # 65536 rows at most


def exact_assignments(df: DataFrame, index: str, total: int, fractions: Mapping[str, float], seed: int, label: str) -> DataFrame:
    """A label for each index, in hash order, with counts exactly the quotas (SP4)."""
    spark = df.sparkSession
    quota = largest_remainder_quotas(spark, total, fractions, seed, label)
    ends = quota.selectExpr("name", "sum(quota) over (order by name) - quota as low", "sum(quota) over (order by name) as high")
    ranked = global_rank(df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:{label}:"), F.col(index).cast("string")), 256)), "_h")
    return ranked.join(F.broadcast(ends), (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(*df.columns, F.col("name").alias(label))


def assign_shard(index: Column, total: int, shards: int) -> Column:
    """Shard of an index when the first total % shards shards are one larger (SP5)."""
    base, extra = divmod(total, shards)
    cut = extra * (base + 1)
    return F.when(index < cut, F.floor(index / (base + 1))).otherwise(extra + F.floor((index - cut) / max(base, 1))).cast("long")


def shard_bounds(spark: SparkSession, total: int, shards: int) -> DataFrame:
    base, extra = divmod(total, shards)
    return spark.range(shards).selectExpr("id as shard_index", f"id * {base} + least(id, {extra}) as start", f"(id + 1) * {base} + least(id + 1, {extra}) as stop")


def common_seeds(states: DataFrame, count: int, seed: int) -> DataFrame:
    """count seeds a state, the same for each of its candidates (SP7)."""
    d = states.select("state_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("rollout_index"))
    return d.withColumn("rollout_seed", stable_seed(F.concat_ws(":", "state_id", F.col("rollout_index").cast("string")), seed))


def audit_sample(df: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """Rows whose key's hash falls below the fraction (SP8)."""
    if fraction <= 0:
        return df.limit(0)
    return df.where(unit_hash(F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit("audit")), 8) < fraction)


def grid(spark: SparkSession, axes: Mapping[str, list[float]]) -> DataFrame:
    """All points of a parameter grid (SP11)."""
    d = spark.range(1).select()
    for name, values in axes.items():
        d = d.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return d


def plan_states(spark: SparkSession, total: int, seed: int, categories: Mapping[str, float], fractions: Mapping[str, float] = SPLITS, rollin: int = 64) -> DataFrame:
    """What is to be sampled for each global index (SP6): category and split with exact
    counts, sampling seed, roll-in length and policy, scenario."""
    d = exact_assignments(spark.range(total).withColumnRenamed("id", "global_state_index"), "global_state_index", total, categories, seed, "state_category")
    d = exact_assignments(d, "global_state_index", total, fractions, seed, "split")
    index = F.format_string("%08d", "global_state_index")
    return d.withColumns({
        "sampling_seed": stable_seed(F.concat(F.lit("state:"), index), seed), "rollin_slots": F.pmod(stable_seed(F.concat(F.lit("rollin:"), index), seed), F.lit(rollin + 1)),
        "rollin_policy": F.when(F.col("global_state_index") % 2 == 0, "greedy").otherwise("random"), "scenario_id": F.concat(F.lit(f"scenario-{seed}-"), index),
    })


def retain_trajectories(rollouts: DataFrame, selected: DataFrame, run: str, fraction: float) -> DataFrame:
    """rollouts with ``retained_trajectory``, and ``trajectory`` emptied where it is false
    (SP9): kept are those of the selected candidate (state_id, candidate_index), those that
    are not feasible, and a sample by hash."""
    chosen = selected.select("state_id", "candidate_index").withColumn("_s", F.lit(True))
    d = rollouts.join(chosen, ["state_id", "candidate_index"], "left")
    place = unit_hash(F.concat_ws(":", F.lit(run), "state_id", F.col("candidate_index").cast("string"), F.col("rollout_index").cast("string"), F.lit("audit")), 8)
    keep = F.coalesce("_s", F.lit(False)) | ~F.col("hard_feasible") | (place < max(0.0, fraction))
    empty = F.array().cast(rollouts.schema["trajectory"].dataType)
    return d.withColumn("retained_trajectory", keep).withColumn("trajectory", F.when(F.col("retained_trajectory"), F.col("trajectory")).otherwise(empty)).drop("_s")

"""The request cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from decisionlake.operators.responses import cache_lookup
from decisionlake.sources.store import BucketTable

#: What the cache keeps of a response.
RESPONSE = StructType([StructField(n, t()) for n, t in (("cache_key", StringType), ("text", StringType), ("reasoning_text", StringType), ("prompt_tokens", LongType), ("completion_tokens", LongType))])


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys still to ask for, once each (TR4)."""
    return requests.select("cache_key").distinct().join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def cache_upsert(cache: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The cache with new responses (TR5): of each key the row that was written last,
    new ones after old ones and among each other by ``order``. A key that is not 64
    lower-case hex digits is an error. Both have the same columns, among them cache_key."""
    rows = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    good = F.coalesce(F.col("cache_key").rlike("^[0-9a-f]{64}$"), F.lit(False))
    rows = rows.withColumn("cache_key", F.when(good, F.col("cache_key")).otherwise(F.raise_error(F.lit("a cache key must be 64 lower-case hex digits"))))
    last = rows.groupBy("cache_key").agg(F.max_by(F.struct(*cache.columns), F.struct("_new", order)).alias("_r"))
    return last.select("cache_key", *(F.col(f"_r.{c}").alias(c) for c in cache.columns if c != "cache_key"))


def response_cache(spark: SparkSession, root: str, buckets: int = 256) -> BucketTable:
    """The cache as a table by key in buckets, with versions (TR3 to TR5)."""
    return BucketTable(spark, root, ["cache_key"], RESPONSE, buckets)


def put(cache: BucketTable, new: DataFrame, order: str, batch: int | None = None) -> int:
    """Add completed responses (TR5): only the buckets of their keys are read and written,
    and readers see all of them or none. Of each key the last by ``order`` stays. ``new``
    should be a written table."""
    return cache.replace(new, lambda old, rows: cache_upsert(old.withColumn(order, F.lit(None).cast(new.schema[order].dataType)), rows.select(*RESPONSE.names, order), order), batch)


def look_up(requests: DataFrame, cache: BucketTable) -> DataFrame:
    """cache_lookup() in the newest version; only the buckets that requests touch are read."""
    return cache_lookup(requests, cache.read(cache.touched(requests)))

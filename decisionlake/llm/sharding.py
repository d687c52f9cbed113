"""Sharding by jump consistent hashing, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import materialize, table

#: A key meets a mean of ln(shards) + 1 jumps; the chance of more than this many
#: is below 1e-60 for any number of shards that fits in an int, and an error.
MAX_JUMPS = 160


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a key by jump consistent hashing (Lamping and Veach):
    from bucket b the next one is floor((b + 1) / u) with u drawn from the key's own
    pseudo-random stream; the last bucket below ``shards`` is the answer. The stream
    is a chain of xxhash64 instead of a linear congruence, which would overflow in
    ANSI mode. A null key hashes like the empty string. Growing to shards + 1 moves
    a key only into the new shard.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))
    start = F.struct(
        F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("jump")).alias("k"),
    )

    def step(acc: Column, _: Column) -> Column:
        k = F.xxhash64(acc["k"])
        u = (F.shiftrightunsigned(k, 33) + 1) / F.lit(float(1 << 31))
        j = F.floor((acc["j"] + 1) / u).cast("long")
        live = acc["j"] < shards
        return F.struct(
            F.when(live, acc["j"]).otherwise(acc["b"]).alias("b"),
            F.when(live, j).otherwise(acc["j"]).alias("j"),
            k.alias("k"),
        )

    return F.aggregate(steps, start, step, lambda acc: F.when(acc["j"] < shards, F.raise_error(F.lit("the jumps did not end"))).otherwise(acc["b"]).cast("int"))


def shard_documents(docs: DataFrame, shards: int, rows_per_run: int = 50_000) -> DataFrame:
    """Place documents (doc_id, text) in shards by key, with a gapless slot in each.

    The key is doc_id alone, so equal rows share a shard, each with a slot of its
    own. Null texts count as empty. A shard's rows are numbered in runs: rows fall in
    runs by a hash, runs are counted, and a row's slot is its run's offset plus its
    place in the run, so no task ever holds a whole shard. An empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "shard")
    runs = max(1, -(-rows.count() // (rows_per_run * shards)))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(runs)))
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    # one row per shard and run: a 50,000th of the rows
    offsets = counts.selectExpr(
        "shard", "_run",
        "sum(_n) over (partition by shard order by _run rows between unbounded preceding and 1 preceding) as _before",
    )
    placed = rows.selectExpr("*", "row_number() over (partition by shard, _run order by doc_id, _row) - 1 as _at")
    return placed.join(offsets, ["shard", "_run"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.coalesce("_before", F.lit(0)) + F.col("_at")).cast("long").alias("slot"),
        "grown_shard",
    )


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by key."""
    return shard_documents(table(spark, sf_dir, "documents"), 8)

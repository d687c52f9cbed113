"""Structured Streaming over growing tables: windows, sessions, distinct keys, rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from decisionlake.sources.store import BucketTable
from decisionlake.sources.tables import shared_folder


def stream_table(spark: SparkSession, path: str, schema, files: int | None = 16) -> DataFrame:
    """The files of a table as they come, a bounded number a batch (ST1); with None all
    that are there in one batch, so that no order of files makes a row late."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def drain(stream: DataFrame, keys: list[str], tag: str, mode: str = "update", log: str | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream over all that is there, and return the last state of each key. A
    batch overwrites its own folder, so one that is run again counts once. With ``log``,
    a folder that is kept, a later run goes on where this one ended; ``progress`` is
    filled with the reports of the batches."""
    spark = stream.sparkSession
    log = log or shared_folder(spark, f"{tag}-log")
    out = f"{log}-out"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/_batch=-1")
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
        .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/_batch={i}")).start()
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(out)
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


#: After all times of a finite input.
_END = "9999-01-01 00:00:00"


def with_end(stream: DataFrame, time: str = "ts") -> DataFrame:
    """A finite stream and one row after its end, null but for the time: the watermark
    passes all other rows, so that windows, sessions and timers that are still open come
    to an end too. The row itself never does."""
    spark = stream.sparkSession
    path = shared_folder(spark, "end")
    last = spark.range(1).select(*(F.lit(_END if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields))
    last.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def windows(events: DataFrame, keys: list[str], values: str | list[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, and mean and maximum of one value (mean, top) or of several (mean_x, top_x),
    by key and window; rows later than the watermark drop out (ST2)."""
    several = {v: f"_{v}" for v in values} if isinstance(values, list) else {values: ""}
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    each = [f(v).alias(f"{name}{tail}") for v, tail in several.items() for name, f in (("mean", F.avg), ("top", F.max))]
    d = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), *each)
    return d.select(F.col("w.start").alias("start"), *keys, "n", *(f"{name}{tail}" for tail in several.values() for name in ("mean", "top")))


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour", tokens: str = "1", latency: str = "0D", failed: str = "false") -> DataFrame:
    """Bursts of a key's requests no further apart than the gap (ST3): requests, tokens,
    tokens a second of latency (0 where there is none) and errors, told by SQL
    expressions. A burst comes out once the watermark has passed its end, so such a stream
    runs in append mode; the last bursts of a finite input do so after with_end()."""
    d = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count("*").alias("requests"), F.sum(F.expr(tokens)).alias("tokens"), F.sum(F.expr(latency)).alias("_s"), F.count_if(F.expr(failed)).alias("errors"),
    )
    return d.selectExpr("w.start as start", "w.end as end", key, "requests", "tokens", "case when _s > 0 then tokens / _s else 0D end as tokens_per_second", "errors")


def distinct_keys(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark (ST4); keys that come back later
    come out again, see once()."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def once(stream: DataFrame, seen: BucketTable, order: list[str], out: str, log: str) -> None:
    """Run a stream over all that is there and give each key of ``seen`` once for good
    (ST4): its first row by ``order`` of the first batch it came in, at out/_batch=i.

    Keys that were seen are rows of ``seen`` (its keys and ``first_batch``). A batch reads only
    the buckets that its own keys fall in, as they were before it, overwrites its own
    output, and then adds its keys under its number: whatever step it breaks off at, run
    again it gives the same rows."""
    spark = stream.sparkSession

    def take(batch: DataFrame, i: int) -> None:
        path = f"{out}/_batch={i}"
        staged = f"{out}-staged/_batch={i}"
        first = batch.groupBy(*seen.keys).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r")).select("_r.*")
        first.write.mode("overwrite").parquet(staged)
        first = spark.read.schema(stream.schema).parquet(staged)
        before = seen.read(seen.touched(first), seen.version(before_batch=i)[0])
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in seen.keys]
        fresh = first.alias("a").join(before.alias("b"), same, "left_anti")
        fresh.write.mode("overwrite").parquet(path)
        mine = spark.read.schema(stream.schema).parquet(path).select(*seen.keys, F.lit(i).cast("long").alias("first_batch"))
        seen.replace(mine, lambda old, new: old.unionByName(new), batch=i)

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/_batch=-1")
    stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()


def rates(events: DataFrame, flags: list[str], length: str, late: str = "1 hour") -> DataFrame:
    """Share of rows with each flag by window (ST5)."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"))
    return d.agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags]).select(F.col("w.start").alias("start"), "n", *flags)


def queue_walk(increments: np.ndarray, start: float, clip: float) -> np.ndarray:
    """The queue min(clip, max(0, queue + increment)) after each increment, from start. A
    step is a function min(h, max(l, q + s)); such functions compose to one of their
    kind, so that all prefixes come from a few rounds over whole arrays."""
    s, low, high = increments.astype(float), np.zeros(len(increments)), np.full(len(increments), float(clip))
    reach = 1
    while reach < len(s):
        a, b = slice(None, -reach), slice(reach, None)
        new = s[a] + s[b], np.clip(low[a] + s[b], low[b], high[b]), np.clip(high[a] + s[b], low[b], high[b])
        s, low, high = (np.concatenate([old[:reach], more]) for old, more in zip((s, low, high), new))
        reach *= 2
    return np.clip(start + s, low, high)


def ages(slots: DataFrame, key: str, cap: int, clip: float, start: int = 0, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Age and virtual queue of each entity as its slots come (ST6): (key, slot, age, queue).

    The state is (age, queue, last slot), one update a batch; a batch's slots are worked
    out as whole arrays. A slot at or before the last is late and is ignored, of equal ones
    the first counts; slots of one entity in a batch are taken in order. slots has slot,
    event, increment, and with ``idle`` also ts: an entity without a row for so long in
    event time loses its state and starts anew, so that the state is that of live entities."""
    kind = slots.schema[key].dataType.simpleString()
    timer = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    hold = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        age, queue, last = state.get if state.exists else (start, 0.0, -1)
        rows = pd.concat(list(frames))
        seen = int(rows["at"].max()) if idle else 0
        rows = rows[rows["slot"] > last].sort_values("slot", kind="stable").drop_duplicates("slot")
        if len(rows):
            at = np.arange(len(rows))
            since = np.maximum.accumulate(np.where(rows["event"].to_numpy(bool), at, -1))
            grown = np.minimum(np.where(since < 0, age + at + 1, at - since + 1), cap)
            walk = queue_walk(rows["increment"].to_numpy(), queue, clip)
            age, queue, last = int(grown[-1]), float(walk[-1]), int(rows["slot"].iloc[-1])
            yield pd.DataFrame({key: k[0], "slot": rows["slot"].to_numpy(), "age": grown, "queue": walk})
        state.update((age, queue, last))
        if idle:
            state.setTimeoutTimestamp(max(seen + hold, state.getCurrentWatermarkMs() + 1))

    d = slots.withWatermark("ts", late) if idle else slots
    more = [F.unix_millis("ts").alias("at")] if idle else []
    d = d.select(key, F.col("slot").cast("long"), F.col("event").cast("boolean"), F.col("increment").cast("double"), *more, *(["ts"] if idle else [])).groupBy(key)
    return d.applyInPandasWithState(step, f"{key} {kind}, slot long, age long, queue double", "age long, queue double, last long", "append", timer)


def complete_states(parents: DataFrame, children: DataFrame, key: str, expected: str, child: str, late: str = "0 seconds", hold: str = "1 hour") -> DataFrame:
    """Parents whose children have all come (ST7): (key, expected, found), once each.

    parents have key, ts and how many they expect; children key, ts and ``child``, by which one
    that comes again counts once. What belongs to a key are its rows no further than ``hold``
    apart in event time, of both streams together: a session, whose state is the set of its children.
    Once the watermark has passed the session's end it comes out, if it is complete, and its
    state goes either way; later rows drop out, so that what is gone does not come back.
    Such a stream runs in append mode; with_end() closes what a finite input leaves open."""
    none = F.lit(None)
    both = parents.select(key, "ts", F.col(expected).cast("long").alias("_want"), none.cast(children.schema[child].dataType).alias("_child"))
    both = both.unionByName(children.select(key, "ts", none.cast("long").alias("_want"), F.col(child).alias("_child")))
    d = both.withWatermark("ts", late).groupBy(F.session_window("ts", hold).alias("_w"), key)
    d = d.agg(F.max("_want").alias(expected), F.size(F.collect_set("_child")).cast("long").alias("found"))
    return d.where(F.col("found") >= F.col(expected)).select(key, expected, "found")

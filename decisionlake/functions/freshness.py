"""Ages, queues and availability over slot logs (entity, slot, ...). Slots count from 0 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.functions.scan import prefix, running_max


def age(log: DataFrame, event: str, cap: int, start: int, out: str = "age") -> DataFrame:
    """log with 1 at an event, one more each slot after it, at most cap; from start before
    the first (TS1, TS2). Slots count from 1."""
    d = running_max(log, "_last", F.when(F.col(event), F.col("slot")))
    return d.withColumn(out, F.expr(f"cast(least(case when _last is null then {start} + slot else 1 + slot - _last end, {cap}) as bigint)")).drop("_last")


def waiting(log: DataFrame, event: str, cap: int, out: str = "waiting") -> DataFrame:
    """log with 0 at an event, one more each slot after it, at most cap (TS4)."""
    d = running_max(log, "_last", F.when(F.col(event), F.col("slot")))
    return d.withColumn(out, F.expr(f"cast(least(slot - coalesce(_last, 0), {cap}) as bigint)")).drop("_last")


def sensing_age(log: DataFrame, accepted: str, cap: int, start: int, out: str = "age") -> DataFrame:
    """log with the slots since the timestamp of the last accepted estimate, from 1 to cap;
    one more a slot in between, from start before the first; a timestamp in the future is an
    error (TS3)."""
    since = F.when(F.col(accepted) > F.col("slot"), F.raise_error(F.lit("a sensing timestamp lies in the future"))).otherwise(F.greatest(F.lit(1), F.col("slot") - F.col(accepted)))
    d = running_max(log, "_last", F.when(F.col(accepted).isNotNull(), F.struct("slot", since.cast("long").alias("age"))))
    return d.withColumn(out, F.expr(f"cast(least(coalesce(least(_last.age, {cap}) + slot - _last.slot, {start} + slot), {cap}) as bigint)")).drop("_last")


def virtual_queue(log: DataFrame, clip: float) -> DataFrame:
    """Q' = min(clip, max(0, Q + g)) along an entity's slots (TS6). Each step is a
    function min(h, max(l, q + s)); these compose to one of their kind, so that the queue
    before a slot comes from prefix()."""
    g = "case when {0} is null then 0D else {0} end"
    f = log.selectExpr("entity", "slot", f"named_struct('s', cast({g.format('increment')} as double), 'l', 0D, 'h', {clip}D) as f")
    then = "named_struct('s', {a}.s + {b}.s, 'l', least({b}.h, greatest({b}.l, {a}.l + {b}.s)), 'h', least({b}.h, greatest({b}.l, {a}.h + {b}.s)))"
    before = prefix(f, ["entity"], "slot", "f", then, f"named_struct('s', 0D, 'l', 0D, 'h', {clip}D)")
    d = log.select("entity", "slot", F.col("increment").cast("double").alias("g")).alias("a").join(before.alias("b"), (F.col("a.slot") == F.col("b.slot")) & F.col("a.entity").eqNullSafe(F.col("b.entity")))
    return d.selectExpr("a.entity as entity", "a.slot as slot", f"least({clip}D, greatest(0D, least(_before.h, greatest(_before.l, _before.s)) + {g.format('g')})) as queue")


def sensing_availability(slots: DataFrame, jobs: DataFrame) -> DataFrame:
    """As-of join (TS7): at each slot the usable job of the greatest timestamp, one of
    smaller trace first: both tables as one log, whose running maximum it is. Jobs that
    become ready in one slot are one row of it."""
    job = F.struct("timestamp", (-F.col("trace")).alias("_t"))
    ready = jobs.groupBy("entity", F.col("ready_slot").cast("long").alias("slot")).agg(F.max(job).alias("_job"), F.lit(False).alias("_own"))
    mine = slots.select("entity", F.col("slot").cast("long").alias("slot"), F.lit(None).cast(ready.schema["_job"].dataType).alias("_job"), F.lit(True).alias("_own"))
    return running_max(ready.unionByName(mine), "available", F.col("_job")).where("_own").select("entity", "slot", "available")


def episode_kpis(log: DataFrame) -> DataFrame:
    """Means and rates a policy over its transitions (TS13): stage cost, the three ages,
    trace, energy, repair distance, fallbacks, hard failures, deliveries and detections."""
    means = {"mean_stage_cost": "stage_cost", "mean_aoi": "mean_aoi", "mean_aoli": "mean_aoli", "mean_aosi": "aosi", "mean_repair_distance": "repair_distance"}
    return log.groupBy("policy").agg(
        F.count("*").alias("n"), F.round(F.avg("covariance_trace"), 6).alias("trace"), F.round(F.avg("energy"), 6).alias("energy"), *(F.round(F.avg(c), 6).alias(n) for n, c in means.items()),
        F.round(F.avg(F.col("fallback_used").cast("double")), 6).alias("fallback_rate"), F.round(F.avg((~F.col("hard_feasible")).cast("double")), 6).alias("hard_failure_rate"),
        F.round(F.sum("deliveries") / F.count("*"), 6).alias("deliveries_per_transition"),
        F.round(F.avg(F.col("delivered").cast("double")), 6).alias("delivery_rate"), F.round(F.avg(F.col("detected").cast("double")), 6).alias("detection_rate"),
    )

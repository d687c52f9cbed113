"""Scans along the slots of an entity, in blocks, so that a busy entity is no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlake.sources.tables import shared_folder

#: Members of a block whose prefixes are folded in one row, and slots of a block that
#: a window runs over.
FOLD, BLOCK = 256, 4096


def prefix(rows: DataFrame, keys: list[str], at: str, element: str, combine: str, empty: str) -> DataFrame:
    """rows (keys, ``at``: a place from 0 on, unique for its keys, and a column ``element``) as (keys,
    at, _before): all elements before a place combined in order, by any associative step.

    ``combine`` is SQL over {a} and {b} of the element's type, ``empty`` its neutral element.
    Blocks of FOLD neighbours are combined, then blocks of these, until an entity is
    one block; what stands before a block goes down the same way. A task holds blocks,
    never an entity, and an entity of n places costs n / FOLD rows a level more."""
    kind = rows.schema[element].dataType.simpleString()
    step = combine.format(a="f", b="x.e")
    walk = combine.format(a="f.c", b="x.e")
    levels = [rows.select(*keys, F.col(at).cast("long").alias("_at"), F.col(element).alias("_e"))]
    top = levels[0].agg(F.max("_at")).first()[0] or 0
    blocks = []
    while True:
        d = levels[-1].groupBy(*keys, F.expr(f"_at div {FOLD}").alias("_b")).agg(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("i"), F.col("_e").alias("e")))).alias("_l"))
        blocks.append(d)
        top //= FOLD
        if not top:
            break
        whole = d.select(*keys, F.col("_b").alias("_at"), F.expr(f"aggregate(_l, cast({empty} as {kind}), (f, x) -> {step})").alias("_e"))
        path = shared_folder(rows.sparkSession, "scan")
        whole.write.parquet(path)
        levels.append(rows.sparkSession.read.schema(whole.schema).parquet(path))
    before = None
    for d in reversed(blocks):
        if before is None:
            d = d.withColumn("_c", F.expr(f"cast({empty} as {kind})"))
        else:
            up = before.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_at").alias("_b"), F.col("_before").alias("_c"))
            on = F.col("a._b") == F.col("b._b")
            for k in keys:
                on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b._k_{k}"))
            d = d.alias("a").join(up.alias("b"), on).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a._b").alias("_b"), "_l", "_c")
        told = f"aggregate(_l, named_struct('c', _c, 'o', cast(array() as array<{kind}>)), (f, x) -> named_struct('c', {walk}, 'o', array_append(f.o, f.c))).o"
        before = d.select(*keys, F.expr(f"inline(arrays_zip(transform(_l, x -> x.i), {told}))")).toDF(*keys, "_at", "_before")
    return before.withColumnRenamed("_at", at)


def running_max(log: DataFrame, out: str, value: Column, slot: str = "slot", entity: str = "entity") -> DataFrame:
    """log with ``out``: the largest ``value`` (of any type that has an order) at an entity's
    slots up to each row's, nulls left out. Slots count from 0 or more. A window runs over BLOCK slots; what the
    blocks before hold is carried in by prefix()."""
    d = log.withColumns({"_block": F.floor(F.col(slot) / BLOCK).cast("long"), "_value": value})
    sums = d.groupBy(entity, "_block").agg(F.max("_value").alias("_e"))
    larger = "case when {a} is null or {b} > {a} then {b} else {a} end"
    carry = prefix(sums, [entity], "_block", "_e", larger, "null").withColumnRenamed("_block", "_b").withColumnRenamed(entity, "_entity")
    window = Window.partitionBy(entity, "_block").orderBy(slot).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_inner", F.max("_value").over(window))
    d = d.join(carry, (F.col("_block") == F.col("_b")) & F.col(entity).eqNullSafe(F.col("_entity")), "left")
    return d.withColumn(out, F.expr("case when _inner is null or _before > _inner then _before else _inner end")).select(*log.columns, out)

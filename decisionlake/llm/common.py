"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def release() -> None:
    """At the start and end of an operator's tasks: give back what this Python worker has
    freed, so that it does not count beside what the next task or another worker needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's readers accept any path they know."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where
    that is unset on a single machine, as in tests; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="decisionlake-"))
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives
    lost executors, and gives Spark the true size for its broadcast decisions."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/decisionlake/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[str], tag: str) -> DataFrame:
    """df with ``_rank``, from 0 without gaps in each group by ``order`` (columns without
    nulls in ``group``; nulls first in ``order``), written once.

    Rows are sorted over all tasks by ranges; what is counted is one row a task and group,
    so that no task holds a group. Rows that agree in group and order are dealt to ranges
    by their place in the input, so that they may differ in which of their ranks each gets."""
    by = [*group, *order, "_row"]
    d = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    d = materialize(d.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row"), tag)
    runs = d.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    over = "partition by {} order by _part rows between unbounded preceding and 1 preceding".format(", ".join(group) or "1")
    runs = materialize(runs.selectExpr(*group, "_part", f"coalesce(sum(_n) over ({over}), 0) - _first as _shift"), tag)
    return attach(d, runs, [*group, "_part"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


#: Rows of a table that is broadcast (a few numbers and a short key each), and the
#: salts of a hot key's rows where the table is larger.
_FEW, _SALTS = 100_000, 64


def attach(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with ``few`` (written before, one row a key). Counted: up to _FEW rows
    it is broadcast; beyond that each of its rows is repeated a salt, so that the rows
    of a hot key meet it in _SALTS tasks."""
    if few.count() <= _FEW:
        return rows.join(F.broadcast(few), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(each, [*keys, "_salt"], how).drop("_salt")


#: Bytes of text that a task works on at a time.
_BYTES = 4 << 20


def small(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = _BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about ``most`` bytes of a text column: batches are cut by rows,
    and what a task makes of one grows with its bytes. An empty batch stays one."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy()
        step = np.cumsum(size, dtype=np.int64) // most
        cut = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(size)]
        for a, b in zip(cut, cut[1:]):
            yield batch.slice(a, b - a)
    release()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column of an Arrow batch as strings, null as empty."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _stars(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars around their smallest nodes: no node is the larger end
    of two edges, or the larger end of one and the smaller of another."""
    seen = Observation()
    ends = edges.selectExpr("stack(2, a, 1, 0, b, 0, 1) as (node, up, down)")
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    ends.observe(seen, F.count(F.when(F.expr("up + down > 1"), 1)).alias("n")).write.format("noop").mode("overwrite").save()
    return not seen.get["n"]


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long) as (node, component), component
    the smallest node. Alternating large-star and small-star rounds over joins, until
    the edges are stars, as they often are from the start: a look is two jobs, a round
    seven. Only a row count a round reaches the driver. Nodes without an edge to another
    node do not appear. Null ends are dropped.
    """
    cur = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        tag,
    )
    for _ in range(max_rounds):
        if _stars(cur):
            break
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        cur = materialize(small, tag)
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


#: Bits of the table of likely(), 4096 bytes a row: 2 MB, whatever the data.
_BITS, _ROW = 1 << 24, 1 << 15


def likely(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """rows with ``_likely``: false only where no row of ``wanted`` has the key (long, not
    null). A bitmap of the wanted keys, of a fixed size, is broadcast, so that most
    rows that a join would drop need not be shuffled to it; where very many are wanted it
    fills up and tells less, but nothing wrong."""
    bit = F.pmod(wanted_key, F.lit(_BITS))
    bits = wanted.select(F.floor(bit / _ROW).cast("int").alias("_row"), F.pmod(bit, F.lit(_ROW)).alias("_bit"))
    bits = bits.groupBy("_row").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))
    rows = rows.withColumn("_bit", F.pmod(key, F.lit(_BITS))).withColumn("_row", F.floor(F.col("_bit") / _ROW).cast("int"))
    byte = F.conv(F.hex(F.substring("_bits", (F.pmod("_bit", F.lit(_ROW)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = F.expr("getbit({}, cast(pmod(_bit, 8) as int))".format("_byte"))
    rows = rows.join(F.broadcast(bits), "_row", "left").withColumn("_byte", F.coalesce(byte, F.lit(0)))
    return rows.withColumn("_likely", told == 1).drop("_row", "_bit", "_bits", "_byte")


def in_units(rows: DataFrame, keys: list[str], row_id: str, limit: int, tag: str) -> DataFrame:
    """rows dealt to units of comparison, sorted within partitions by ``keys, _i, _j``.

    A key of at most ``limit`` rows is one unit. A larger one is split by a hash of
    row_id to chunks of about ``limit`` rows, and each two chunks meet in a unit
    (_i <= _j; in a unit with _i < _j only pairs across the chunks count), so that no
    task holds a whole hot key and every pair still meets once. ``_at`` is a row's chunk.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    sizes = materialize(sizes.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_c")), tag)
    split = rows.join(sizes, keys, "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    split = split.withColumn("_at", F.pmod(F.xxhash64(row_id, F.lit("unit")), F.col("_c")).cast("int"))
    split = split.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    split = split.withColumns({"_i": F.least("_at", "_o"), "_j": F.greatest("_at", "_o")}).drop("_c", "_o")
    by = [*keys, "_i", "_j"]
    return split.repartition(*by).sortWithinPartitions(*by)


def runs(batches, keys: list[str]):
    """Tables of the consecutive rows of Arrow batches that agree in ``keys`` (no nulls)."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        cols = np.stack([part.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
        cut = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist(), len(cols)]
        for a, b in zip(cut, cut[1:]):
            key = tuple(cols[a])
            if last is not None and key != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held).combine_chunks()
    del held
    release()


def roots(n: int, left, right) -> np.ndarray:
    """Smallest member of each of n nodes' component under links left[i] - right[i]."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    return root

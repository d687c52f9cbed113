"""JSON-lines tables: reading, crash-tolerant reading, writing, flat export."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from decisionlake.functions.jsontext import closed, is_object, whole

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir), or in
    one of our own where that is unset on a single machine, as in tests; on a cluster it
    must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="decisionlake-"))
    return f"{base.rstrip('/')}/decisionlake/{tag}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON-lines table of a fixed schema (IO1); blank lines are skipped, a line that is
    not one JSON object, or has text after it, is an error."""
    return parsed(spark.read.text(path), schema)


def parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """Lines (value, and other columns, which stay in front) as rows of a schema, each one
    JSON object; blank ones are skipped."""
    items, closing = closed(F.col("value"), schema, "FAILFAST")
    keep = [c for c in lines.columns if c != "value"]
    d = lines.where(F.trim("value") != "").select(*keep, items.alias("_items"), closing.alias("_closing"), "value")
    wrong = F.raise_error(F.concat(F.lit("not one JSON object in a line: "), F.substring("value", 1, 200)))
    row = F.when(whole(F.col("_items"), F.col("_closing")), F.get("_items", F.lit(0))).otherwise(wrong)
    return d.select(*keep, row.alias("_r")).select(*keep, *(F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields))


def read_valid_prefix(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Each file's lines before its first that is no JSON object; blank lines are
    skipped (IO2). Lines are placed by the start of their block and their order in it."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at")
    ).where(F.trim("value") != "")
    stops = lines.where(~is_object(F.col("value"))).groupBy("_f").agg(F.min("_at").alias("_stop"))
    kept = lines.join(stops, "_f", "left").where("_stop is null or _at < _stop")
    return kept.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_table(df: DataFrame, path: str) -> None:
    """Append rows as one JSON object a line, keys sorted (IO3)."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def _encoded(c: Column, kind: DataType) -> Column:
    if isinstance(kind, DoubleType):
        return F.when(F.isnan(c), F.raise_error(F.lit("NaN can't be written"))).otherwise(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _encoded(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_encoded(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def encode_special_doubles(df: DataFrame) -> DataFrame:
    """df for write_table(), whose writer puts infinities down as the texts Infinity and
    -Infinity and other doubles as numbers; NaN is an error, also in arrays and structs (IO4)."""
    return df.select(*[_encoded(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as columns with dotted names (IO5)."""
    def leaves(c: Column, name: str, kind: DataType):
        if isinstance(kind, StructType):
            for f in kind.fields:
                yield from leaves(c[f.name], f"{name}.{f.name}", f.dataType)
        else:
            yield c.alias(name)

    return df.select(*[x for f in df.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.name, f.dataType)])


def flatten_export(df: DataFrame, path: str) -> None:
    flatten(df).write.parquet(path)

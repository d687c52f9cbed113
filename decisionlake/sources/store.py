"""Tables by key in hash buckets, whose versions appear in one step.

A table is a folder: ``data`` has the buckets as they were written, never changed after;
``log`` has a file a version, which tells where the buckets it replaces now are. A version
is seen once its one file is there, so a reader sees the old rows or the new ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOG = "bucket int, folder string, batch long, version long"


@dataclass(frozen=True)
class BucketTable:
    """A table at ``root`` with rows by ``keys``. The number of buckets is fixed for good:
    one bucket is rewritten by one task, so choose it for buckets of a task's size. One
    writer at a time; a second one that publishes the same version fails."""

    spark: SparkSession
    root: str
    keys: list[str]
    schema: StructType
    buckets: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self) -> BucketTable:
        """An empty first version."""
        self._publish([], 0, -1)
        return self

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")

    def _publish(self, rows: list[tuple[int, str]], version: int, batch: int) -> None:
        # the row of bucket -1 stands for the version itself
        made = self.spark.createDataFrame([(-1, None, batch), *((b, f, batch) for b, f in rows)], "bucket int, folder string, batch long")
        made.coalesce(1).write.mode("error").parquet(f"{self.root}/log/version={version}")

    def version(self, before_batch: int | None = None) -> tuple[int, int]:
        """(version, batch) of the newest version, or of the newest whose batch is smaller."""
        log = self._log().where("bucket = -1")
        if before_batch is not None:
            log = log.where(F.col("batch") < before_batch)
        return tuple(log.agg(F.max(F.struct("version", "batch")).alias("v")).select("v.*").first())

    def folders(self, version: int, wanted: list[int] | None = None) -> dict[int, str]:
        """Where the buckets of a version are (a row a bucket at most)."""
        log = self._log().where((F.col("bucket") >= 0) & (F.col("version") <= version))
        if wanted is not None:
            log = log.where(F.col("bucket").isin(wanted))
        return dict(log.groupBy("bucket").agg(F.max_by("folder", "version")).collect())

    def read(self, wanted: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest), of some buckets or of all."""
        at = self.folders(self.version()[0] if version is None else version, wanted)
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*at.values())

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall in: a bitmap of fixed size, whatever the rows."""
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def replace(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> int:
        """Publish a version in which the buckets that rows touch hold merge(old, rows): only
        these are read and written. ``rows`` is read twice, so it should be written before.
        With a ``batch`` number, one that was published already is left alone: run again, it
        changes nothing. Returns the version."""
        version, last = self.version()
        if batch is not None and batch <= last:
            return version
        some = self.touched(rows)
        merged = merge(self.read(some, version), rows).select(*self.schema.names)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        merged.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        at = sorted(r[0] for r in self.spark.read.parquet(folder).select("_bucket").distinct().collect()) if some else []
        self._publish([(b, f"{folder}/_bucket={b}") for b in at], version + 1, last if batch is None else batch)
        return version + 1

"""What the operators share: the shared folder, written tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the characters that part words, in every contract of this package.
WORD_GAP = r"[\x20\x09-\x0D]+"

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FALLBACK_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one in the warehouse, or on a single machine a new local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/veritrail-scratch"
    if not _FALLBACK_DIR:
        _FALLBACK_DIR.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _FALLBACK_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that an operator writes for itself in the shared folder.

    Later jobs reuse them, and a lost executor costs nothing.  All are deleted
    at the end of the ``with`` block, also after a failure, so a result that
    outlives it is materialized first.  ``batch``: rows that go to Python at
    once until then, for operators whose rows are long.
    """

    def __init__(self, spark: SparkSession, batch: int | None = None) -> None:
        self.spark = spark
        self.batch, self.batch_before = batch, None
        self.paths: list[str] = []
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        if self.batch:
            self.batch_before = self.spark.conf.get(_BATCH)
            self.spark.conf.set(_BATCH, str(self.batch))
        return self

    def __exit__(self, *failure) -> None:
        if self.batch:
            self.spark.conf.set(_BATCH, self.batch_before)
        for path in self.paths:
            remove(self.spark, path)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def bucketed(self, df: DataFrame, name: str, buckets: int, columns: list[str]) -> DataFrame:
        """``df`` as a table in the warehouse, bucketed by ``columns``: joins on them deal only their other side."""
        self.tables.append(f"veritrail_{name}_{uuid.uuid4().hex}")
        df.repartition(buckets, *columns).write.option("compression", "zstd").bucketBy(buckets, *columns).saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def path(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, self.path(name))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; the caller's result, which stays."""
    return _written(df, fresh_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text, the runs of characters other than ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)

"""The folder that driver and executors share, for tables that queries write for later ones."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of the warehouse, or on a single machine a new local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/veritrail-tables"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, for what several branches of a query read."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *columns: str) -> tuple[DataFrame, str]:
    """``df`` as a table of the shared folder, and the table's name; what groups or joins it by ``columns`` needs no shuffle."""
    spark = df.sparkSession
    table = f"veritrail_{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", fresh_path(spark, name)).bucketBy(buckets, *columns).saveAsTable(table)
    return spark.table(table), table

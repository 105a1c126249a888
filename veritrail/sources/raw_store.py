"""Content-addressed raw evidence: binary files in, immutable addresses out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, sha256, content) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")


def decode_html(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, otherwise as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def append_new(raw: DataFrame, store: str) -> DataFrame:
    """Append contents that ``store`` does not hold, partitioned by the first two digits of their SHA-256; returns what was new."""
    spark = raw.sparkSession
    one = raw.dropDuplicates(["sha256"]).select("sha256", "byte_size", "content").withColumn("shard", F.left("sha256", F.lit(2)))
    try:
        held = spark.read.parquet(store).select("sha256")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        held = spark.createDataFrame([], "sha256 string")
    new = one.join(held, "sha256", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(store)
    return new.select("sha256", "byte_size")


def verify(store: DataFrame) -> DataFrame:
    """Addresses whose bytes no longer hash or measure to what they say."""
    return store.where((F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("byte_size"))).select("sha256")

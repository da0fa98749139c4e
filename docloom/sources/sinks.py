"""Sinks: committed overwrites, appends, versioned directories, CSV and JSON exports, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, path: str):
    """The path, a draft beside it, and their file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    return target, part, target.getFileSystem(conf)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines. An overwrite is written beside the target first, so a failed job leaves the old rows."""
    if mode != "overwrite":
        df.write.mode(mode).json(path)
        return
    target, part, fs = _paths(df.sparkSession, path)
    df.write.json(part.toString())
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(part, target)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def write_json(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side document: written beside the target, then renamed over it in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part, fs = _paths(spark, path)
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.hsync()
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), how)


def replace_table(df: DataFrame, base: str) -> str:
    """Writes a new version of a table and points `base/current` at it; readers of the old one go on."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{version}")
    write_json(df.sparkSession, f"{base}/current", version)
    return version


def read_table(spark: SparkSession, base: str) -> DataFrame:
    version = spark.read.text(f"{base}/current").first()[0]
    return spark.read.parquet(f"{base}/{version}")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; metric tables are a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def query_log(rows: DataFrame) -> DataFrame:
    """Answered questions as log rows; the mode is logged with its version."""
    mode = F.when(F.col("retrieval_mode") == "hybrid", "hybrid_v1").otherwise("vector_v2")
    return rows.withColumn("retrieval_mode", mode)


def bench_rows(timings: DataFrame) -> DataFrame:
    """Long (version, collection_id, embedder_id, key, value, op) events -> one row each: `add` sums, `set` overwrites by seq."""
    keys = ["version", "collection_id", "embedder_id"]
    each = timings.groupBy(*keys, "key").agg(F.sum(F.when(F.col("op") == "add", F.col("value"))).alias("added"), F.max_by(F.when(F.col("op") == "set", F.col("value")), F.when(F.col("op") == "set", F.col("seq"))).alias("put"))
    pairs = F.map_from_entries(F.collect_list(F.struct("key", F.coalesce("put", "added"))))
    return each.groupBy(*keys).agg(pairs.alias("metrics"))

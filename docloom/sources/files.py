"""File sources: raw uploads, JSON and JSON lines, gold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

GOLD = "query string, answerable boolean, expected_answer string, gold_chunk_ids array<string>, relevant_chunk_ids array<string>, source_ids array<string>, multi_hop boolean, notes string"


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content and file_type of every file below a directory."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("file_type", T.file_type(F.col("path")))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Strict JSON lines; blank lines are skipped. An absent path is empty with `missing_ok`."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows. Presence of a key counts, even with null: `answerable` else a given expected answer;
    relevant_chunk_ids before gold_chunk_ids."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", GOLD, {"mode": "FAILFAST"}).alias("g"), F.json_object_keys("value").alias("keys"))
    has = lambda k: F.array_contains("keys", k)
    none = F.array().cast("array<string>")
    return rows.select(
        T.strip(F.coalesce("g.query", F.lit(""))).alias("query"),
        F.when(has("answerable"), F.coalesce("g.answerable", F.lit(False))).otherwise(F.col("g.expected_answer").isNotNull()).alias("answerable"),
        F.coalesce("g.expected_answer", F.lit("")).alias("expected_answer"),
        F.coalesce(F.when(has("relevant_chunk_ids"), F.col("g.relevant_chunk_ids")).otherwise(F.col("g.gold_chunk_ids")), none).alias("gold_chunk_ids"),
        F.coalesce("g.source_ids", none).alias("source_ids"), F.coalesce("g.multi_hop", F.lit(False)).alias("multi_hop"), F.coalesce("g.notes", F.lit("")).alias("notes"),
    )

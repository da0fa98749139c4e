"""Corpus pipeline: quality, line runs, near copies, benchmark leaks, sampled segmentations.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. `run` applies them in order; a driver may as well write each stage's rows and read them
back. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import edit_lsh, fast_sketch, gumbel_pieces, line_runs, quality_fm
from docloom.llm.common import Scratch, bounded_batches, small
from docloom.llm.queries import held_out, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 go. The model learns from labels that are not held out."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    model = quality_fm.train(docs, held_out(table(spark, sf_dir, "labels")).where("not held_out"))
    return quality_fm.score(docs, model, *COLUMNS).where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; texts with nothing else go."""
    out = line_runs.dedup(docs.select(*COLUMNS)).where("not emptied")
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    out = fast_sketch.near_duplicates(docs, width=5, percent=80)
    gone = Scratch(spark, "near").save(out.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the edit distance, go."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    found = edit_lsh.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = Scratch(spark, "leaks").save(found.select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left."""
    bounded_batches(spark)
    return gumbel_pieces.segment(docs, k=3)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("pieces", pieces)]
#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    disk = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = disk.save(docs, name)
    return docs

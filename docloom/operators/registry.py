"""Collections, documents, jobs and the panel: tables with merge-style updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.evaluation import last_per_key

STAGES = ("INGEST", "EXTRACT", "CLEAN", "CHUNK", "EMBED", "INDEX", "GRAPH", "DONE")
LABELS = {"INGEST": "Uploading", "EXTRACT": "Extracting", "CLEAN": "Cleaning", "CHUNK": "Chunking", "EMBED": "Embedding", "INDEX": "Indexing", "GRAPH": "Building graph", "DONE": "Done"}
EMBEDDINGS = "array<struct<embedder_id:string,dim:int,created_at:string>>"


def ingest_files(files: DataFrame, collection_id: str) -> DataFrame:
    """binaryFile rows -> manifest documents, identified by the hash of their bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.lit(collection_id).alias("collection_id"), F.sha2("content", 256).alias("doc_id"), F.sha2("content", 256).alias("sha256"), name.alias("file_name"), T.file_type(name).alias("file_type"), F.col("length").alias("file_size"), F.col("path").alias("raw_path"), F.lit("ingested").alias("status"))


def manifest(collections: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted collection with its mode, vector by default, and number of documents."""
    n = docs.groupBy("collection_id").agg(F.count("*").alias("n"))
    rows = wanted.join(collections, "collection_id", "left").join(n, "collection_id", "left")
    return rows.select("collection_id", F.coalesce("retrieval_mode", F.lit("vector")).alias("retrieval_mode"), F.coalesce("n", F.lit(0)).alias("n_docs"))


def upsert_docs(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by (collection_id, doc_id): new values win, other columns and the position stay."""
    keys = ["collection_id", "doc_id"]
    mine = [c for c in docs.columns if c not in keys]
    extra = [c for c in new.columns if c not in keys]
    both = docs.join(new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in extra]), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) if c in extra else F.col(c) for c in mine], *[F.col(f"_n_{c}").alias(c) for c in extra if c not in mine])


def upsert_embedding(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds or replaces an embedder's entry in each document's array; entries: doc_id, embedder_id, dim, created_at."""
    e = entries.groupBy("doc_id").agg(F.max_by(F.struct("embedder_id", F.col("dim").cast("int").alias("dim"), "created_at"), "created_at").alias("e"))
    have = F.coalesce("embeddings", F.array().cast(EMBEDDINGS))
    at = F.filter(have, lambda x: x["embedder_id"] == F.col("e.embedder_id"))
    new = F.when(F.size(at) > 0, F.transform(have, lambda x: F.when(x["embedder_id"] == F.col("e.embedder_id"), F.col("e")).otherwise(x))).otherwise(F.array_append(have, F.col("e")))
    return docs.join(e, "doc_id", "left").withColumn("embeddings", F.when(F.col("e").isNull(), have).otherwise(new)).drop("e")


def attribute(docs: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    return wanted.join(docs.select("doc_id", *names).dropDuplicates(["doc_id"]), "doc_id", "left")


def file_list(docs: DataFrame, collection_id: str) -> DataFrame:
    rows = docs.where(F.col("collection_id") == collection_id)
    return rows.select("doc_id", "file_name", F.concat_ws("/", F.lit("/collections"), "collection_id", F.lit("files"), "file_name").alias("url"))


def stage_state(events: DataFrame) -> DataFrame:
    """stage_events (job_id, seq, stage, status, ts, reason) -> the job's stages; a stage starts once."""
    rows = events.groupBy("job_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("status").isin("done", "failed"), F.col("ts"))).alias("ended_at"), F.max_by("reason", "seq").alias("reason"))
    return rows


def job_status(events: DataFrame) -> DataFrame:
    """(job_id, status, stage, label, error): the state a client polls; done is shown as ready."""
    last = last_per_key(events, ["job_id"], "seq")
    error = events.where("reason is not null").groupBy("job_id").agg(F.max_by("reason", "seq").alias("error"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("stage"))
    status = F.when((F.col("stage") == "DONE") & (F.col("status") == "done"), "ready").when(F.col("status") == "failed", "failed").otherwise("running")
    return last.join(error, "job_id", "left").select("job_id", status.alias("status"), "stage", label.alias("label"), "error")


def job_outcome(docs: DataFrame) -> DataFrame:
    """(job_id, ok, fail_reason): a job succeeds if any of its documents is done with an id and no reason."""
    good = F.bool_or((F.coalesce("doc_id", F.lit("")) != "") & F.col("fail_reason").isNull() & (F.col("status") == "done"))
    return docs.groupBy("job_id").agg(good.alias("ok")).withColumn("fail_reason", F.when(~F.col("ok"), "ALL_DOCS_FAILED_BY_EMBED"))


def delete_collection(tables: dict[str, DataFrame], collection_id: str) -> dict[str, DataFrame]:
    """Every table without the collection; jobs and logs are to be left out by the caller."""
    return {n: t.where(F.col("collection_id") != collection_id) for n, t in tables.items()}


def directory_size(files: DataFrame) -> DataFrame:
    """(collection_id, bytes) of a binaryFile-like listing (collection_id, length)."""
    return files.groupBy("collection_id").agg(F.sum("length").alias("bytes"))


def embedding_panel(bench: DataFrame) -> DataFrame:
    """The last bench row of each (collection, embedder): avoided share and estimated seconds saved."""
    last = last_per_key(bench, ["collection_id", "embedder_id"], "seq")
    total, skip, done, sec = (F.coalesce(c, F.lit(0)) for c in ("chunks_total", "chunks_skipped", "chunks_embedded", "embed_s"))
    return last.select("collection_id", "embedder_id", F.round(F.when(total > 0, skip / total * 100).otherwise(0.0), 2).alias("avoidance_pct"), F.round(F.when(done > 0, sec / done * skip).otherwise(0.0), 4).alias("time_saved_s"))


def panel(wanted: DataFrame, collections: DataFrame, docs: DataFrame, jobs: DataFrame, bench: DataFrame, index_meta: DataFrame, graph_stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each wanted collection; missing parts are null and sizes 0."""
    job = last_per_key(jobs, ["collection_id"], "created_at", "seq").select("collection_id", F.col("status").alias("job_status"), "current_stage")
    rows = wanted.join(collections.select("collection_id", "retrieval_mode", F.lit("ok").alias("state")), "collection_id", "left")
    n = docs.groupBy("collection_id").agg(F.count("*").alias("total_docs"))
    rows = rows.join(n, "collection_id", "left").join(job, "collection_id", "left").join(embedding_panel(bench).drop("embedder_id"), "collection_id", "left")
    rows = rows.join(index_meta.select("collection_id", "vector_count", "dim", "metric"), "collection_id", "left").join(graph_stats.select("collection_id", "chunk_nodes", "next_edges"), "collection_id", "left").join(sizes, "collection_id", "left")
    hybrid = lambda c: F.when(F.col("retrieval_mode") == "hybrid", F.col(c)).alias(c)
    return rows.select("collection_id", F.coalesce("state", F.lit("no_collection")).alias("state"), "retrieval_mode", F.coalesce("total_docs", F.lit(0)).alias("total_docs"), "job_status", "current_stage", "avoidance_pct", "time_saved_s", "vector_count", "dim", "metric", hybrid("chunk_nodes"), hybrid("next_edges"), F.coalesce("bytes", F.lit(0)).alias("storage_bytes"))

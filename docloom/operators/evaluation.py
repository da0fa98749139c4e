"""Offline evaluation: gold rows joined with the latest log rows, metrics, summaries, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

ABSTAINED = "not found in documents."
METRICS = ("recall@10", "multihop_recall@10", "citation_precision", "abstention_accuracy", "unsupported_claim_rate", "answer_f1", "graph_contribution_rate")
MODES = {"vector": "vector", "hybrid": "hybrid", "vector_v2": "vector", "hybrid_v1": "hybrid"}


def some(c: Column, other: Column) -> Column:
    """An array, or `other` where it is null or empty."""
    return F.when(F.size(c) > 0, c).otherwise(other)


def latest_log(log: DataFrame, mode: str | None = None) -> DataFrame:
    """The last row by `seq` of each stripped, non-empty query."""
    rows = log.withColumn("query", T.strip(F.coalesce("query", F.lit("")))).where("query <> ''")
    if mode is not None:
        rows = rows.where(F.col("retrieval_mode") == mode)
    last = rows.groupBy("query").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "query"]), "seq").alias("r"))
    return last.select("query", "r.*")


def pairs(gold: DataFrame, log: DataFrame, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matched gold rows with their log row, gold rows without one); duplicate gold rows stay."""
    last = latest_log(log, mode)
    cols = [F.col(c).alias(f"log_{c}") for c in last.columns if c != "query"]
    full = gold.join(last.select("query", F.lit(True).alias("_hit"), *cols), "query", "left")
    return full.where("_hit").drop("_hit"), full.where("_hit is null").select(*gold.columns)


def accessors(rows: DataFrame) -> DataFrame:
    """Adds answer, cited_ids (numbers), context (names), context_ids and graph_ids, from either log spelling."""
    cols = set(rows.columns)
    get = lambda c, kind: F.col(f"log_{c}") if f"log_{c}" in cols else F.lit(None).cast(kind)
    src = "array<struct<source_idx:int,source_name:string,chunk_id:string>>"
    sources = some(get("sources", src), F.coalesce(get("final_context", src), F.array().cast(src)))
    cited = some(get("debug_citations", "array<string>"), F.coalesce(get("citations", "array<string>"), F.array().cast("array<string>")))
    rows = rows.withColumn("answer", T.or_else(get("answer_text", "string"), F.coalesce(get("answer", "string"), F.lit(""))))
    rows = rows.withColumn("_sources", sources).withColumn("cited", F.array_distinct(cited))
    name = lambda s: F.coalesce(s["source_name"], F.lit(""))
    rows = rows.withColumn("context_names", F.filter(F.transform("_sources", name), lambda x: x != ""))
    rows = rows.withColumn("context_ids", F.filter(F.transform("_sources", lambda s: F.coalesce(s["chunk_id"], F.lit(""))), lambda x: x != ""))
    by_number = lambda field: F.array_distinct(F.filter(F.flatten(F.transform("cited", lambda n: F.transform(F.filter("_sources", lambda s: s["source_idx"].cast("string") == n), lambda s: F.coalesce(s[field], F.lit(""))))), lambda x: x != ""))
    rows = rows.withColumn("cited_names", by_number("source_name")).withColumn("cited_ids", by_number("chunk_id"))
    return rows.withColumn("graph_ids", F.coalesce(get("graph_retrieved", "array<string>"), F.array().cast("array<string>"))).drop("_sources")


def with_gold_names(gold: DataFrame, names: DataFrame) -> DataFrame:
    """Adds gold_names: file names of source_ids by `names` (source_id, file_name); unknown ids drop out."""
    lists = gold.where(F.size("source_ids") > 0).select("source_ids").distinct()
    got = lists.select("source_ids", F.explode("source_ids").alias("source_id")).join(names, "source_id").groupBy("source_ids").agg(F.sort_array(F.collect_set("file_name")).alias("gold_names"))
    return gold.join(got, "source_ids", "left").select(*gold.columns, F.coalesce("gold_names", F.array().cast("array<string>")).alias("gold_names"))


def recall(found: Column, gold: Column, k: int = 10) -> Column:
    """Share of distinct gold values in the first k found; null without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, F.slice(found, 1, k))) / F.size(g))


def precision(cited: Column, gold: Column) -> Column:
    """Share of distinct cited values in gold; 0 without citations, then null without gold."""
    c = F.array_distinct(cited)
    return F.when(F.size(c) <= 0, 0.0).when(F.size(gold) > 0, F.size(F.array_intersect(c, gold)) / F.size(c))


def abstained(answer: Column) -> Column:
    return T.normalize_answer(answer) == ABSTAINED


def abstention(answer: Column, answerable: Column) -> Column:
    return (abstained(answer) == ~answerable).cast("double")


def unsupported(answer: Column, answerable: Column, cited_ids: Column, gold_ids: Column) -> Column:
    bad = F.when(F.size(cited_ids) <= 0, 1.0).when(F.size(gold_ids) <= 0, 0.0).when(F.size(F.array_except(cited_ids, gold_ids)) == 0, 0.0).otherwise(1.0)
    return F.when(~answerable, F.when(abstained(answer), 0.0).otherwise(1.0)).otherwise(bad)


def exact_match(answer: Column, gold: Column) -> Column:
    return (T.normalize_answer(answer) == T.normalize_answer(gold)).cast("double")


def token_f1(rows: DataFrame, key: str, answer: str, gold: str) -> DataFrame:
    """(key, f1): multiset overlap of words; both empty 1, one empty 0.

    Tokens are exploded and counted, so long texts are combined before the shuffle.
    """
    side = lambda c, w: rows.select(key, F.explode(T.words(F.col(c))).alias("w"), F.lit(w).alias("side"))
    each = side(answer, 0).union(side(gold, 1)).groupBy(key, "w").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sums = each.groupBy(key).agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    full = rows.select(key).distinct().join(sums, key, "left").na.fill(0, ["both", "a", "b"])
    p, r = F.col("both") / F.col("a"), F.col("both") / F.col("b")
    f1 = F.when((F.col("a") == 0) & (F.col("b") == 0), 1.0).when((F.col("a") == 0) | (F.col("b") == 0) | (F.col("both") == 0), 0.0).otherwise(2 * p * r / (p + r))
    return full.select(key, f1.alias("f1"))


def graph_contribution(context_ids: Column, graph_ids: Column) -> Column:
    return F.when(F.size(context_ids) > 0, F.size(F.filter(context_ids, lambda x: F.array_contains(graph_ids, x))) / F.size(context_ids)).otherwise(0.0)


def per_query(gold: DataFrame, log: DataFrame, names: DataFrame, mode: str | None = None, k: int = 10) -> DataFrame:
    """One row for each matched gold row with every metric, rounded to 6 decimals."""
    rows = accessors(pairs(with_gold_names(gold, names), log, mode)[0])
    # the score depends on the two texts alone, so their hash is a key that a recomputed row keeps
    rows = rows.withColumn("_n", F.sha2(F.concat_ws("\x00", "answer", "expected_answer"), 256))
    f1 = token_f1(rows.where("coalesce(expected_answer, '') <> ''").select("_n", "answer", "expected_answer").distinct(), "_n", "answer", "expected_answer")
    rows = rows.join(f1, "_n", "left")
    hit = recall(F.col("context_names"), F.col("gold_names"), k)
    hybrid = F.col("log_retrieval_mode").isin("hybrid", "hybrid_v1")
    out = {
        f"recall@{k}": hit, f"multihop_recall@{k}": F.when(F.col("multi_hop"), hit), "citation_precision": precision(F.col("cited_names"), F.col("gold_names")),
        "abstention_accuracy": abstention(F.col("answer"), F.col("answerable")), "unsupported_claim_rate": unsupported(F.col("answer"), F.col("answerable"), F.col("cited_ids"), F.col("gold_chunk_ids")),
        "answer_em": F.when(F.coalesce("expected_answer", F.lit("")) != "", exact_match(F.col("answer"), F.col("expected_answer"))), "answer_f1": F.col("f1"),
        "graph_contribution_rate": F.when(hybrid, graph_contribution(F.col("context_ids"), F.col("graph_ids"))),
    }
    return rows.select("query", *[F.round(c, 6).alias(n) for n, c in out.items()])


def summary(rows: DataFrame) -> DataFrame:
    """(name, value, count): the mean of every metric column over its non-null rows."""
    names = [c for c in rows.columns if c != "query"]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("v")) for n in names])).alias("m"))
    return long.groupBy("m.name").agg(F.avg("m.v").alias("value"), F.count("m.v").alias("count"))


def metric_map(rows: DataFrame) -> DataFrame:
    """The last row by `pos` of each non-empty name."""
    return rows.where("coalesce(name, '') <> ''").groupBy("name").agg(F.max_by("value", "pos").alias("value"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two summaries (name, value): delta, percent delta, trend."""
    both = a.select("name", F.col("value").alias("vector")).join(b.select("name", F.col("value").alias("hybrid")), "name", "full_outer")
    d = F.col("hybrid") - F.col("vector")
    trend = F.when(d.isNull(), "n/a").when(d > 0, "improved").when(d < 0, "declined").otherwise("unchanged")
    return both.select("name", "vector", "hybrid", d.alias("delta"), F.when(F.col("vector") != 0, d / F.col("vector") * 100).alias("pct_delta"), trend.alias("trend"))


def dashboard_series(comparison: DataFrame, spark) -> DataFrame:
    """Seven fixed metrics times 100 at one decimal, missing as 0; the unsupported-claim rate is turned round."""
    fixed = spark.createDataFrame([(i, n) for i, n in enumerate(METRICS)], "pos int, name string")
    rows = fixed.join(comparison, "name", "left")
    pct = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 100, 1)
    sign = F.when(F.col("name") == "unsupported_claim_rate", -1).otherwise(1)
    return rows.select("pos", "name", pct(F.col("vector")).alias("vector_pct"), pct(F.col("hybrid")).alias("hybrid_pct"), F.round((pct(F.col("hybrid")) - pct(F.col("vector"))) * sign, 1).alias("gain_pp"))


def mode_name(mode: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), mode), mode)


def last_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; on ties of `order` the greater one of its later columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

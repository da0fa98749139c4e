"""The dealt operators as driver queries: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import edit_lsh, fast_sketch, gumbel_pieces, language_id, line_runs, pii, pq_index, quality_fm, secrets, suffix_family


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the driver query; a deployment passes its own.
PII_KEY = b"docloom-demo-key"


def held_out(frame: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text leaves remainder 1 modulo 3."""
    return frame.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = language_id.train(docs.where("not held_out"))
    return held_out(language_id.identify(docs, model)).select("doc_id", "held_out", "lang_pred", "score", "family_pred")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_index.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), key=PII_KEY)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP4_SQL = line_runs.SQL.format(min_chars=200) + """
select c.doc_id, count(*) as n_lines, count(g.p) as n_removed,
  sha256(coalesce(string_agg(c.line, chr(10) order by c.p) filter (g.p is null), '')) as text_sha256
from c left join g on c.doc_id = g.doc_id and c.p = g.p group by c.doc_id
"""


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_lsh.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_fm.train(docs, held_out(table(spark, sf_dir, "labels")).where("not held_out"))
    out = held_out(quality_fm.score(docs, model))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_sketch.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_pieces.report(table(spark, sf_dir, "documents"), k=3)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.report(table(spark, sf_dir, "documents"), length=400)


OP2_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as l from v),
p as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and a.l > 0 and b.l > 0 and list_inner_product(a.e, b.e) >= 0.9 * a.l * b.l),
r(node, root) as (select vec_id, vec_id from embeddings union select p.b, r.root from r join p on p.a = r.node),
c as (select node, min(root) as component_id from r group by 1),
k as (select a, count(*) as n from p group by 1)
select node as vec_id, coalesce(k.n, 0)::bigint as n_links, component_id, node = component_id as kept from c left join k on k.a = node
"""
OP8_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) >= 2 then list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) as sh from w),
x as (select doc_id, unnest(sh) as g, len(sh) as n from s),
p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by 1, 2 having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(node, root) as (select doc_id, doc_id from s union select p.b, r.root from r join p on p.a = r.node),
c as (select node, min(root) as component_id from r group by 1)
select doc_id, len(sh)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on node = doc_id
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_line_dedup": op4_line_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_sentencepiece_sampling": op9_sentencepiece_sampling,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
}

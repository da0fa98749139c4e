"""Driver queries for the engine's operators over the test tables, with the same rows in SQL.

Roles of the tables: documents are pages (document = source, page = rank of doc_id in it) or chunks;
embeddings are vectors, with label as class; conversations are chat turns; events are log-like rows;
lineitem gives layout blocks by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, embedding, evaluation, graph, layout, prompts, registry, retrieval

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def long_(c):
    return c.cast("long")


KNN_SQL = """
q as (select vec_id as q_id, embedding as qv from embeddings where vec_id % 20 = 0),
d as (select q_id, vec_id as row_pos, list_sum(list_transform(list_zip(qv, embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as s from q, embeddings),
k as (select q_id, row_pos, s, row_number() over (partition by q_id order by round(s, 9), row_pos) as rank from d qualify rank <= 10)
"""


def _index(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("row_pos"), F.col("embedding").alias("vector"), "label")


def _knn(spark, sf, k=10):
    index = _index(spark, sf)
    asked = index.where("row_pos % 20 = 0").select(F.col("row_pos").alias("q_id"), F.col("vector").alias("q_vec"))
    return retrieval.knn(asked, index, k)


@query(f"with {KNN_SQL} select q_id, row_pos, round(s, 6) as score, rank::bigint as rank from k")
def knn_topk(spark, sf):
    """R2: exact squared-L2 neighbours of every 20th vector."""
    return _knn(spark, sf).select("q_id", "row_pos", F.round("score", 6).alias("score"), long_(F.col("rank")).alias("rank"))


@query(f"with {KNN_SQL} select q_id, rank::bigint as rank, row_pos, coalesce(source, 'unknown') as source_name, coalesce(length(text), 0)::bigint as n from k left join documents on doc_id = row_pos where rank <= 3")
def knn_hydrate_context(spark, sf):
    """Winners joined with their texts after the cut, names with their fallback."""
    top = retrieval.context(_knn(spark, sf)).withColumn("doc_id", F.col("row_pos"))
    docs = t(spark, sf, "documents")
    named = retrieval.with_source_names(top, docs.select("doc_id", F.col("source").alias("file_name")))
    # documents without a row get the last fallback here, as ids are numbers
    named = named.join(docs.select("doc_id", "text", F.col("source").alias("known")), "doc_id", "left")
    return named.select("q_id", long_(F.col("rank")).alias("rank"), "row_pos", F.coalesce("known", F.lit("unknown")).alias("source_name"), long_(F.coalesce(F.length("text"), F.lit(0))).alias("n"))


def _fuse_inputs(spark, sf):
    v = _knn(spark, sf).select("q_id", F.col("row_pos").alias("chunk_id"), "score", "rank")
    e = t(spark, sf, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "label")
    # the scores do not depend on the question, so a label's best five are found before its questions meet them
    scored = e.select("label", F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 7).cast("double").alias("score"))
    order = (F.desc("score"), "chunk_id")
    # in a salted part of a label first, as one label may hold most vectors
    part = F.row_number().over(Window.partitionBy("label", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).orderBy(*order))
    best = scored.withColumn("rank", part).where("rank <= 5")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where("rank <= 5")
    g = q.join(best, "label").select("q_id", "chunk_id", "score", "rank")
    return v, g


@query(f"""with {KNN_SQL}, g0 as (select q.vec_id as q_id, e.vec_id as chunk_id, (e.vec_id % 7)::double as score from embeddings q join embeddings e using (label) where q.vec_id % 20 = 0),
g1 as (select *, row_number() over (partition by q_id order by score desc, chunk_id) as rank from g0 qualify rank <= 5),
g2 as (select q_id, chunk_id, rank as g_rank, case when max(score) over (partition by q_id) > 0 then score / max(score) over (partition by q_id) else 0 end as g from g1),
b as (select coalesce(k.q_id, g2.q_id) as q_id, coalesce(k.row_pos, g2.chunk_id) as chunk_id, 0.65 * case when s is null then 0 else 1 / (1 + greatest(s, 0)) end + 0.35 * coalesce(g, 0) as score, k.rank as v_rank, g_rank from k full join g2 on k.q_id = g2.q_id and k.row_pos = g2.chunk_id),
r as (select *, row_number() over (partition by q_id order by round(score, 12) desc, v_rank nulls last, g_rank nulls last) as rank from b qualify rank <= 10)
select q_id, chunk_id, round(score, 6) as score, rank::bigint as rank, v_rank is not null as from_vector, g_rank is not null as from_graph from r""")
def hybrid_fuse(spark, sf):
    """Score normalisation, full outer union, weights, stable order."""
    out = retrieval.fuse(*_fuse_inputs(spark, sf))
    return out.select("q_id", "chunk_id", F.round("score", 6).alias("score"), long_(F.col("rank")).alias("rank"), "from_vector", "from_graph")


ENTITY = "[A-Z][a-z]{7,}"
ENTITIES = f"unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{ENTITY}')))"


def entities():
    """The capitalised words of eight letters or more of a whole text, each once."""
    return F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ENTITY), F.lit(0))))


@query(rf"""with terms as (select item_id as q_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_\-]{{2,}}'), lambda x: lower(x)))) as term from benchmark),
m as (select doc_id, {ENTITIES} as entity_text from documents),
names as (select distinct entity_text from m),
hit as (select distinct q_id, entity_text from terms join names on contains(lower(entity_text), term)),
s as (select q_id, doc_id, count(distinct m.entity_text)::double as score from hit join m using (entity_text) group by 1, 2),
r as (select s.*, row_number() over (partition by q_id order by score desc, source, doc_id) as rank from s join documents using (doc_id) where coalesce(text, '') <> '' qualify rank <= 5)
select q_id, doc_id as chunk_id, score, rank::bigint as rank from r""")
def graph_term_match(spark, sf):
    """Questions against entity texts by contained terms, distinct entities as score."""
    docs = t(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_num"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"), F.col("text").alias("text_clean"))
    mentions = docs.select(F.col("doc_id").alias("chunk_id"), entities().alias("entity_text")).withColumn("entity_id", T.sha256(F.col("entity_text")))
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    out = retrieval.entity_search(asked, mentions, chunks)
    return out.select("q_id", "chunk_id", "score", long_(F.col("rank")).alias("rank"))


WORDS = r"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""with {KNN_SQL}, c as (select q_id, rank, row_pos, {WORDS.format(c='a.text')} as qw, {WORDS.format(c='b.text')} as tw from k join documents a on a.doc_id = q_id join documents b on b.doc_id = row_pos where trim(b.text) <> ''),
s as (select *, case when len(qw) > 0 then len(list_intersect(qw, tw)) / len(qw) else 0 end as s from c),
r as (select *, row_number() over (partition by q_id order by s desc, rank) as new_rank from s qualify new_rank <= 5)
select q_id, row_pos, new_rank::bigint as rank from r""")
def rerank_overlap(spark, sf):
    """Candidates reordered by word overlap with the question."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    rows = _knn(spark, sf).join(docs.select(F.col("doc_id").alias("q_id"), F.col("text").alias("question")), "q_id").join(docs.withColumnRenamed("doc_id", "row_pos"), "row_pos").where("trim(text) <> ''")
    out = retrieval.rerank(rows, retrieval.overlap_score(F.col("question"), F.col("text")))
    return out.select("q_id", "row_pos", long_(F.col("rank")).alias("rank"))


CLEAN_LINE = r"""case when regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '^\[(FORMULA|FIGURE TEXT):.*\]$') then trim(x, ' ' || chr(9) || chr(13)) when regexp_matches(x, '^\s*\|.+\|') then rtrim(regexp_replace(x, '[ \t\f\v]+', ' ', 'g'))
 when regexp_matches(x, '^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$') then null else rtrim(regexp_replace(x, '[ \t\f\v]+', ' ', 'g')) end"""
CLEANED = (
    r"""select doc_id, text, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'), chr(10)), lambda x: """
    + CLEAN_LINE
    + r"""), lambda y: y is not null), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as c from documents"""
)


@query(f"with k as ({CLEANED}) select doc_id, length(c)::bigint as n, sha256(c) as sha from k")
def clean_text(spark, sf):
    """Page text cleaned by line."""
    rows = t(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("c"))
    return rows.select("doc_id", long_(F.length("c")).alias("n"), T.sha256(F.col("c")).alias("sha"))


@query(rf"""with k as ({CLEANED}), r as (select *, regexp_replace(coalesce(text, ''), '(?s)\[(?:FORMULA|FIGURE TEXT):.*?\]', '', 'g') as o from k),
f as (select *, case when o = '' then 0 else length(regexp_replace(o, '[^\p{{C}}\p{{Z}}]|[ \n\t]', '', 'g')) / length(o) end as ratio from r)
select doc_id, array_to_string(list_filter([case when c = '' then 'EMPTY_AFTER_CLEAN' end, case when length(c) between 1 and 29 then 'TOO_SHORT' end, case when ratio > 0.1 then 'HIGH_NONPRINTABLE_RATIO' end], lambda x: x is not null), ',') as reasons, round(ratio, 4) as ratio from f""")
def garbage_flags(spark, sf):
    """Reasons and the share of characters that do not print."""
    rows = t(spark, sf, "documents")
    # cleaned once: the flags look at it several times
    f = F.element_at(F.transform(F.array(T.clean(F.col("text"))), lambda c: T.garbage_flags(F.col("text"), c)), 1)
    return rows.select("doc_id", f.alias("f")).select("doc_id", F.array_join("f.reasons", ",").alias("reasons"), F.col("f.nonprintable_ratio").alias("ratio"))


@query("select doc_id, greatest(1, length(text) // 4)::bigint as tokens from documents")
def token_count(spark, sf):
    """H1: tokens by length."""
    return t(spark, sf, "documents").select("doc_id", long_(T.token_count(F.col("text"))).alias("tokens"))


CLASS = r"""case when l = '' then 'paragraph' when regexp_matches(l, '^\s*\[(\d{1,3})\]\s+\S') then 'citation' when regexp_matches(l, '(?s)^\[FORMULA:.*\]$') then 'formula' when regexp_matches(l, '^\s*\|.+\|') then 'md_table'
when regexp_matches(l, '(?i)^\s*(?:Fig\.?|Figure|Table|Tab\.?)\s*[\dIVX]+') then 'figure' when regexp_matches(l, '^\s*\d{1,2}\.\s+\S') then 'numbered_item' when regexp_matches(l, '^\s*(?:[IVX]{1,6}\.|[A-Z]\.|\d{1,2}\.)\s+\S') then 'main_section'
when length(l) between 4 and 60 and not regexp_matches(l, '[.,:]$') and not contains(l, ':') and regexp_matches(l, '^\p{Lu}') and len(regexp_split_to_array(l, '\s+')) between 2 and 6
 and not regexp_matches(l, '^(?:Run|Collect|Identify|Develop|Finalize|Interpret|Refine|Create|Build|Use|Presentation|Written|Functional|Live|Working|The |This |A |An |In |For |By |To |At |When |Each |All )')
 and not (len(regexp_split_to_array(l, '\s+')) = 2 and regexp_matches(l, '^\p{Lu}\S*\s+\p{Lu}') and not regexp_matches(l, '[-&/]')) then 'subsection' else 'paragraph' end"""
LINES = "select doc_id, source, pos, trim(l) as l from (select doc_id, source, unnest(string_split(text, chr(10))) as l, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos from documents)"


def document():
    """A document of at most 50 pages: a source's texts whose ids lie in one range of 50."""
    return F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50).cast("string"))


def _lines(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return rows.select("doc_id", "source", long_(F.col("p") + 1).alias("pos"), F.trim("l").alias("l"))


@query(f"with x as ({LINES}) select doc_id, pos, {CLASS} as kind from x")
def block_classify(spark, sf):
    """H3, H4: every line of every page by class."""
    return _lines(spark, sf).select("doc_id", "pos", T.block_class(F.col("l")).alias("kind"))


HEADED = LINES.replace("string_split(text, chr(10))", "string_split(case doc_id % 6 when 0 then 'R E F E R E N C E S' || chr(10) when 1 then 'IV. References' || chr(10) when 2 then '  bibliography of works' || chr(10) when 3 then 'W O R K S cited' || chr(10) when 4 then 'works  cited' || chr(10) else '' end || text, chr(10))")


@query(rf"""with x as ({HEADED}), s as (select *, regexp_replace(l, '\s+', ' ', 'g') as v, upper(regexp_replace(l, '\s', '', 'g')) as w from x)
select doc_id, pos from s where v <> '' and (regexp_matches(v, '(?i)REFER[EN]+CES?|BIBLIOGRAPH') or regexp_matches(w, 'REFER[EN]+CES?|BIBLIOGRAPH') or regexp_matches(v, '(?i)^\s*(?:[IVX]{{1,6}}\.\s+)?(?:WORKS\s+CITED|REFERNCES?)\s*$'))""")
def reference_lines(spark, sf):
    """H5: lines that open a reference section, also when their letters are spaced; five of six documents get a first line of such a kind."""
    heads = ("R E F E R E N C E S", "IV. References", "  bibliography of works", "W O R K S cited", "works  cited")
    head = F.lit("")
    for k, line in enumerate(heads):
        head = F.when(F.col("doc_id") % 6 == k, line + "\n").otherwise(head)
    rows = t(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split(F.concat(head, "text"), "\n")).alias("p", "l"))
    return rows.where(T.is_reference_section(F.trim("l"))).select("doc_id", long_(F.col("p") + 1).alias("pos"))


@query(f"""with x as ({LINES}), y as (select *, {CLASS} as kind from x),
m as (select *, kind in ('main_section', 'numbered_item') as is_main from y),
c as (select *, last_value(case when is_main then l end ignore nulls) over (partition by source, doc_id // 50 order by doc_id, pos) as main, sum(is_main::int) over (partition by source, doc_id // 50 order by doc_id, pos) as main_no from m)
select doc_id, pos, coalesce(main, '') as main, coalesce(last_value(case when kind = 'subsection' then l end ignore nulls) over (partition by source, doc_id // 50, main_no order by doc_id, pos), '') as sub from c""")
def section_carry(spark, sf):
    """H6: main and sub section of every line, carried over the lines of a document (a source's texts of 50 consecutive ids)."""
    rows = _lines(spark, sf).withColumn("kind", T.block_class(F.col("l")))
    blocks = rows.select(document().alias("doc_id"), F.struct("doc_id", "pos").alias("page_num"), F.lit(1).alias("pos"), "kind", F.col("l").alias("first_line"))
    out = chunking.with_sections(blocks)
    return out.select("page_num.doc_id", "page_num.pos", "main", "sub")


@query("select doc_id, sha256(concat_ws('|', source, doc_id::varchar, '0', length(text)::varchar, sha256(text))) as chunk_id, sha256(concat_ws('|', sha256('e1'), sha256(text))) as cache_key, 'doc::' || lang || '::' || source as node_id from documents")
def identities(spark, sf):
    """I2, M6 and the document node id: content-addressed keys."""
    d = t(spark, sf, "documents")
    return d.select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id"), F.lit(0), F.length("text"), F.col("text")).alias("chunk_id"), T.cache_key(F.lit("e1"), F.col("text")).alias("cache_key"), T.document_node_id(F.col("lang"), F.col("source")).alias("node_id"))


@query("select doc_id, sha256('Document: ' || source || chr(10) || 'Section: ' || lang || case when doc_id % 2 = 0 then ' > ' || 'even' else '' end || chr(10) || chr(10) || text) as sha from documents")
def embedding_text(spark, sf):
    """Document and section lines before the text."""
    path = F.array("lang", F.when(F.col("doc_id") % 2 == 0, "even").otherwise(""))
    return t(spark, sf, "documents").select("doc_id", T.sha256(T.embedding_text(F.col("source"), path, F.col("text"))).alias("sha"))


@query("""with recursive x as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents), d as (select doc_id, i, greatest(1, length(l) // 4) as tok from x),
w as (select doc_id, i, 1 as pack, tok as n, tok >= 350 as closed from d where i = 1
 union all select d.doc_id, d.i, case when w.closed or w.n + d.tok > 450 then w.pack + 1 else w.pack end, case when w.closed or w.n + d.tok > 450 then d.tok else w.n + d.tok end,
 case when w.closed or w.n + d.tok > 450 then d.tok else w.n + d.tok end >= 350 from w join d on d.doc_id = w.doc_id and d.i = w.i + 1)
select doc_id, i as pos, pack::bigint as pack from w""")
def pack_paragraphs(spark, sf):
    """Greedy packs of each document's lines."""
    items = F.transform(F.split("text", "\n"), lambda l, i: F.struct(i.alias("i"), T.token_count(l).alias("tok")))
    runs = t(spark, sf, "documents").select("doc_id", items.alias("items"))
    packs = runs.select("doc_id", F.posexplode(chunking.pack(F.col("items"))).alias("pack", "idx"))
    return packs.select("doc_id", F.explode("idx").alias("i"), "pack").select("doc_id", long_(F.col("i") + 1).alias("pos"), long_(F.col("pack") + 1).alias("pack"))


@query(r"""with recursive s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as x, unnest(generate_series(1, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) as i from documents where length(text) // 4 > 550),
d as (select doc_id, i, greatest(1, length(x) // 4) as tok from s),
w as (select doc_id, i, 1 as part, tok as n from d where i = 1
 union all select d.doc_id, d.i, case when w.n + d.tok > 550 then w.part + 1 else w.part end, case when w.n + d.tok > 550 then d.tok else w.n + d.tok end from w join d on d.doc_id = w.doc_id and d.i = w.i + 1),
p as (select w.doc_id, part, string_agg(x, ' ' order by w.i) as c from w join s on s.doc_id = w.doc_id and s.i = w.i group by 1, 2)
select doc_id, part::bigint as part, sha256(c) as sha from p union all select doc_id, 1::bigint, sha256(text) from documents where length(text) // 4 <= 550""")
def sentence_split(spark, sf):
    """Oversize texts cut at sentence ends and repacked."""
    rows = t(spark, sf, "documents").select("doc_id", F.posexplode(chunking.sentence_parts(F.col("text"), F.col("text"))).alias("p", "x"))
    return rows.select("doc_id", long_(F.col("p") + 1).alias("part"), T.sha256(F.col("x.clean")).alias("sha"))


BLOCKS = "select l_orderkey as page, ((l_linenumber * 100000 + l_partkey) * 50 + l_quantity)::int as pos, (l_partkey % 600)::double as x0, (l_suppkey % 7 * 9)::double as y0, (l_partkey % 600 + l_quantity * 9)::double as x1, l_returnflag || l_linestatus as text, l_linenumber % 5 = 0 as img from lineitem"


def _blocks(spark, sf):
    x = t(spark, sf, "lineitem")
    x0 = (F.col("l_partkey") % 600).cast("double")
    return x.select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_num"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 50 + F.col("l_quantity")).cast("int").alias("pos"), F.when(F.col("l_linenumber") % 5 == 0, "image").otherwise("text").alias("type"), x0.alias("x0"), (F.col("l_suppkey") % 7 * 9).cast("double").alias("y0"), (x0 + F.col("l_quantity") * 9).alias("x1"), F.lit(0.0).alias("y1"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").alias("font_size"), (F.col("l_linenumber") == 1).alias("is_bold"))


COLS = f"""b as ({BLOCKS}), c as (select page, count(*) filter (not img and x0 < 180) as l, count(*) filter (not img and x0 > 120) as r, count(*) filter (not img and x0 > 360) as f from b group by 1),
n as (select page, case when l > 1 and r > 1 then case when f > 1 then 3 else 2 end else 1 end as n_cols from c)"""
ORDER = f"""{COLS}, o as (select b.*, n_cols, case when x1 - x0 > 360 then 0 else least(floor(x0 / (600.0 / n_cols))::int, n_cols - 1) end as col from b join n using (page)),
r as (select *, row_number() over (partition by page order by col, y0, x0, pos) as rank from o)"""


@query(f"with {COLS} select page, n_cols::bigint as n_cols from n")
def column_detect(spark, sf):
    """Number of text columns of each page."""
    return layout.column_count(_blocks(spark, sf), F.lit(600.0)).select(F.col("page_num").alias("page"), long_(F.col("n_cols")).alias("n_cols"))


@query(f"with {ORDER} select page, pos, col, rank::bigint as rank from r")
def reading_order(spark, sf):
    """Blocks by column, then from top to bottom."""
    return layout.reading_order(_blocks(spark, sf), F.lit(600.0)).select(F.col("page_num").alias("page"), "pos", "col", long_(F.col("rank")).alias("rank"))


@query(f"""with recursive {ORDER}, w as (select page, rank, pos, x0, text, img, y0 as anchor, 1 as line from r where rank = 1
 union all select r.page, r.rank, r.pos, r.x0, r.text, r.img, case when not r.img and not w.img and abs(r.y0 - w.anchor) <= 8 then w.anchor else r.y0 end, case when not r.img and not w.img and abs(r.y0 - w.anchor) <= 8 then w.line else w.line + 1 end from w join r on r.page = w.page and r.rank = w.rank + 1)
select page, line::bigint as line, count(*)::bigint as n, string_agg(text, ' ' order by x0, rank) as text from w group by 1, 2""")
def merge_same_line(spark, sf):
    """Runs of blocks on one line, joined from left to right."""
    ordered = layout.reading_order(_blocks(spark, sf), F.lit(600.0))
    out = layout.merge_lines(ordered)
    return out.select(F.col("page_num").alias("page"), long_(F.col("line") + 1).alias("line"), long_(F.size(F.split("text", " "))).alias("n"), "text")


@query(f"with b as ({BLOCKS}), s as (select page, list_sort(list(l_quantity)) as v from (select l_orderkey as page, l_quantity from lineitem where l_linenumber % 5 <> 0) group by 1) select p.page, coalesce(v[len(v) // 2 + 1], 10.0) as body_font from (select distinct page from b) p left join s using (page)")
def page_font(spark, sf):
    """Upper-middle font size of each page."""
    return layout.body_font(_blocks(spark, sf)).select(F.col("page_num").alias("page"), "body_font")


@query(r"""select r_regionkey::bigint as region, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as md from region join nation on n_regionkey = r_regionkey group by 1""")
def table_markdown(spark, sf):
    """Rows as a markdown table."""
    rows = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select(long_(F.col("region")).alias("region"), layout.table_markdown(cells).alias("md"))


@query(r"""with x as (""" + LINES + r""") select doc_id, pos, l = '' or regexp_matches(l, '^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$') or (length(l) <= 6 and regexp_matches(replace(l, ' ', ''), '^[0-9]+$')) as noise,
 length(l) < 120 and regexp_matches(l, '(?i)^\s*(?:Fig\.?|Figure|Table|Tab\.?|Chart|Diagram|Exhibit|Image|Photo|Plate)\s*[\dIVX]+') as caption, length(l) >= 3 and (regexp_matches(l, '\\[a-zA-Z]+\{|\\frac|\\sum|\\int|\$.*?\$')
 or length(regexp_replace(l, '[^∑∏∫∂∇∆αβγδεζηθλμνξπρστφχψωΩΓΔΘΛΞΠΣΦΨ±×÷√∞≈≠≤≥∈∉⊂⊃∪∩]', '', 'g')) / greatest(length(l), 1) > 0.08) as formula from x""")
def line_kinds(spark, sf):
    """Page noise, captions and formulas among all lines."""
    c = F.col("l")
    return _lines(spark, sf).select("doc_id", "pos", layout.is_noise(c).alias("noise"), layout.is_caption(c).alias("caption"), layout.is_formula(c).alias("formula"))


@query("""with x as (select doc_id, sha256(concat_ws('|', sha256('e1'), sha256(trim(text)))) as k from documents where trim(text) <> ''), s as (select distinct k from x where doc_id % 2 = 0),
c as (select doc_id % 3 = 0 as already, s.k is not null as hit from x left join s using (k))
select count(*)::bigint as total, count(*) filter (already)::bigint as already, count(*) filter (not already and hit)::bigint as hits, count(*) filter (not already and not hit)::bigint as to_embed, round((count(*) filter (already or hit)) / count(*) * 100, 2) as avoidance_pct from c""")
def cache_avoidance(spark, sf):
    """Chunks done before, cached by content, and left to embed."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("").alias("embedding_text"), F.trim("text").alias("text_clean"), F.lit(True).alias("index_this"), (F.col("doc_id") % 6).alias("m"))
    keyed = embedding.with_cache_key(embedding.eligible(d), "e1")
    store = keyed.where("m % 2 = 0").select("cache_key", F.lit(1).alias("dim"), F.array(F.lit(1.0).cast("float")).alias("vec")).distinct()
    done = d.where("m % 3 = 0").select("doc_id", "chunk_id", F.lit("e1").alias("embedder_id"))
    return embedding.avoidance(d, done, store, "e1", 1)


@query("""with x as (select doc_id, sha256(concat_ws('|', sha256('e1'), sha256(trim(text)))) as k from documents where trim(text) <> ''), s as (select distinct k from x where doc_id % 2 = 0)
select doc_id::varchar as chunk_id, k as cache_key, s.k is not null as hit from x left join s using (k) where doc_id % 3 <> 0""")
def embed_todo(spark, sf):
    """M6, M7: chunks that an embedder has not done yet, and whether their vector is in the store."""
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("").alias("embedding_text"), F.trim("text").alias("text_clean"), F.lit(True).alias("index_this"), (F.col("doc_id") % 6).alias("m"))
    keyed = embedding.with_cache_key(embedding.eligible(d), "e1")
    store = keyed.where("m % 2 = 0").select("cache_key", F.lit(1).alias("dim"), F.array(F.lit(1.0).cast("float")).alias("vec")).distinct()
    done = d.where("m % 3 = 0").select("doc_id", "chunk_id", F.lit("e1").alias("embedder_id"))
    rows = embedding.fetched(embedding.todo(keyed, done, "e1"), store, 1)
    return rows.select("chunk_id", "cache_key", F.col("vector").isNotNull().alias("hit"))


@query("select vec_id, row_number() over (order by label::varchar, vec_id % 9, vec_id::varchar)::bigint - 1 as row_pos from embeddings")
def index_positions(spark, sf):
    """Dense positions of all vectors in document order."""
    e = t(spark, sf, "embeddings").select(F.col("label").cast("string").alias("doc_id"), (F.col("vec_id") % 9).cast("int").alias("page_num"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("e1").alias("embedder_id"), "vec_id")
    return embedding.index_rows(e, "e1", 64).select("vec_id", long_(F.col("row_pos")).alias("row_pos"))


@query("select vec_id, (len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: isnan(x) or isinf(x)), true)) as ok, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as norm2 from embeddings")
def vector_validation(spark, sf):
    """Length and finite values, and the squared norm by the inner product."""
    return t(spark, sf, "embeddings").select("vec_id", embedding.valid("embedding", 64).alias("ok"), F.round(retrieval.inner_product(F.col("embedding"), F.col("embedding")), 4).alias("norm2"))


def _chunks(spark, sf):
    d = t(spark, sf, "documents")
    return d.select(F.col("lang").alias("collection_id"), F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("int").alias("page_num"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.col("text").alias("text_clean"), F.concat("source", F.lit(".pdf")).alias("file_name"), F.lit("pdf").alias("file_type"))


@query("select lang as collection_id, doc_id::varchar as from_id, lead(doc_id::varchar) over (partition by lang, source order by doc_id) as to_id from documents qualify to_id is not null")
def next_edges(spark, sf):
    """Consecutive chunks of a document."""
    return graph.next_edges(_chunks(spark, sf)).select("collection_id", "from_id", "to_id")


MENTIONS = f"select lang as collection_id, source as doc_id, doc_id::varchar as chunk_id, {ENTITIES} as entity_text from documents where true"


def _graph(spark, sf):
    chunks = _chunks(spark, sf)
    m = chunks.select("collection_id", "doc_id", "chunk_id", F.col("text_clean").alias("text")).select("collection_id", "doc_id", "chunk_id", entities().alias("w"))
    found = m.select("collection_id", "doc_id", "chunk_id", T.sha256(F.col("w")).alias("entity_id"), F.col("w").alias("entity_text"), F.lit("Word").alias("entity_type"))
    none = chunks.sparkSession.createDataFrame([], "collection_id string, relation_type string, source_entity_id string, target_entity_id string")
    return chunks, *graph.build(chunks, lambda _: found, lambda _: none)


@query(f"select collection_id, doc_id, chunk_id, sha256(entity_text) as entity_id, entity_text, 'Word' as entity_type from ({MENTIONS})")
def mentions_distinct(spark, sf):
    """Mentions read back from nodes and edges."""
    chunks, nodes, edges, _, _ = _graph(spark, sf)
    return graph.mentions(nodes, edges, chunks).select("collection_id", "doc_id", "chunk_id", "entity_id", "entity_text", "entity_type")


@query(f"""with m as ({MENTIONS} and lang = 'en'), c as (select * from documents where lang = 'en')
select 'en' as collection_id, (select count(distinct source) from c)::bigint as doc_nodes, 0::bigint as section_nodes, (select count(*) from c)::bigint as chunk_nodes, 0::bigint as entity_nodes, (select count(*) from c)::bigint as has_chunk_edges, 0::bigint as has_section_edges,
 (select count(*) - count(distinct source) from c)::bigint as next_edges, (select count(*) from m)::bigint as mentions_edges, (select 2 * count(*) - count(distinct source) from c)::bigint as relates_to_edges""")
def graph_stats(spark, sf):
    """Counters of one collection's graph."""
    d, n, e, _, _ = _graph(spark, sf)
    en = d.where("collection_id = 'en'").select(F.col("chunk_id").alias("to_id"))
    # entities are shared between collections here: their edges count by the chunk they lead to
    e = e.where("edge_type <> 'FROM_CHUNK'").unionByName(e.where("edge_type = 'FROM_CHUNK'").join(en, "to_id", "left_semi").select(*e.columns))
    n = n.where("node_type in ('Document', 'Chunk')")
    return graph.stats(n, e, "en")


@query(r"select doc_id, array_to_string(list_distinct(regexp_extract_all(a, '\[(\d{1,3})\]', 1)), ',') as cited from (select doc_id, 'x [' || (doc_id % 5 + 1) || '][' || (doc_id % 3) || '] y [' || (doc_id % 5 + 1) || '] [1234]' as a from documents) where doc_id % 5 + 1 = doc_id % 3 union all select doc_id, (doc_id % 5 + 1) || ',' || (doc_id % 3) from documents where doc_id % 5 + 1 <> doc_id % 3")
def citation_extract(spark, sf):
    """Cited numbers in order of their first appearance."""
    d = t(spark, sf, "documents")
    n = lambda x: x.cast("string")
    a = F.concat(F.lit("x ["), n(F.col("doc_id") % 5 + 1), F.lit("]["), n(F.col("doc_id") % 3), F.lit("] y ["), n(F.col("doc_id") % 5 + 1), F.lit("] [1234]"))
    return d.select("doc_id", F.array_join(prompts.citations(a), ",").alias("cited"))


@query(f"""with {KNN_SQL}, b as (select q_id, rank, trim('[SOURCE ' || rank || ' | ' || source || ' | page=' || doc_id || ', chars=0-' || length(text) || ' | section=' || lang || case when doc_id % 2 = 0 then ' | [TABLE — interpret as structured data with rows and columns]' else '' end || ']' || chr(10) || text, ' ' || chr(10)) as x
 from (select q_id, row_number() over (partition by q_id order by rank) as rank, row_pos from k join documents on doc_id = row_pos where rank <= 3) j join documents on doc_id = row_pos)
select q_id, sha256(string_agg(x, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as sha from b group by 1""")
def context_assembly(spark, sf):
    """Source blocks of the context, joined in rank order."""
    d = t(spark, sf, "documents")
    rows = retrieval.context(_knn(spark, sf)).join(d, F.col("doc_id") == F.col("row_pos"))
    rows = rows.select("q_id", "rank", "score", F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("page_num"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.array("lang").alias("section_path"), F.lit("").alias("section_context"), F.when(F.col("doc_id") % 2 == 0, "table").otherwise("semantic_text").alias("chunk_type"), "text")
    return prompts.assemble(prompts.with_blocks(rows)).select("q_id", T.sha256(F.col("context")).alias("sha"))


@query("""with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations qualify back <= 20)
select conv_id, string_agg(case role when 'user' then 'User: ' else 'Assistant: ' end || trim(text, ' ' || chr(10)), chr(10) order by turn) as history from r where role in ('user', 'assistant') and trim(text, ' ' || chr(10)) <> '' group by 1""")
def history_last_n(spark, sf):
    """The last 20 entries, user and assistant turns only."""
    return prompts.history_block(t(spark, sf, "conversations"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def latest_log(spark, sf):
    """A1: the last log row of each query."""
    log = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("query"), "event_id", "event_type", F.col("event_id").alias("seq"), F.col("user_id"))
    return evaluation.latest_log(log).select("user_id", "event_id", "event_type")


@query("select source as collection_id, arg_max(lang, [doc_id % 5, doc_id]) as embedder_id from documents group by 1")
def latest_embedder(spark, sf):
    """The embedder made last, the later one on ties."""
    d = t(spark, sf, "documents").select(F.col("source").alias("collection_id"), F.col("doc_id").alias("doc_pos"), F.array(F.struct(F.col("lang").alias("embedder_id"), F.lit(1).alias("dim"), (F.col("doc_id") % 5).cast("string").alias("created_at"))).alias("embeddings"))
    return retrieval.latest_embedder(d)


EVAL = """select doc_id, ['f' || (doc_id % 7), 'f' || (doc_id % 5), 'f' || (doc_id % 3)] as found, case when doc_id % 4 = 0 then [] else ['f' || (doc_id % 4), 'f' || (doc_id % 6)] end as gold, case when doc_id % 9 = 0 then [] else ['f' || (doc_id % 6), 'f' || (doc_id % 8)] end as cited,
 doc_id % 3 <> 0 as answerable, case when doc_id % 5 < 2 then ' Not found  in documents.' else 'x' end as answer from documents"""


def _eval(spark, sf):
    n = lambda k: F.concat(F.lit("f"), (F.col("doc_id") % k).cast("string"))
    none = F.array().cast("array<string>")
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.array(n(7), n(5), n(3)).alias("found"), F.when(F.col("doc_id") % 4 == 0, none).otherwise(F.array(n(4), n(6))).alias("gold"), F.when(F.col("doc_id") % 9 == 0, none).otherwise(F.array(n(6), n(8))).alias("cited"), (F.col("doc_id") % 3 != 0).alias("answerable"), F.when(F.col("doc_id") % 5 < 2, " Not found  in documents.").otherwise("x").alias("answer"))


METRICS = f"""e as ({EVAL}), m as (select doc_id, case when len(gold) > 0 then round(len(list_intersect(list_distinct(gold), found)) / len(list_distinct(gold)), 6) end as recall,
 case when len(cited) = 0 then 0 when len(gold) > 0 then round(len(list_intersect(list_distinct(cited), gold)) / len(list_distinct(cited)), 6) end as precision,
 ((answer <> 'x') = (not answerable))::int::double as abstention, case when not answerable then case when answer <> 'x' then 0 else 1 end when len(cited) = 0 then 1 when len(gold) = 0 then 0 when len(list_intersect(list_distinct(cited), gold)) = len(list_distinct(cited)) then 0 else 1 end::double as ucr,
 case when len(found) > 0 then round(len(list_filter(found, lambda x: list_contains(cited, x))) / len(found), 6) else 0 end as contribution from e)"""


def _metrics(spark, sf):
    c = F.col
    return _eval(spark, sf).select(
        "doc_id", F.round(evaluation.recall(c("found"), c("gold")), 6).alias("recall"), F.round(evaluation.precision(c("cited"), c("gold")), 6).alias("precision"), evaluation.abstention(c("answer"), c("answerable")).alias("abstention"),
        evaluation.unsupported(c("answer"), c("answerable"), c("cited"), c("gold")).alias("ucr"), F.round(evaluation.graph_contribution(c("found"), c("cited")), 6).alias("contribution"),
    )


@query(f"with {METRICS} select * from m")
def metrics_per_query(spark, sf):
    """A3, A5, A6, A7, A10 on every row."""
    return _metrics(spark, sf)


@query(f"with {METRICS} select 'recall' as name, round(avg(recall), 6) as value, count(recall)::bigint as count from m union all select 'multihop_recall', round(avg(recall) filter (doc_id % 2 = 0), 6), count(recall) filter (doc_id % 2 = 0) from m union all select 'precision', round(avg(precision), 6), count(precision) from m union all select 'abstention', round(avg(abstention), 6), count(abstention) from m union all select 'ucr', round(avg(ucr), 6), count(ucr) from m union all select 'contribution', round(avg(contribution), 6), count(contribution) from m")
def metric_summary(spark, sf):
    """Means and counts of the metrics; multi-hop rows are the even ones."""
    rows = _metrics(spark, sf).withColumn("multihop_recall", F.when(F.col("doc_id") % 2 == 0, F.col("recall"))).withColumn("query", F.col("doc_id")).drop("doc_id")
    return evaluation.summary(rows).select("name", F.round("value", 6).alias("value"), F.col("count"))


@query(r"""with p as (select doc_id, d.text as a, b.text as g from documents d join benchmark b on d.doc_id % (select count(*) from benchmark) = b.item_id),
w as (select doc_id, unnest(regexp_extract_all(lower(a), '[\p{L}\p{N}_]+')) as w, 0 as s from p union all select doc_id, unnest(regexp_extract_all(lower(g), '[\p{L}\p{N}_]+')), 1 from p),
c as (select doc_id, w, count(*) filter (s = 0) as a, count(*) filter (s = 1) as b from w group by 1, 2), s as (select doc_id, sum(least(a, b)) as common, sum(a) as a, sum(b) as b from c group by 1)
select p.doc_id, round(case when coalesce(s.a, 0) = 0 and coalesce(s.b, 0) = 0 then 1 when coalesce(s.a, 0) = 0 or coalesce(s.b, 0) = 0 or common = 0 then 0 else 2 * (common / s.a) * (common / s.b) / (common / s.a + common / s.b) end, 6) as f1, (p.a = p.g)::int::double as em from p left join s on s.doc_id = p.doc_id""")
def answer_f1(spark, sf):
    """Token F1 and exact match of texts against gold answers; each text has one of the items."""
    d, b = t(spark, sf, "documents"), t(spark, sf, "benchmark")
    rows = d.select("doc_id", F.col("text").alias("a"), (F.col("doc_id") % b.count()).alias("item_id")).join(b.select("item_id", F.col("text").alias("g")), "item_id").drop("item_id")
    f1 = evaluation.token_f1(rows, "doc_id", "a", "g")
    return f1.join(rows.select("doc_id", evaluation.exact_match(F.col("a"), F.col("g")).alias("em")), "doc_id").select("doc_id", F.round("f1", 6).alias("f1"), "em")


@query("""with a as (select event_type as name, round(avg(value), 4) as v from events where event_id % 2 = 0 group by 1), b as (select event_type || case when event_type < 'd' then '2' else '' end as name, round(avg(value), 4) as v from events where event_id % 2 = 1 group by 1)
select coalesce(a.name, b.name) as name, round(a.v, 4) as vector, round(b.v, 4) as hybrid, round(b.v - a.v, 4) as delta, round(case when a.v <> 0 then (b.v - a.v) / a.v * 100 end, 3) as pct_delta, case when a.v is null or b.v is null then 'n/a' when b.v > a.v then 'improved' when b.v < a.v then 'declined' else 'unchanged' end as trend from a full join b on a.name = b.name""")
def run_compare(spark, sf):
    """Two runs' metrics side by side."""
    e = t(spark, sf, "events")
    mean = lambda df, name: df.groupBy(name.alias("name")).agg(F.round(F.avg("value"), 4).alias("value"))
    a = mean(e.where("event_id % 2 = 0"), F.col("event_type"))
    b = mean(e.where("event_id % 2 = 1"), F.concat("event_type", F.when(F.col("event_type") < "d", "2").otherwise("")))
    return evaluation.compare(a, b).select("name", "vector", "hybrid", F.round("delta", 4).alias("delta"), F.round("pct_delta", 3).alias("pct_delta"), "trend")


@query("""select doc_id::varchar as doc_id, source || case when doc_id % 3 = 0 then '-new' else '' end as file_name, case when doc_id % 3 = 0 then 'again' else 'ingested' end as status, lang as kept from documents where doc_id % 5 > 0 union all select doc_id::varchar, source || '-new', 'again', null from documents where doc_id % 5 = 0""")
def manifest_upsert(spark, sf):
    """K6: new values over old ones, other columns kept, new documents added."""
    d = t(spark, sf, "documents")
    old = d.where("doc_id % 5 > 0").select(F.lit("c").alias("collection_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("file_name"), F.lit("ingested").alias("status"), F.col("lang").alias("kept"))
    new = d.where("doc_id % 3 = 0 or doc_id % 5 = 0").select(F.lit("c").alias("collection_id"), F.col("doc_id").cast("string").alias("doc_id"), F.concat("source", F.lit("-new")).alias("file_name"), F.lit("again").alias("status"))
    return registry.upsert_docs(old, new).select("doc_id", "file_name", "status", "kept")


@query(f"""with m as (select *, sha256(entity_text) as id from ({MENTIONS})), left_ as (select distinct id from m where collection_id <> 'en')
select (select count(*) from documents where lang <> 'en')::bigint as chunks, (select count(*) from left_)::bigint as entities, (select count(*) from m where collection_id <> 'en')::bigint as from_chunk""")
def purge_collection(spark, sf):
    """A collection's nodes and edges go, and entities that no chunk mentions."""
    _, nodes, edges, _, _ = _graph(spark, sf)
    nodes = graph.upsert_nodes(nodes.limit(0), nodes).persist()
    edges = graph.upsert_edges(edges.limit(0), edges, nodes).persist()
    n, e = graph.purge(nodes, edges, "en")
    return n.agg(F.count_if(F.col("node_type") == "Chunk").alias("chunks"), F.count_if(F.col("node_type") == "Word").alias("entities")).join(e.agg(F.count_if(F.col("edge_type") == "FROM_CHUNK").alias("from_chunk")))


@query("""select user_id as job_id, case when arg_max(event_type, event_id) = 'purchase' then 'failed' else 'running' end as status, 'CHUNK' as stage, 'Chunking' as label, arg_max(event_type, event_id) filter (event_type = 'purchase') as error from events group by 1""")
def job_status(spark, sf):
    """The state of each job from its stage events."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.lit("CHUNK").alias("stage"), F.when(F.col("event_type") == "purchase", "failed").otherwise("running").alias("status"), F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("reason"))
    return registry.job_status(e)


@query("""select user_id as collection_id, 'e' as embedder_id, round(arg_max(case when event_id % 50 > 0 then (event_id % 20) / (event_id % 50) * 100 else 0 end, event_id), 2) as avoidance_pct, round(arg_max(case when event_id % 30 > 0 then value / (event_id % 30) * (event_id % 20) else 0 end, event_id), 4) as time_saved_s from events group by 1""")
def embedding_panel(spark, sf):
    """Avoided share and time saved from each collection's last bench row."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("collection_id"), F.lit("e").alias("embedder_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("chunks_total"), (F.col("event_id") % 20).alias("chunks_skipped"), (F.col("event_id") % 30).alias("chunks_embedded"), F.col("value").alias("embed_s"))
    return registry.embedding_panel(e)


@query(r"""select page_id, case when lower(n) like '%.pdf' then 'pdf' when lower(n) like '%.docx' then 'docx' else 'unknown' end as file_type, substr(regexp_replace(regexp_replace(trim(n), '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '\s+', '_', 'g'), 1, 180) as name from (select page_id, url || case page_id % 3 when 0 then ' x.PDF' when 1 then '.docx' else '' end as n from pages)""")
def file_names(spark, sf):
    """File type by name, and safe directory names."""
    n = F.concat("url", F.when(F.col("page_id") % 3 == 0, " x.PDF").when(F.col("page_id") % 3 == 1, ".docx").otherwise(""))
    return t(spark, sf, "pages").select("page_id", T.file_type(n).alias("file_type"), T.safe_name(n).alias("name"))


@query("select lang as collection_id, count(*)::bigint as n_docs, sum(length(text))::bigint as bytes from documents group by 1")
def collection_sizes(spark, sf):
    """Documents and characters of each collection."""
    d = t(spark, sf, "documents").select(F.col("lang").alias("collection_id"), F.length("text").alias("length"))
    return registry.directory_size(d).join(d.groupBy("collection_id").agg(F.count("*").alias("n_docs")), "collection_id").select("collection_id", "n_docs", "bytes")


@query(f"""with {KNN_SQL} select q_id, row_pos::varchar as chunk_id, d.source as doc_id, rank::bigint as rank, length(d.text)::bigint as n, [d.lang] as section_path, case when d.doc_id % 3 = 0 then 'from index' else 'from chunk' end as section_context,
 case when d.doc_id % 2 = 0 then 'table' else 'semantic_text' end as chunk_type, case when d.doc_id % 4 = 0 then 7 else d.doc_id + 1 end::bigint as token_count from k join documents d on d.doc_id = row_pos""")
def hydrate_hits(spark, sf):
    """Hits joined with the index's and the chunks' fields; a chunk's own value wins where it is not empty."""
    d = t(spark, sf, "documents")
    text_id = F.col("doc_id").cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    index = d.select(F.col("doc_id").alias("row_pos"), text_id.alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_num"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.array("lang").alias("section_path"), F.lit("from index").alias("section_context"), F.lit("semantic_text").alias("chunk_type"), F.lit(7).alias("token_count"), F.lit(True).alias("index_this"))
    chunks = d.select(text_id.alias("chunk_id"), "text", F.col("text").alias("text_original"), F.lit("").alias("text_clean"), none("array<string>").alias("section_path"), F.when(F.col("doc_id") % 3 > 0, "from chunk").otherwise("").alias("section_context"), F.when(F.col("doc_id") % 2 == 0, "table").alias("chunk_type"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") + 1).otherwise(0).cast("int").alias("token_count"), none("boolean").alias("index_this"))
    out = retrieval.hydrate(_knn(spark, sf), index, chunks)
    return out.select("q_id", "chunk_id", "doc_id", long_(F.col("rank")).alias("rank"), long_(F.length("text")).alias("n"), "section_path", "section_context", "chunk_type", long_(F.col("token_count")).alias("token_count"))


def _gold_log(spark, sf):
    gold = t(spark, sf, "benchmark").select("item_id", F.concat(F.lit("q"), (F.col("item_id") % 150).cast("string")).alias("query"))
    d = t(spark, sf, "documents")
    names = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.alias("source_idx"), F.concat(F.lit("s"), ((F.col("doc_id") + i) % 4).cast("string")).alias("source_name"), F.concat(F.lit("c"), ((F.col("doc_id") * i) % 5).cast("string")).alias("chunk_id")))
    log = d.select(F.concat(F.lit(" q"), (F.col("doc_id") % 120).cast("string"), F.lit(" ")).alias("query"), F.col("doc_id").alias("seq"), names.alias("sources"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("2"), F.lit("1"), F.lit("2"), F.lit("9"))).alias("citations"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("text").alias("answer_text"), F.lit("old").alias("answer"))
    return gold, log


GOLD_LOG = """l as (select 'q' || (doc_id % 120) as query, max(doc_id) as seq from documents group by 1), g as (select item_id, 'q' || (item_id % 150) as query from benchmark)"""


@query(f"with {GOLD_LOG} select item_id, seq as log_seq from g left join l using (query)")
def gold_log_pairs(spark, sf):
    """A2: every gold row with the last log row of its question, or with none."""
    hit, miss = evaluation.pairs(*_gold_log(spark, sf))
    return hit.select("item_id", "log_seq").unionByName(miss.select("item_id", F.lit(None).cast("long").alias("log_seq")))


@query(f"""with {GOLD_LOG}, m as (select item_id, seq from g join l using (query)), x as (select *, [1, 2, 3] as n, list_transform([1, 2, 3], lambda i: 's' || ((seq + i) % 4)) as sn, list_transform([1, 2, 3], lambda i: 'c' || ((seq * i) % 5)) as sc from m)
select item_id, case when seq % 3 = 0 then 'old' else 'text' end as answer, array_to_string(sn, ',') as context_names, array_to_string(sc, ',') as context_ids, case when seq % 2 = 0 then '2,1,9' else '' end as cited,
 case when seq % 2 = 0 then sn[2] || case when sn[1] <> sn[2] then ',' || sn[1] else '' end else '' end as cited_names, case when seq % 2 = 0 then sc[2] || case when sc[1] <> sc[2] then ',' || sc[1] else '' end else '' end as cited_ids from x""")
def log_accessors(spark, sf):
    """Answers, contexts and citations of log rows in either spelling; numbers that no source has drop out."""
    out = evaluation.accessors(evaluation.pairs(*_gold_log(spark, sf))[0])
    lists = ("context_names", "context_ids", "cited", "cited_names", "cited_ids")
    return out.select("item_id", "answer", *[F.array_join(c, ",").alias(c) for c in lists])


@query("""with g as (select doc_id, list_distinct([doc_id % 7, doc_id % 5, 99]) as ids from documents) select doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(ids, lambda x: x < 6), lambda x: 'f' || (x % 4)))), ',') as names from g""")
def gold_source_names(spark, sf):
    """The source map: ids of gold sources as file names, unknown ids left out."""
    d = t(spark, sf, "documents").select("doc_id", F.array_distinct(F.array(F.col("doc_id") % 7, F.col("doc_id") % 5, F.lit(99).cast("long"))).alias("source_ids"))
    names = spark.range(6).select(F.col("id").alias("source_id"), F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("file_name"))
    return evaluation.with_gold_names(d, names).select("doc_id", F.array_join("gold_names", ",").alias("names"))


@query("""with old as (select event_type as id, 'T' || (event_id % 2) as kind, max(event_id) as m from events group by 1, 2), new as (select event_type as id, 'T' || (event_id % 3) as kind, max(event_id) as m from events where event_id % 5 > 0 group by 1, 2)
select coalesce(n.kind, o.kind) as node_type, coalesce(n.id, o.id) as node_id, case when n.id is null then 'a' else 'b' end as collection_id, coalesce(n.m, o.m)::varchar as last, case when o.id is not null then 'kept' end as old_only from old o full join new n on o.id = n.id and o.kind = n.kind""")
def upsert_nodes(spark, sf):
    """New properties over those of nodes that are there, the others kept, new nodes added."""
    e = t(spark, sf, "events")

    def nodes(rows, k, collection, *more):
        last = rows.groupBy(F.concat(F.lit("T"), (F.col("event_id") % k).cast("string")).alias("node_type"), F.col("event_type").alias("node_id")).agg(F.max("event_id").cast("string").alias("m"))
        return last.select(F.lit(collection).alias("collection_id"), "node_type", "node_id", F.create_map(F.lit("last"), F.col("m"), *more).alias("properties"))

    out = graph.upsert_nodes(nodes(e, 2, "a", F.lit("old"), F.lit("kept")), nodes(e.where("event_id % 5 > 0"), 3, "b"))
    return out.select("node_type", "node_id", "collection_id", F.element_at("properties", F.lit("last")).alias("last"), F.element_at("properties", F.lit("old")).alias("old_only"))


@query("""with n as (select distinct 'u' || user_id as id from events where user_id % 3 > 0), old as (select distinct 'BUYS' as edge_type, 'u' || user_id as from_id, 'u' || (user_id + 1) as to_id from events where user_id % 2 = 0),
new as (select distinct 'BUYS' as edge_type, 'u' || user_id as from_id, 'u' || (user_id + 1) as to_id from events where 'u' || user_id in (select id from n) and 'u' || (user_id + 1) in (select id from n))
select edge_type, from_id, to_id, 'new' as version from new union all select edge_type, from_id, to_id, 'old' from old anti join new using (edge_type, from_id, to_id)""")
def upsert_edges(spark, sf):
    """Edges with both ends there replace equal ones; others are not taken."""
    e = t(spark, sf, "events").select("user_id")
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    edges = e.select(F.lit("BUYS").alias("edge_type"), name(F.col("user_id")).alias("from_id"), name(F.col("user_id") + 1).alias("to_id"), "user_id").distinct()
    old = edges.where("user_id % 2 = 0").drop("user_id").withColumn("version", F.lit("old"))
    nodes = e.where("user_id % 3 > 0").select(name(F.col("user_id")).alias("node_id")).distinct()
    return graph.upsert_edges(old, edges.drop("user_id").withColumn("version", F.lit("new")), nodes)


@query(f"""with m as ({MENTIONS}), ids as (select distinct entity_text as a, lag(entity_text) over (order by entity_text) as b from (select distinct entity_text from m))
select distinct collection_id, doc_id, chunk_id as source_chunk_id, sha256(a) as source_entity_id, sha256(b) as target_entity_id, 'BEFORE' as relation_type from m join ids on a = entity_text where b is not null""")
def entity_relations(spark, sf):
    """Relations between entities, placed in every chunk that mentions their source."""
    chunks, nodes, edges, _, _ = _graph(spark, sf)
    found = graph.mentions(nodes, edges, chunks)
    names = found.select("entity_id", "entity_text").distinct()
    after = F.lag("entity_id").over(Window.orderBy("entity_text"))  # the test's relation, over distinct words
    linked = names.withColumn("b", after).where("b is not null").select(F.lit(None).cast("string").alias("collection_id"), F.lit("BEFORE").alias("edge_type"), F.col("entity_id").alias("from_id"), F.col("b").alias("to_id"))
    return graph.relations(edges.where("edge_type = 'FROM_CHUNK'").unionByName(linked), found)


@query("""with v as (select event_type as n, round(avg(value), 4) as x from events where event_id % 2 = 0 group by 1), m as (select unnest(['recall@10', 'unsupported_claim_rate']) as name, unnest(['click', 'view']) as n), f as (select name, coalesce(x, 0) / 1000 as vector from m left join v using (n))
select name, round(vector * 100, 1) as vector_pct, round((vector + 0.01) * 100, 1) as hybrid_pct, round((round((vector + 0.01) * 100, 1) - round(vector * 100, 1)) * case when name = 'unsupported_claim_rate' then -1 else 1 end, 1) as gain_pp from f""")
def dashboard_metrics(spark, sf):
    """Two of the dashboard's metrics in percent, with the gain turned round for the rate of unsupported claims."""
    means = t(spark, sf, "events").where("event_id % 2 = 0").groupBy(F.col("event_type").alias("n")).agg(F.round(F.avg("value"), 4).alias("x"))
    two = spark.createDataFrame([("recall@10", "click"), ("unsupported_claim_rate", "view")], "name string, n string")
    rows = two.join(means, "n", "left").select("name", (F.coalesce("x", F.lit(0.0)) / 1000).alias("vector")).withColumn("hybrid", F.col("vector") + 0.01)
    return evaluation.dashboard_series(rows, spark).join(two.select("name"), "name", "left_semi").select("name", "vector_pct", "hybrid_pct", "gain_pp")


def pages(spark, sf):
    d = t(spark, sf, "documents")
    number = F.row_number().over(Window.partitionBy(document()).orderBy("doc_id"))
    return d.select(document().alias("doc_id"), F.concat(document(), F.lit(".pdf")).alias("file_name"), number.alias("page_num"), F.col("text").alias("text_original"))


@query()
def chunk_pages(spark, sf):
    """The whole chunker over multi-page documents."""
    return chunking.chunk_pages(pages(spark, sf)).drop("text_original", "text_clean", "embedding_text")


@query()
def answer_questions(spark, sf):
    """The query path end to end: every benchmark item asked of a hybrid collection."""
    from docloom.plans import service

    c = service.ingest(pages(spark, sf), "docs", "hybrid")
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    return service.answer(asked, c).select("q_id", "answer_text", "citations", F.size("sources").alias("n_sources"))

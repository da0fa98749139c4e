import io
import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T
from docloom.operators import embedding as E
from docloom.operators import evaluation, graph, layout, prompts, registry, retrieval
from docloom.plans import service
from docloom.sources import docx, files, sinks
from docloom.streaming import ingest


def test_config(tmp_path):
    (tmp_path / ".env").write_text("# c\nA='x y'\nB=1\n\nbad line\n")
    got = config.load_env_file(str(tmp_path / ".env"), {"B": "2"})
    assert got == {"A": "x y", "B": "2"}
    e = {"N": "7", "BAD": "q", "T": "Yes", "E": ""}
    assert (config.env("N", 1, e), config.env("BAD", 1.5, e), config.env("T", False, e), config.env("E", "d", e), config.env("Z", 3, e)) == (7, 1.5, True, "d", 3)
    assert config.Settings.from_env({"RETRIEVAL_TOP_K": "4"}).retrieval.top_k == 4


BLOCK = "doc_id string, page_num int, pos int, type string, x0 double, y0 double, x1 double, y1 double, text string, font_size double, is_bold boolean"


def blocks(spark, *rows):
    return spark.createDataFrame([("d", 1, i, *r) for i, r in enumerate(rows)], BLOCK)


def test_layout_page(spark):
    rows = blocks(
        spark, ("text", 20.0, 100.0, 200.0, 110.0, "Method", 14.0, True), ("text", 20.0, 130.0, 60.0, 140.0, "broken", 10.0, False), ("text", 70.0, 134.0, 100.0, 140.0, "line.", 10.0, False),
        ("image", 20.0, 150.0, 90.0, 190.0, "", 0.0, False), ("text", 20.0, 200.0, 200.0, 210.0, "Fig 2 A plot\nmore text", 10.0, False), ("text", 350.0, 100.0, 560.0, 110.0, "∑ α β", 10.0, False),
        ("text", 350.0, 130.0, 560.0, 140.0, "right side text", 10.0, False), ("text", 350.0, 700.0, 360.0, 710.0, "- 3 -", 10.0, False),
    )
    ordered = layout.reading_order(rows, F.lit(600.0))
    page = layout.page_text(layout.merge_lines(ordered)).first()
    assert page.text_original.split("\n\n") == ["Method", "broken line.", "Fig 2 A plot", "more text", "[FORMULA: ∑ α β]", "right side text"]
    assert page.sections == ["Method"] and page.figures == ["Fig 2 A plot"] and page.flags.has_formulas and page.flags.has_figures
    clean = layout.clean_pages(layout.page_text(layout.merge_lines(ordered)), normalize=False).first()
    assert clean.flags.is_garbage is False and clean.flags.method == "layout"


def test_merge_anchor_is_the_first_block(spark):
    rows = blocks(spark, *[("text", 10.0 * i, 6.0 * i, 10.0 * i + 5, 9.0, f"t{i}", 10.0, False) for i in range(4)])
    merged = layout.merge_lines(layout.reading_order(rows, F.lit(6000.0))).orderBy("line").collect()
    assert [r.text for r in merged] == ["t0 t1", "t2 t3"]  # 12 is more than 8 from the first top


def test_spans(spark):
    rows = spark.createDataFrame([("d", 1, 0, 0, 0, "ab", 10.0, 16), ("d", 1, 0, 0, 1, "cd ", 10.0, 16), ("d", 1, 0, 0, 2, "ef", 13.0, 0), ("d", 1, 0, 1, 0, "g", 11.0, 0)], "doc_id string, page_num int, pos int, line_no int, span_no int, text string, size double, flags int")
    r = layout.span_blocks(rows).first()
    assert (r.text, r.font_size, r.is_bold) == ("ab cd ef\ng", 11.0, False)


def make_docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, n=1: f'<w:tc><w:tcPr>{f"<w:gridSpan w:val=\"{n}\"/>" if n > 1 else ""}</w:tcPr>{p(t)}</w:tc>'
    table = f"<w:tbl><w:tr>{cell('h', 2)}{cell('k')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    body = p("Intro text") + p("First", "H1") + p("body") + table + p("Figure 1: it", "Caption") + p("Second", "H1")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark):
    rows = spark.createDataFrame([("a", bytearray(make_docx())), ("b", bytearray(b"no zip"))], "doc_id string, content binary")
    items = docx.items(rows)
    assert items.where("kind = 'error'").select("doc_id").collect() == [("b",)]
    got = docx.sections(items).orderBy("page_num").collect()
    assert [r.page_num for r in got] == [1, 2, 3] and got[1].sections == ["First"] and got[1].figures == ["Figure 1: it"]
    assert got[1].tables == ["| h |  | k |\n| --- | --- | --- |\n| 1 | 2 |  |"]


def test_embedding_cache_is_idempotent_and_embeds_each_text_once(spark):
    kind = "chunk_id string, doc_id string, embedding_text string, text_clean string, index_this boolean"
    chunks = spark.createDataFrame([("c1", "d1", "same", "", True), ("c2", "d2", "same", "", True), ("c3", "d1", "", "other", None), ("c4", "d1", "x", "", False), ("c5", "d1", " ", " ", True)], kind)
    store = spark.createDataFrame([], "cache_key string, dim int, vec array<float>")
    done = spark.createDataFrame([], "doc_id string, chunk_id string, embedder_id string")
    new, links, rows = E.embed_chunks(chunks, store, done, E.HashingEmbedder)
    assert (new.count(), links.count(), rows.count()) == (2, 3, 3)
    new2, links2, rows2 = E.embed_chunks(chunks, new, links, E.HashingEmbedder)
    assert (new2.count(), links2.count(), rows2.count()) == (0, 0, 0)
    wrong = new.withColumn("vec", F.slice("vec", 1, 3))
    assert E.embed_chunks(chunks, wrong, done, E.HashingEmbedder)[0].count() == 2
    assert E.insert_or_ignore(new, new, ["cache_key"]).count() == 0
    bad = spark.createDataFrame([([1.0, float("nan")],)], "v array<float>")
    with pytest.raises(Exception, match="DIM_MISMATCH"):
        bad.select(E.checked(F.col("v"), 2)).collect()


def test_batch_limits():
    got = list(E.batches(["x" * 50_000] * 2 + ["y"] * 70))
    assert [len(b) for b in got] == [1, 64, 7] and all(sum(map(len, b)) <= E.BATCH_CHARS for b in got)
    assert list(E.batches(["z" * 100_000])) == [["z" * 100_000]] and list(E.batches([])) == []


def test_index_positions_of_more_rows_than_a_range_sort_samples(spark):
    ids = spark.range(20_000).repartition(40)
    v = ids.select((F.col("id") % 3).cast("string").alias("doc_id"), (F.col("id") % 9).cast("int").alias("page_num"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"), F.col("id").cast("string").alias("chunk_id"), F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("vector"), F.lit("e").alias("embedder_id"))
    got = E.index_rows(v, "e", 2).select("chunk_id", "row_pos").collect()
    want = sorted((str(i % 3), i % 9, str(i)) for i in range(20_000))
    assert sorted((r.row_pos, r.chunk_id) for r in got) == [(n, w[2]) for n, w in enumerate(want)]
    assert E.index_rows(v.limit(0), "e", 2).count() == 0


def test_knn_ties_and_short_index(spark):
    x = np.array([[1, 0, 0], [0, 1, 0], [0, 1, 0], [1, 1, 0], [0, 0, 2], [-1, 0, 0]], float)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_pos long, vector array<float>").repartition(3)
    q = spark.createDataFrame([("a", [0.0, 1.0, 0.0]), ("b", [0.0, 0.0, 0.0])], "q_id string, q_vec array<float>")
    got = retrieval.knn(q, index, 10).orderBy("q_id", "rank").collect()
    assert [r.row_pos for r in got if r.q_id == "a"][:3] == [1, 2, 3] and len(got) == 12
    ip = retrieval.knn(q, index, 2, "ip").where("q_id = 'a'").orderBy("rank").collect()
    assert [(r.row_pos, r.score) for r in ip] == [(1, 1.0), (2, 1.0)]
    assert retrieval.knn(q.limit(0), index, 3).count() == 0


def test_knn_ties_of_many_near_copies(spark):
    rows = [(i, [1.0 + (200 - i) * 1e-13, 0.5]) for i in range(200)]
    index = spark.createDataFrame(rows, "row_pos long, vector array<double>").repartition(1)
    q = spark.createDataFrame([("a", [0.0, 0.0])], "q_id string, q_vec array<double>")
    got = retrieval.knn(q, index, 5).orderBy("rank").collect()
    assert [r.row_pos for r in got] == [0, 1, 2, 3, 4]


def test_knn_keeps_k_of_the_copies_of_a_vector(spark):
    at, score, rows = np.array([0] * 6 + [1] * 3), np.array([1.0, 1.0, 1.0, 2.0, np.nan, np.nan, 1.0, 1.0, 1.0]), np.array([9, 3, 5, 1, 8, 2, 4, 6, 7])
    assert sorted(retrieval.tied_first(at, score, rows, 2).tolist()) == [1, 2, 3, 4, 5, 6, 7]
    index = spark.range(30_000).select(F.col("id").alias("row_pos"), F.array(F.col("id") % 3, F.lit(1)).cast("array<float>").alias("vector")).coalesce(1)
    q = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [9.0, 0.0])], "q_id string, q_vec array<float>")
    got = retrieval.knn(q, index, 4).orderBy("q_id", "rank").collect()
    assert [r.row_pos for r in got] == [1, 4, 7, 10, 2, 5, 8, 11]
    bad = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0])], "row_pos long, vector array<float>").coalesce(1)
    with pytest.raises(Exception, match="DIM_MISMATCH"):
        retrieval.knn(q, bad, 1).collect()


def test_formula_letters_lie_in_the_blocks_that_are_asked_first(spark):
    assert all(re.match(f"[{layout.MATH_BLOCKS}]", c) for c in layout.MATH)
    rows = spark.createDataFrame([("∑ab",), ("é" * 20 + "±",), ("±÷ x",), ("cost $5 and $6",), ("\\frac",), ("plain",), ("ж∪∩ж",)], "t string")
    assert [r[0] for r in rows.select(layout.is_formula(F.col("t"))).collect()] == [True, False, True, True, True, False, True]
    # one class of sixty letters is tried letter by letter at every character
    assert "&&" in rows.select(layout.is_formula(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_trimming_takes_the_characters_that_white_space_has(spark):
    rows = spark.range(0x3100).where("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    both = rows.select("c", (T.strip(F.concat("c", F.lit("a b"), "c")) == F.regexp_replace(F.concat("c", F.lit("a b"), "c"), r"(?U)^\s+|\s+$", "")).alias("same"), (T.rstrip(F.concat(F.lit(" a"), "c")) == F.regexp_replace(F.concat(F.lit(" a"), "c"), r"(?U)\s+$", "")).alias("right"))
    assert both.where("not (same and right)").count() == 0 and len(T.WHITE) == 25
    assert "regexp" not in str(rows.select(T.strip(F.col("c")))._jdf.queryExecution().optimizedPlan().toString())


def test_entity_search_finds_terms_inside_entities(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", 1, i, i + 1, "t") for i in range(4)], "chunk_id string, doc_id string, page_num int, start_char int, end_char int, text_clean string")
    m = spark.createDataFrame([("c0", "e1", "Neural Nets"), ("c0", "e2", "Network"), ("c1", "e1", "Neural Nets"), ("c2", "e3", "Other"), ("c3", "e4", "ne")], "chunk_id string, entity_id string, entity_text string")
    q = spark.createDataFrame([(1, "about net and NEUR, ne"), (2, "")], "q_id int, question string")
    got = retrieval.entity_search(q, m, chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.matched) for r in got] == [("c0", 2.0, ["Network", "Neural Nets"]), ("c1", 1.0, ["Neural Nets"])]


def test_entity_search_shuffles_no_pair_of_question_and_chunk(spark):
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("page_num"), F.lit(0).alias("start_char"), F.lit(9).alias("end_char"), F.lit("t").alias("text_clean"))
    m = chunks.select("chunk_id", F.explode(F.sequence(F.lit(0), F.col("chunk_id") % 7)).alias("i")).select("chunk_id", F.concat(F.lit("e"), (F.col("i") / 2).cast("int")).alias("entity_id"), F.concat(F.lit("Network"), "i").alias("entity_text"))
    q = spark.range(600).select(F.col("id").alias("q_id"), F.when(F.col("id") == 5, "work3 other").otherwise("the network").alias("question"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = written()
    got = retrieval.entity_search(q, m, chunks, 3).orderBy("q_id", "rank").collect()
    # 1.8 million pairs of question and chunk have a score; they would be more than this
    assert written() - before < 2_000_000
    assert [(r.q_id, r.chunk_id, r.score, r.rank) for r in got if r.q_id in (0, 5, 599)] == [(0, 6, 4.0, 1), (0, 13, 4.0, 2), (0, 20, 4.0, 3), (5, 3, 1.0, 1), (5, 4, 1.0, 2), (5, 5, 1.0, 3), (599, 6, 4.0, 1), (599, 13, 4.0, 2), (599, 20, 4.0, 3)]
    assert len(got) == 1800 and got[15].matched == ["Network3"]


def test_fusion_bounds_and_rerank(spark):
    v = spark.createDataFrame([(1, "a", 0.0, 1), (1, "b", 3.0, 2)], "q_id int, chunk_id string, score double, rank int")
    g = spark.createDataFrame([(1, "b", 2.0, 1), (1, "c", 1.0, 2)], "q_id int, chunk_id string, score double, rank int")
    got = retrieval.fuse(v, g).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 4)) for r in got] == [("a", 0.65), ("b", 0.5125), ("c", 0.175)]
    with pytest.raises(Exception, match="empty candidate"):
        retrieval.rerank(v.withColumn("text", F.lit(" ")), F.lit(1.0)).collect()
    with pytest.raises(Exception, match="bad retrieval mode"):
        spark.sql("select 'x' a, null b").select(retrieval.resolve_mode(F.col("a"), F.col("b").cast("string"))).collect()


def test_graph_round_trip(spark):
    rows = [("d1", "f1", i, f"Alice Smith met Bob in Paris {i}") for i in range(3)] + [("d2", "f2", 0, "nothing here")]
    chunks = spark.createDataFrame([(d, f, f"{d}-{i}", i, 0, 9, t) for d, f, i, t in rows], "doc_id string, file_name string, chunk_id string, page_num int, start_char int, end_char int, text_clean string")
    docs = spark.createDataFrame([("c", "d1", "f1", "pdf")], "collection_id string, doc_id string, file_name string, file_type string")
    loaded = graph.load_chunks(chunks, docs, "c")
    assert {(r.doc_id, r.file_name, r.file_type) for r in loaded.collect()} == {("d1", "f1", "pdf"), ("d2", "d2", "unknown")}
    nodes, edges, found, linked = graph.build(loaded)
    s = graph.stats(nodes, edges, "c").first()
    assert (s.doc_nodes, s.chunk_nodes, s.has_chunk_edges, s.next_edges) == (2, 4, 4, 2)
    assert {r.entity_text for r in graph.mentions(nodes, edges, loaded).collect()} == {"Alice Smith", "Bob", "Paris"}
    assert graph.relations(edges.where("edge_type = 'RELATED_TO'"), graph.mentions(nodes, edges, loaded)).count() == 6
    n2, e2 = graph.purge(nodes, edges, "c")
    assert n2.count() == 0 and e2.count() == 0 and graph.duplicate_keys(nodes).count() == 0
    stamped = graph.stamp(chunks, spark.createDataFrame([("n1", "nothing here"), ("n2", "nothing here")], "node_id string, text string")).collect()
    assert [(r.node_id, r.chunk_id) for r in stamped] == [("n1", "d2-0")]


def test_prompt_and_citations(spark):
    rows = spark.createDataFrame([(1, 1, "f.pdf", "c1", "d1", 2, 0, 5, 0.5, "Text one.", ["A", " "], "", "table"), (1, 2, None, "c2", "d2", None, None, None, 0.4, "Two", [], "S", "semantic_text")], "q_id int, rank int, source_name string, chunk_id string, doc_id string, page_num int, start_char int, end_char int, score double, text string, section_path array<string>, section_context string, chunk_type string")
    r = prompts.assemble(prompts.with_blocks(rows)).first()
    a, b = r.context.split(prompts.BETWEEN)
    assert a.startswith("[SOURCE 1 | f.pdf | page=2, chars=0-5 | section=A | [TABLE") and a.endswith("]\nText one.") and b == "[SOURCE 2 | d2 | loc=unknown | section=S]\nTwo"
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(25)] + [(1, 25, "system", "s"), (1, 26, "user", " ")], "conv_id int, turn int, role string, text string")
    assert len(prompts.history_block(turns).first().history.split("\n")) == 18
    out = spark.createDataFrame([("a <b> [1] [9] [1]",)], "x string").select(prompts.citations(F.col("x")).alias("c"), prompts.rendered(F.col("x"), F.array(F.struct(F.lit(1).alias("source_idx"), F.lit('q"').alias("text")))).alias("h")).first()
    assert out.c == ["1", "9"] and out.h == 'a &lt;b&gt; <a title="q&quot;">[1]</a> [9] <a title="q&quot;">[1]</a>'


def test_evaluation(spark, tmp_path):
    gold = [
        {"query": " q1 ", "expected_answer": "Red fox", "relevant_chunk_ids": ["c1"], "gold_chunk_ids": ["zz"], "source_ids": ["s1"], "multi_hop": True},
        {"query": "q2", "answerable": False, "expected_answer": None}, {"query": "q3", "answerable": True, "expected_answer": "", "source_ids": ["s1", "??"]}, {"query": "missing", "expected_answer": "x"},
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(g) for g in gold) + "\n\n")
    g = files.gold_rows(spark, str(tmp_path / "g.jsonl"))
    assert {r["query"]: (r["answerable"], r["gold_chunk_ids"]) for r in g.collect()} == {"q1": (True, ["c1"]), "q2": (False, []), "q3": (True, []), "missing": (True, [])}
    src = [(1, "f1", "c1"), (2, "f2", "c2")]
    log = spark.createDataFrame([("q1", 1, "vector", "old", ["2"], src, []), ("q1", 2, "hybrid", "the red fox [1]", ["1"], src, ["c2"]), ("q2", 3, "vector", "Not found in documents.", [], src, []), ("q3", 4, "vector", "x", ["1", "2"], src, [])], "query string, seq int, retrieval_mode string, answer_text string, citations array<string>, final_context array<struct<source_idx:int,source_name:string,chunk_id:string>>, graph_retrieved array<string>")
    names = spark.createDataFrame([("s1", "f1")], "source_id string, file_name string")
    got = {r["query"]: r for r in evaluation.per_query(g, log, names).collect()}
    assert set(got) == {"q1", "q2", "q3"} and evaluation.pairs(g, log)[1].count() == 1
    q1, q3 = got["q1"], got["q3"]
    assert (q1["recall@10"], q1["multihop_recall@10"], q1["citation_precision"], q1["unsupported_claim_rate"], q1["answer_f1"], q1["graph_contribution_rate"]) == (1.0, 1.0, 1.0, 0.0, round(2 * (2 / 4) / (2 / 4 + 1), 6), 0.5)
    assert (q3["citation_precision"], q3["recall@10"], q3["multihop_recall@10"], q3["answer_f1"]) == (0.5, 1.0, None, None)
    assert got["q2"]["abstention_accuracy"] == 1.0 and got["q2"]["citation_precision"] == 0.0 and got["q2"]["recall@10"] is None
    s = evaluation.summary(evaluation.per_query(g, log, names))
    assert {r.name: r["count"] for r in s.collect()}["recall@10"] == 2
    c = evaluation.compare(s.select("name", "value"), s.where("name <> 'answer_em'").select("name", "value"))
    assert {r.trend for r in c.collect()} == {"unchanged", "n/a"}
    assert evaluation.dashboard_series(c, spark).count() == 7


def test_registry(spark):
    docs = spark.createDataFrame([("c", "d", None)], f"collection_id string, doc_id string, embeddings {registry.EMBEDDINGS}")
    e = spark.createDataFrame([("d", "e1", 3, "t1")], "doc_id string, embedder_id string, dim int, created_at string")
    once = registry.upsert_embedding(docs, e)
    twice = registry.upsert_embedding(once, e.withColumn("created_at", F.lit("t2")).unionByName(e.withColumn("embedder_id", F.lit("e0")).withColumn("created_at", F.lit("t0"))))
    assert [tuple(x) for x in once.first().embeddings] == [("e1", 3, "t1")] and [tuple(x) for x in twice.first().embeddings] == [("e1", 3, "t2")]
    jobs = spark.createDataFrame([(1, "d1", "done", None), (1, "", "done", None), (2, "d2", "done", "EMBED_FAILED")], "job_id int, doc_id string, status string, fail_reason string")
    assert {r.job_id: r.fail_reason for r in registry.job_outcome(jobs).collect()} == {1: None, 2: "ALL_DOCS_FAILED_BY_EMBED"}
    kept = registry.delete_collection({"docs": docs}, "c")
    assert kept["docs"].count() == 0


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    base = str(tmp_path / "t")
    sinks.replace_table(df, base)
    sinks.replace_table(df.limit(1), base)
    assert sinks.read_table(spark, base).count() == 1
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.append(df, str(tmp_path / "j"), "json")
    assert files.read_jsonl(spark, str(tmp_path / "j"), "x int, y string").count() == 4
    assert files.read_jsonl(spark, str(tmp_path / "none"), "x int", missing_ok=True).count() == 0
    sinks.write_json(spark, str(tmp_path / "o.json"), '{"x": 1}')
    sinks.write_json(spark, str(tmp_path / "o.json"), '{"x": 2}')
    assert files.read_json(spark, str(tmp_path / "o.json"), "x int").first().x == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.PDF").write_bytes(b"x")
    raw = registry.ingest_files(files.raw_files(spark, str(tmp_path / "raw")), "c").first()
    assert (raw.file_type, raw.file_size, len(raw.doc_id)) == ("pdf", 1, 64)


def test_incremental_ingest_sees_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    page = lambda d: json.dumps({"doc_id": d, "file_name": d, "page_num": 1, "text_original": "text"})
    run = lambda: ingest.run_available(ingest.page_stream(spark, str(src)), str(tmp_path / "cp"), lambda b, i: b.write.mode("append").parquet(out))
    (src / "a.json").write_text(page("a"))
    run()
    (src / "b.json").write_text(page("b"))
    run()
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_answer_end_to_end(spark):
    pages = spark.createDataFrame([("d1", "one.pdf", 1, "The red fox lives in the old forest near the river and sleeps by day. It hunts at night under the moon."), ("d2", "two.pdf", 1, "Quantum Widgets are sold in Paris by the makers of many fine machines, all of them heavy and expensive to move.")], "doc_id string, file_name string, page_num int, text_original string")
    c = service.ingest(pages, "c", "hybrid")
    q = spark.createDataFrame([(1, "where are Quantum Widgets sold")], "q_id int, question string")
    r = service.answer(q, c, config.Settings(retrieval=config.Retrieval(rerank=True))).first()
    assert r.sources[0].source_name == "two.pdf" and r.citations == ["1"] and "QUESTION:\nwhere" in r.prompt


def test_ingest_reuses_cached_vectors_and_failed_overwrites_keep_old_rows(spark, tmp_path):
    class Counting(E.HashingEmbedder):
        def embed_texts(self, texts):
            raise ValueError("a cached text was embedded")

    text = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega. " * 3
    pages = spark.createDataFrame([("d", "d.pdf", 1, text), ("e", "e.pdf", 1, text + "More of it.")], "doc_id string, file_name string, page_num int, text_original string")
    first = service.ingest(pages, "c")
    made = spark.createDataFrame(first.made.collect(), first.made.schema)
    again = service.ingest(pages, "c", make_embedder=Counting, store=made)
    rows = lambda c: sorted((r.chunk_id, tuple(r.vector)) for r in c.index.collect())
    assert made.count() > 0 and rows(again) == rows(first) and again.made.count() == 0
    first.release()
    again.release()
    path = f"file://{tmp_path}/rows"
    sinks.write_jsonl(spark.range(3), path)
    with pytest.raises(Exception):
        sinks.write_jsonl(spark.range(3).select(F.raise_error(F.lit("x")).alias("id")), path)
    assert spark.read.json(path).count() == 3
    for k in (1, 2):
        sinks.write_json(spark, f"{tmp_path}/one.json", str(k))
    assert (tmp_path / "one.json").read_text() == "2"

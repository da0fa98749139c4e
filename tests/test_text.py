import re
import unicodedata

from pyspark.sql import functions as F

from docloom.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_clean_keeps_markers_and_tables_and_drops_page_numbers(spark):
    dirty = "A\x00b\r\nc  d\t\te  \n2024\n- 4 -\n  [FORMULA: x  y]  \n|a   b|  \n\n\n\nlast "
    got = one(spark, T.clean, dirty)
    assert got == "Ab\nc d e\n[FORMULA: x  y]\n|a b|\n\nlast"


def test_nfkc_first_step(spark):
    assert one(spark, lambda c: T.clean(c, normalize=True), "ﬁne Ⅳ") == unicodedata.normalize("NFKC", "ﬁne Ⅳ")


def test_garbage_flags(spark):
    f = lambda v: one(spark, lambda c: T.garbage_flags(c, T.clean(c)), v)
    assert f("")["reasons"] == ["EMPTY_AFTER_CLEAN"]
    assert f(None)["reasons"] == ["EMPTY_AFTER_CLEAN"]
    assert f("short")["reasons"] == ["TOO_SHORT"]
    assert f("x" * 40) == ((False, [], 0.0))
    assert "HIGH_NONPRINTABLE_RATIO" in f("​" * 10 + "y" * 40)["reasons"]


def test_block_classes(spark):
    cases = {
        "[3] Smith, A.": "citation", "[FORMULA: a]": "formula", "| a | b |": "md_table", "Figure 2 shows": "figure", "Table IV": "figure", "1. Do it": "numbered_item",
        "II. METHOD": "main_section", "A. Background": "main_section", "System Interface and Logging": "subsection", "Jane Doe": "paragraph", "Key-value Stores": "subsection",
        "Term: Spring": "paragraph", "The whole thing here": "paragraph", "it starts low here": "paragraph", "": "paragraph", "Ends with a stop here.": "paragraph",
    }
    rows = spark.createDataFrame(list(cases.items()), "l string, want string").select("l", "want", T.block_class(F.col("l")).alias("got")).collect()
    assert [(r.l, r.got) for r in rows] == [(r.l, r.want) for r in rows]


def test_reference_sections(spark):
    for line, want in (("REFERENCES", True), ("V. R EFERENCES", True), ("Preferences of users", True), ("Works Cited", True), ("Method", False), ("", False)):
        assert one(spark, T.is_reference_section, line) is want, line


def test_identities(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = spark.sql("select 'd' a, 1 b, 2 c, 3 d, 'é' t").select(T.chunk_id(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("t")).alias("x"), T.cache_key(F.col("a"), F.col("t")).alias("y")).first()
    assert row.x == h(f"d|1|2|3|{h('é')}") and row.y == h(f"{h('d')}|{h('é')}")
    assert re.fullmatch(r'[^<>:"/\\|?*\s]{1,180}', one(spark, T.safe_name, ' a<b> c:"d"\t' + "x" * 300))
    assert one(spark, T.parse_embedder_id, T.embedder_id("local", "m", 64, True, "v1", "v1")) == ("local", "m", 64, True)


def test_embedding_text_leaves_out_what_is_missing(spark):
    row = spark.sql("select 'f' f, array(' A ', '') p, 't' t").select(T.embedding_text(F.col("f"), F.col("p"), F.col("t")).alias("a"), T.embedding_text(F.lit(""), F.array().cast("array<string>"), F.col("t")).alias("b")).first()
    assert row.a == "Document: f\nSection: A\n\nt" and row.b == "t"

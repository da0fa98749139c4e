"""Page layout: columns, reading order, line merging, headings, captions, formulas, page text.

Input blocks are rows (doc_id, page_num, pos, type, x0, y0, x1, y1, text, font_size, is_bold) with the page
width as a column or literal. A byte-level parser is a plug-in that yields such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

PAGE = ("doc_id", "page_num")
#: Thresholds and patterns of layout analysis.
Y_TOLERANCE, WIDE, LARGER, SHORT, MATH_SHARE, OCR_MIN, BODY_FONT = 8.0, 0.6, 1.05, 120, 0.08, 40, 10.0
CAPTION = r"(?i)^\s*(?:Fig\.?|Figure|Table|TABLE|Tab\.?|Chart|Diagram|Exhibit|Image|Photo|Plate)\s*[\dIVX]+"
LATEX = r"\\[a-zA-Z]+\{|\\frac|\\sum|\\int|\$.*?\$"
MATH = "∑∏∫∂∇∆αβγδεζηθλμνξπρστφχψωΩΓΔΘΛΞΠΣΦΨ±×÷√∞≈≠≤≥∈∉⊂⊃∪∩"
MATH_BLOCKS = "\u00b1\u00d7\u00f7\u0370-\u03ff\u2200-\u22ff"


def smart_join(parts: Column) -> Column:
    """Texts joined in order; a space only where neither side has white space. Empty texts are skipped."""
    step = lambda acc, t: F.when(acc == "", t).when(acc.rlike(r"(?U)\s$") | t.rlike(r"(?U)^\s"), F.concat(acc, t)).otherwise(F.concat_ws(" ", acc, t))
    return F.aggregate(F.filter(parts, lambda t: t.isNotNull() & (t != "")), F.lit(""), step)


def span_blocks(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page_num, pos, line_no, span_no, text, size, flags) -> block text, font size, bold."""
    spans = spans.where("text is not null and text <> ''")
    lines = spans.groupBy(*PAGE, "pos", "line_no").agg(F.sort_array(F.collect_list(F.struct("span_no", "text"))).alias("s"), F.sum("size").alias("size"), F.count("*").alias("n"), F.sum((F.col("flags").bitwiseAND(16) > 0).cast("int")).alias("bold"))
    lines = lines.withColumn("line", smart_join(F.col("s.text")))
    blocks = lines.groupBy(*PAGE, "pos").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"), (F.sum("size") / F.sum("n")).alias("font_size"), (F.sum("bold") / F.sum("n") > 0.5).alias("is_bold"))
    return blocks.select(*PAGE, "pos", T.strip(F.array_join("l.line", "\n")).alias("text"), "font_size", "is_bold")


def column_count(blocks: DataFrame, width: Column) -> DataFrame:
    """(doc_id, page_num, n_cols): 1, 2 or 3 from where text blocks begin."""
    w, x = width, F.col("x0")
    use = (F.col("type") == "text") & (T.strip(F.coalesce("text", F.lit(""))) != "")
    counts = blocks.groupBy(*PAGE).agg(F.count_if(use & (x < w / 2 * 0.6)).alias("left"), F.count_if(use & (x > w / 2 * 0.4)).alias("right"), F.count_if(use & (x > w / 3 * 1.8)).alias("far"))
    two = (F.col("left") > 1) & (F.col("right") > 1)
    return counts.select(*PAGE, F.when(two & (F.col("far") > 1), 3).when(two, 2).otherwise(1).alias("n_cols"))


def column_band(x0: Column, width: Column, n: Column) -> Column:
    return F.least((x0 / (width / n)).cast("int"), n - 1)


def reading_order(blocks: DataFrame, width: Column) -> DataFrame:
    """Adds col and rank: columns left to right, top to bottom; wide blocks count as the first column."""
    rows = blocks.join(column_count(blocks, width), list(PAGE))
    col = F.when(F.col("x1") - F.col("x0") > width * WIDE, 0).otherwise(column_band(F.col("x0"), width, F.col("n_cols")))
    order = Window.partitionBy(*PAGE).orderBy("col", "y0", "x0", "pos")
    return rows.withColumn("col", col.cast("int")).withColumn("rank", F.row_number().over(order))


def merge_lines(ordered: DataFrame, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """Merges runs of text blocks whose top lies within `tolerance` of the run's first block."""
    fields = ["rank", "type", "x0", "y0", "x1", "y1", "text", "font_size", "is_bold"]
    pages = ordered.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("b"))
    kind = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in (ordered.schema[n] for n in fields)) + ">>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(kind).alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        head = F.get(acc["cur"], F.lit(0))
        on = (F.size(acc["cur"]) > 0) & (head["type"] == "text") & (x["type"] == "text") & (F.abs(x["y0"] - head["y0"]) <= tolerance)
        joins = F.coalesce(on, F.lit(False))
        out = F.when(joins | (F.size(acc["cur"]) == 0), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
        return F.struct(out.alias("out"), F.when(joins, F.concat(acc["cur"], F.array(x))).otherwise(F.array(x)).alias("cur"))

    groups = F.aggregate("b", start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))
    rows = pages.select(*PAGE, F.posexplode(groups).alias("line", "g"))
    head = F.col("g")[0]
    across = F.array_sort(F.transform("g", lambda x: F.struct(x["x0"].alias("x0"), x["rank"].alias("rank"), x["text"].alias("text"))))
    alone = F.size("g") == 1
    return rows.select(
        *PAGE, "line", head["type"].alias("type"), F.array_min("g.x0").alias("x0"), F.array_min("g.y0").alias("y0"), F.array_max("g.x1").alias("x1"), F.array_max("g.y1").alias("y1"),
        F.when(alone, head["text"]).otherwise(T.strip(smart_join(F.transform(across, lambda x: x["text"])))).alias("text"),
        head["font_size"].alias("font_size"), head["is_bold"].alias("is_bold"),
    )


def body_font(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, body_font): the upper-middle positive font size of text blocks, 10 if there is none."""
    sizes = F.sort_array(F.collect_list(F.when((F.col("type") == "text") & (F.col("font_size") > 0), F.col("font_size").cast("double"))))
    got = blocks.groupBy(*PAGE).agg(sizes.alias("s"))
    return got.select(*PAGE, F.coalesce(F.get("s", F.floor(F.size("s") / 2).cast("int")), F.lit(BODY_FONT)).alias("body_font"))


def is_noise(text: Column) -> Column:
    t = T.strip(text)
    return (t == "") | t.rlike(T.PAGE_NUMBER) | ((F.length(t) <= 6) & F.regexp_replace(t, " ", "").rlike(r"^\d+$"))


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    first = T.strip(F.split(text, "\n")[0])
    style = (bold | (size > body * LARGER)) & (F.length(first) < SHORT) & ~first.endswith(".") & ~T.strip(text).contains("\n") & (F.length(first) > 1)
    return style | first.rlike(T.SECTION_LINE)


def is_caption(text: Column) -> Column:
    first = T.strip(F.split(text, "\n")[0])
    return (F.length(first) < SHORT) & first.rlike(CAPTION)


def is_formula(text: Column) -> Column:
    # a class of so many letters is tried one by one: its blocks are asked first, and only where a byte is not ASCII
    count = F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(f"[{MATH_BLOCKS}&&[{MATH}]]")))
    share = count / F.greatest(F.length(text), F.lit(1))
    latex = (text.contains("\\") | text.contains("$")) & text.rlike(LATEX)
    return (F.length(text) >= 3) & (latex | (share > MATH_SHARE))


def table_markdown(rows: Column) -> Column:
    """array<array<string>>, header first -> markdown; rows are padded and cut to the header's width."""
    n = F.size(F.get(rows, F.lit(0)))
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")
    fit = lambda r: F.slice(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), n)), F.lit(1), n)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: line(fit(r)))
    out = F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), n))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when((F.size(rows) > 0) & (n > 0), F.array_join(out, "\n")).otherwise("")


def page_text(blocks: DataFrame, tables: DataFrame | None = None, ocr=None) -> DataFrame:
    """Merged blocks -> one row for each page: text_original, sections, figures, flags.

    `tables` (doc_id, page_num, table_no, rows) adds markdown at the page's end. `ocr`, a column function of
    (doc_id, page_num), replaces text of fewer than 40 characters.
    """
    rows = blocks.join(body_font(blocks), list(PAGE)).withColumn("t", T.strip(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("use", (F.col("type") == "text") & ~is_noise(F.col("t")))
    first, rest = T.strip(F.split("t", "\n")[0]), T.strip(F.regexp_replace("t", r"^[^\n]*\n?", ""))
    caption, formula = is_caption(F.col("t")), is_formula(F.col("t"))
    parts = F.when(caption, F.array(first, rest)).when(formula, F.array(F.concat(F.lit("[FORMULA: "), "t", F.lit("]")))).otherwise(F.array("t"))
    rows = rows.withColumn("parts", F.when(F.col("use"), parts)).withColumn("section", F.when(F.col("use") & is_heading(F.col("t"), F.col("font_size"), F.col("is_bold"), F.col("body_font")), first))
    rows = rows.withColumn("figure", F.when(F.col("use") & caption, first)).withColumn("formula", F.col("use") & ~caption & formula)
    ordered = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line", c))))
    page = rows.groupBy(*PAGE).agg(ordered("parts").alias("p"), ordered("section").alias("s"), ordered("figure").alias("f"), F.bool_or("formula").alias("has_formulas"), F.bool_or(F.col("type") == "image").alias("has_image"))
    body = F.filter(F.flatten("p.parts"), lambda x: x != "")
    if tables is not None:
        marked = tables.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("table_no", table_markdown(F.col("rows")).alias("md")))).alias("m"))
        page = page.join(marked, list(PAGE), "left")
        body = F.concat(body, F.coalesce(F.filter(F.col("m.md"), lambda x: x != ""), F.array().cast("array<string>")))
    text = F.array_join(body, "\n\n")
    method = F.lit("layout")
    if ocr is not None:
        few = F.length(T.strip(text)) < OCR_MIN
        text, method = F.when(few, F.coalesce(ocr("doc_id", "page_num"), text)).otherwise(text), F.when(few, "ocr_fallback").otherwise("layout")
    return page.select(*PAGE, text.alias("text_original"), F.array_distinct("s.section").alias("sections"), F.col("f.figure").alias("figures"), F.struct(method.alias("method"), (F.col("has_image") | (F.size("f") > 0)).alias("has_figures"), "has_formulas").alias("flags"))


def full_text(pages: DataFrame, column: str = "text_original") -> DataFrame:
    """(doc_id, full_text): non-blank pages in order, joined by a blank line."""
    kept = pages.where(T.strip(F.coalesce(column, F.lit(""))) != "")
    return kept.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page_num", column)))[column], "\n\n").alias("full_text"))


def clean_pages(pages: DataFrame, normalize: bool = True) -> DataFrame:
    """Adds text_clean and cleaning flags merged over the extraction flags."""
    rows = pages.withColumn("text_clean", T.clean(F.col("text_original"), normalize))
    found = T.garbage_flags(F.col("text_original"), F.col("text_clean"))
    if "flags" not in pages.columns:
        return rows.withColumn("flags", found)
    return rows.withColumn("flags", F.struct("flags.*", found["is_garbage"].alias("is_garbage"), found["reasons"].alias("reasons"), found["nonprintable_ratio"].alias("nonprintable_ratio")))

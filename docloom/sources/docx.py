"""DOCX scan with the standard library: XML to item rows in Arrow batches, the rest as expressions.

Items are rows (doc_id, pos, kind para or table, style, outline_lvl, text, rows); sectionization, headings,
captions and tables are columns over them.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ITEM = "doc_id string, pos int, kind string, style string, outline_lvl int, text string, rows array<array<string>>"
#: Heading and caption styles and patterns.
HEADING_STYLES = ("heading 1", "heading 2", "heading 3", "heading 4", "heading 5", "heading 6", "title", "subtitle")
CAPTION_STYLES = ("caption",)
CAPTION = r"(?i)^\s*(?:Fig\.?|Figure|TABLE|Table)\s*[\dIVX]+[\.\:]"
SECTION = r"(?i)^\s*(?:(?:[IVX]{1,6}\.)\s+[A-Z]|(?:[A-Z]\.)\s+[A-Z]|(?:\d{1,2}\.\d{0,2})\s+\S)\s*"


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def parse(content: bytes) -> list[dict]:
    """Body items of a DOCX in document order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                name = s.find(W + "name")
                names[s.get(W + "styleId")] = name.get(W + "val") if name is not None else None
    out = []
    for node in body if body is not None else []:
        if node.tag == W + "p":
            style, level = node.find(f"{W}pPr/{W}pStyle"), node.find(f"{W}pPr/{W}outlineLvl")
            key = style.get(W + "val") if style is not None else None
            out.append({"kind": "para", "style": (names.get(key) or key or "").strip().lower(), "outline_lvl": int(level.get(W + "val", 9)) if level is not None else None, "text": _text(node), "rows": None})
        elif node.tag == W + "tbl":
            rows = []
            for tr in node.findall(W + "tr"):
                cells = []
                for tc in tr.findall(W + "tc"):
                    span = tc.find(f"{W}tcPr/{W}gridSpan")
                    text = "\n".join(_text(p) for p in tc.findall(W + "p"))
                    cells += [text] * (int(span.get(W + "val", 1)) if span is not None else 1)
                rows.append(cells)
            out.append({"kind": "table", "style": "", "outline_lvl": None, "text": "", "rows": rows})
    return out


def items(files: DataFrame) -> DataFrame:
    """files (doc_id, content) -> item rows. Files that are no DOCX give one row of kind `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    got = parse(bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    got = [{"kind": "error", "style": "", "outline_lvl": None, "text": str(e), "rows": None}]
                rows = pd.DataFrame(got, columns=["kind", "style", "outline_lvl", "text", "rows"])
                rows.insert(0, "pos", range(len(rows)))
                rows.insert(0, "doc_id", doc)
                rows["outline_lvl"] = rows["outline_lvl"].astype("Int32")
                yield rows

    return files.select("doc_id", "content").mapInPandas(run, ITEM)


def is_heading(style: Column, outline: Column, text: Column) -> Column:
    return style.isin(*HEADING_STYLES) | F.when(outline.isNotNull(), outline < 6).otherwise(T.strip(F.coalesce(text, F.lit(""))).rlike(SECTION))


def is_caption(style: Column, text: Column) -> Column:
    return style.isin(*CAPTION_STYLES) | T.strip(F.coalesce(text, F.lit(""))).rlike(CAPTION)


def table_markdown(rows: Column) -> Column:
    """Markdown with merged-cell repeats blanked; short rows are padded to the widest."""
    cell = lambda c: F.replace(T.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    plain = F.transform(rows, lambda r: F.transform(r, cell))
    # a repeat of the left neighbour is blank; a neighbour is always seen, be it first or repeated
    single = F.transform(plain, lambda r: F.transform(r, lambda c, i: F.when((i > 0) & (c == F.get(r, i - 1)), "").otherwise(c)))
    width = F.array_max(F.transform(single, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    full = F.transform(single, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    out = F.concat(F.slice(full, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))))
    return F.when(F.size(rows) > 0, F.array_join(out, "\n")).otherwise("")


def sections(rows: DataFrame) -> DataFrame:
    """Items -> logical pages (doc_id, page_num, text_original, sections, figures, tables).

    A heading that is not empty begins a section if the current one already has content.
    """
    text = T.strip(F.coalesce("text", F.lit("")))
    rows = rows.where("kind <> 'error'").withColumn("t", F.when(F.col("kind") == "table", table_markdown(F.col("rows"))).otherwise(text)).where("t <> ''")
    head = (F.col("kind") == "para") & is_heading(F.col("style"), F.col("outline_lvl"), F.col("text"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("head", head).withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("page_num", (F.sum(F.when(F.col("head") & (F.col("n") > 1), 1).otherwise(0)).over(order) + 1).cast("int"))
    caption = (F.col("kind") == "para") & ~F.col("head") & is_caption(F.col("style"), F.col("text"))
    pick = lambda c, v: F.sort_array(F.collect_list(F.when(c, F.struct("pos", v.alias("v")))))["v"]
    return rows.groupBy("doc_id", "page_num").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "t")))["t"], "\n\n").alias("text_original"), pick(F.col("head"), F.col("t")).alias("sections"),
        pick(caption, F.col("t")).alias("figures"), pick(F.col("kind") == "table", F.col("t")).alias("tables"),
    )

"""Text columns: cleaning, garbage flags, token counts, block classes, identities.

All are Catalyst expressions except `nfkc`, for which Spark has no function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Patterns that results depend on.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BLANKS = r"[ \t\f\x0B]+"
PAGE_NUMBER = r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"
FORMULA_MARK = r"(?s)^\[FORMULA:.*\]$"
FIGURE_MARK = r"(?s)^\[FIGURE TEXT:.*\]$"
TABLE_ROW = r"^\s*\|.+\|"
MARKERS = r"(?s)\[(?:FORMULA|FIGURE TEXT):.*?\]"
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \n\t]]"
CITATION = r"^\s*\[(\d{1,3})\]\s+\S"
FIGURE = r"(?i)^\s*(?:Fig\.?|Figure|TABLE|Table|Tab\.?)\s*[\dIVX]+"
NUMBERED = r"^\s*(\d{1,2})\.\s+\S"
MAIN_SECTION = r"^\s*(?:[IVX]{1,6}\.|[A-Z]\.|\d{1,2}\.)\s+\S"
REFERENCE_HEADING = r"(?i)^\s*(?:[IVX]{1,6}\.\s+)?(?:REFERENCES?|BIBLIOGRAPHY|WORKS\s+CITED|REFERNCES?)\s*$"
REFERENCE_WORD = r"(?i)REFER[EN]+CES?|BIBLIOGRAPH"
BODY_START = (
    r"^(?:Run|Collect|Identify|Develop|Finalize|Interpret|Refine|Create|Build|Use|Presentation|Written|Functional|Live|Working|"
    r"The |This |A |An |In |For |By |To |At |When |Each |All )"
)
SECTION_LINE = r"(?i)^\s*(?:(?:[IVX]{1,6}\.)\s+[A-Z]|(?:[A-Z]\.)\s+[A-Z])\s*"

_SPACE = r"(?U)\s"
#: The characters that this class has; trimming looks at the ends only, where a pattern is tried at every character.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def or_else(c: Column, other: Column) -> Column:
    """c, or `other` where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


@pandas_udf(StringType())  # a type object: workers import this module without a session
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_line(line: Column) -> Column:
    """A cleaned line, or null if the line is dropped (a bare number of up to four digits)."""
    bare = strip(line)
    short = rstrip(F.regexp_replace(line, BLANKS, " "))
    marker = bare.rlike(FORMULA_MARK) | bare.rlike(FIGURE_MARK)
    return (
        F.when(marker, bare).when(line.rlike(TABLE_ROW), short)
        .when(line.rlike(PAGE_NUMBER), F.lit(None).cast("string")).otherwise(short)
    )


def clean(text: Column, normalize: bool = False) -> Column:
    """Cleaned page text. `normalize` adds NFKC, through Arrow, as the first step."""
    s = F.coalesce(text, F.lit(""))
    if normalize:
        s = nfkc(s)
    s = F.regexp_replace(s, CONTROL, "")
    s = F.regexp_replace(s, "\r\n?", "\n")
    lines = F.transform(F.split(s, "\n", -1), clean_line)
    s = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def unprintable_ratio(original: Column) -> Column:
    """Share of characters that do not print, without markers; line feeds and tabs count as printing."""
    o = F.regexp_replace(F.coalesce(original, F.lit("")), MARKERS, "")
    bad = F.regexp_count(o, F.lit(UNPRINTABLE))
    return F.when(F.length(o) == 0, F.lit(0.0)).otherwise(bad / F.greatest(F.length(o), F.lit(1)))


def garbage_flags(original: Column, cleaned: Column) -> Column:
    """struct<is_garbage, reasons, nonprintable_ratio>."""
    ratio = unprintable_ratio(original)
    n = F.length(F.coalesce(cleaned, F.lit("")))
    reasons = F.array_compact(F.array(
        F.when(n == 0, F.lit("EMPTY_AFTER_CLEAN")), F.when((n > 0) & (n < 30), F.lit("TOO_SHORT")),
        F.when(ratio > 0.10, F.lit("HIGH_NONPRINTABLE_RATIO")),
    ))
    return F.struct((F.size(reasons) > 0).alias("is_garbage"), reasons.alias("reasons"), F.round(ratio, 4).alias("nonprintable_ratio"))


def token_count(text: Column) -> Column:
    """A quarter of the length, at least one: the rule where no tokenizer is plugged in."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def tokenizer_count(count):
    """Plugs in a tokenizer: `count` (list of texts -> list of int) becomes a column function."""

    @pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(count([t or "" for t in texts]), index=texts.index, dtype="int32")

    return run


def is_reference_section(text: Column) -> Column:
    t = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"{_SPACE}+", " ")
    together = F.upper(F.regexp_replace(t, _SPACE, ""))
    return (t != "") & (t.rlike(REFERENCE_HEADING) | t.rlike(REFERENCE_WORD) | together.rlike(REFERENCE_WORD))


def is_subsection(line: Column) -> Column:
    t = strip(line)
    words = F.split(t, rf"{_SPACE}+")
    first = lambda w: F.substring(w, 1, 1)
    upper = lambda c: c.rlike(r"^\p{Lu}")
    name = (F.size(words) == 2) & upper(words[0]) & upper(F.get(words, F.lit(1))) & ~t.rlike("[-&/]")
    return (
        F.length(t).between(4, 60) & ~t.rlike(r"[.,:]$") & ~t.contains(":") & upper(first(t))
        & ~t.rlike(CITATION) & ~t.rlike(FIGURE) & ~t.rlike(FORMULA_MARK) & ~t.rlike(NUMBERED) & ~t.rlike(MAIN_SECTION)
        & F.size(words).between(2, 6) & ~t.rlike(BODY_START) & ~F.coalesce(name, F.lit(False))
    )


def block_class(first_line: Column) -> Column:
    t = strip(F.coalesce(first_line, F.lit("")))
    return (
        F.when(t == "", "paragraph").when(t.rlike(CITATION), "citation").when(t.rlike(FORMULA_MARK), "formula")
        .when(t.rlike(TABLE_ROW), "md_table").when(t.rlike(FIGURE), "figure").when(t.rlike(NUMBERED), "numbered_item")
        .when(t.rlike(MAIN_SECTION), "main_section").when(is_subsection(t), "subsection").otherwise("paragraph")
    )


def item_number(first_line: Column) -> Column:
    return F.when(first_line.rlike(NUMBERED), F.regexp_extract(first_line, NUMBERED, 1).cast("int"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(doc_id: Column, page: Column, start: Column, end: Column, text_clean: Column) -> Column:
    parts = [doc_id, page.cast("string"), start.cast("string"), end.cast("string"), sha256(text_clean)]
    return sha256(F.concat_ws("|", *parts))


def cache_key(embedder_id: Column, embed_text: Column) -> Column:
    return sha256(F.concat_ws("|", sha256(embedder_id), sha256(embed_text)))


def document_node_id(collection_id: Column, doc_id: Column) -> Column:
    return F.concat_ws("::", F.lit("doc"), collection_id, doc_id)


def safe_name(name: Column) -> Column:
    """A directory name: reserved and control characters and white space become `_`, 180 characters at most."""
    s = F.regexp_replace(strip(name), r'[<>:"/\\|?*\x00-\x1F]', "_")
    return F.substring(F.regexp_replace(s, rf"{_SPACE}+", "_"), 1, 180)


def file_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").otherwise("unknown")


def embedder_id(provider: str, model: str, dim: int, normalize: bool, cleaner: str, chunker: str) -> str:
    return "|".join([provider, model, f"d{dim}", f"norm{int(normalize)}", f"clean{cleaner}", f"chunk{chunker}"])


def parse_embedder_id(value: Column) -> Column:
    """struct<provider, model, dim, normalized>; raises for ids that are not well formed."""
    parts = F.split(value, r"\|")
    fine = (F.size(parts) >= 4) & F.get(parts, F.lit(2)).rlike(r"^d\d+$") & F.get(parts, F.lit(3)).rlike("^norm[01]$")
    good = F.struct(parts[0].alias("provider"), parts[1].alias("model"), F.substring(parts[2], 2, 20).cast("int").alias("dim"), (parts[3] == "norm1").alias("normalized"))
    return F.when(F.coalesce(fine, F.lit(False)), good).otherwise(F.raise_error(F.concat(F.lit("bad embedder id: "), F.coalesce(value, F.lit("null")))))


def retrieval_mode(value: Column) -> Column:
    """vector or hybrid, in lower case; raises for anything else."""
    mode = F.lower(strip(value))
    return F.when(mode.isin("vector", "hybrid"), mode).otherwise(F.raise_error(F.concat(F.lit("bad retrieval mode: "), F.coalesce(value, F.lit("null")))))


def embedding_text(file_name: Column, section_path: Column, text_clean: Column) -> Column:
    """`Document:` and `Section:` lines, a blank line and the text; what is missing is left out."""
    parts = F.filter(F.transform(section_path, strip), lambda s: s != "")
    head = F.concat_ws("\n", F.when(F.coalesce(file_name, F.lit("")) != "", F.concat(F.lit("Document: "), file_name)), F.when(F.size(parts) > 0, F.concat(F.lit("Section: "), F.array_join(parts, " > "))))
    return F.when(head == "", text_clean).otherwise(F.concat(head, F.lit("\n\n"), text_clean))


def normalize_answer(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), rf"{_SPACE}+", " ")


def words(text: Column) -> Column:
    # white space only parts words, so it needs no normalising
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def normalize_entity(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"{_SPACE}+", " "))


def canonical_entity(text: Column) -> Column:
    s = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"{_SPACE}+", " ")
    return F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def entity_id(kind: Column, name: Column) -> Column:
    return sha256(F.concat_ws("|", F.upper(strip(kind)), normalize_entity(name)))


def percent(value: Column) -> Column:
    """One decimal and a percent sign, or N/A."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.1f%%", value * 100))


def iso_now() -> Column:
    """Second resolution in UTC with a Z; for exports only, never for compared rows."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")

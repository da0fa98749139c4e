"""Secret scans with DataFrame functions only: base patterns plus sliding-window entropy.

Base kinds (assign, access, hex) are leftmost non-overlapping matches of fixed patterns; matches
that are too short are dropped. The entropy kinds look at candidate strings, maximal runs of a
character class (hexrun: hexadecimal digits; alnum: letters and digits; base64: letters, digits and
+ / _ -), and slide a window over each. Counts of the characters in the window are kept as five bits each in
six numbers; moving the window changes two of them, and the sum of c * log2(c) from which the entropy
follows is corrected by the change of those two terms, whatever the window or the alphabet. A candidate is a
secret when the highest window entropy reaches the class's threshold, the candidate mixes letters and
digits, and no allow-list pattern matches it as a whole (UUIDs, words without digits, one repeated character, file
paths, placeholders).

Work is in proportion to the text, also for a candidate as long as the text; for the n spans of one text it
is n * BLOCK steps.

Defined results: null texts are empty texts and have no spans; the digest of no span is the SHA-256
of the empty string. Offsets count code points; ends are exclusive. Repeated rows are scanned one
by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pick

#: The base kinds in their order, their patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "hexrun", "alnum", "base64")
#: Class, pattern of a candidate, window, bits a character that a window must reach.
CLASSES = (
    ("hexrun", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_-])", 20, 3.0),
    ("alnum", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9]{20,}(?![A-Za-z0-9+/_-])", 20, 3.6),
    ("base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])", 24, 3.8),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Candidates that are no secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z_/+-]+=*$", r"^[0-9]+$", r"^(.)\1*$", r"^/?(?:[a-z]+/)+[a-z0-9_-]*$", r"^(?i:example|sample|test|dummy|placeholder)",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="


SPAN = "array<struct<start:int,end:int,rank:int,kind:string,hit:string>>"
#: Spans of a text that are gathered in one array before the arrays are put together.
BLOCK = 128


def let(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """array<struct<start, end, rank, kind, hit>> of all leftmost non-overlapping matches.

    The pieces between the matches and the matches alternate, so running lengths give offsets.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    none = F.array().cast(SPAN)

    def block(start: Column, part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin, end = acc["at"] + F.length(x["gap"]), acc["at"] + size(x)
            one = F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
            return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def blocks(p: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
        return let(parts, placed)

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + size(x)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return let(starts, lambda at: F.flatten(F.transform(parts, lambda part, k: block(F.element_at(at, k + 1), part))))

    return F.when(text.rlike(pattern), let(pairs, blocks)).otherwise(none)


def entropy(word: Column, window: int) -> Column:
    """Highest Shannon entropy (bits a character) over all windows of a string, by incremental counts; windows of 31 at most."""
    terms = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 2)])
    term = lambda c: F.element_at(terms, (c + 1).cast("int"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (k % 12 * 5).cast("int"))
    count = lambda n, k: F.call_function("shiftright", F.element_at(n, (k / 12).cast("int") + 1), (k % 12 * 5).cast("int")).bitwiseAND(F.lit(31))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), 6).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))

    def moved(acc: Column, into: Column, out: Column, i: Column) -> Column:
        a, b = count(acc["n"], into), F.when(out >= 0, count(acc["n"], F.greatest(out, F.lit(0)))).otherwise(F.lit(0).cast("long"))
        # the same character in and out changes nothing
        s = F.when(into == out, acc["s"]).otherwise(
            acc["s"] - term(a) + term(a + 1) - F.when(out >= 0, term(b) - term(F.greatest(b - 1, F.lit(0)))).otherwise(F.lit(0.0))
        )
        change = lambda k, at, sign: F.when((at >= 0) & (k == (at / 12).cast("int")), sign * one(F.greatest(at, F.lit(0)))).otherwise(F.lit(0).cast("long"))
        n = F.when(into == out, acc["n"]).otherwise(F.transform(acc["n"], lambda v, k: v + change(k, into, 1) - change(k, out, 1)))
        return F.struct(n.alias("n"), s.alias("s"), F.when(i >= window, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

    def over(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            return moved(acc, F.element_at(codes, i), F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1)), i)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda acc: F.lit(log2(window)) - acc["least"] / window)

    return let(F.transform(F.split(word, "", -1), lambda c: F.instr(F.lit(ALPHABET), c) - 1), over)


def secret(hit: Column, window: int, bits: float) -> Column:
    fine = F.length(hit) >= window
    fine &= hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    for pattern in ALLOW:
        fine &= ~hit.rlike(pattern)
    return F.when(fine, entropy(hit, window) >= bits).otherwise(F.lit(False))


def strong(window: int, bits: float):
    return lambda span: secret(span["hit"], window, bits)


def scan(docs: DataFrame) -> DataFrame:
    """`docs` plus `spans`: array<struct<start, end, rank, kind, hit>> sorted by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    rows = rows.withColumn("base", F.concat(
        F.filter(spans(F.col("text"), ASSIGN, "assign", 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6),
        spans(F.col("text"), ACCESS, "access", 1), spans(F.col("text"), HEX, "hex", 2),
    ))
    more = [
        F.filter(spans(F.col("text"), pattern, kind, 3 + k), strong(window, bits))
        for k, (kind, pattern, window, bits) in enumerate(CLASSES)
    ]
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,hit:string>>")
    rows = rows.withColumn("more", F.when(F.col("text").rlike(CANDIDATE), F.concat(*more)).otherwise(none))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "more")).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, and all spans as text."""
    rows = scan(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )

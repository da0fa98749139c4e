"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling, DataFrame only.

Every text is a sequence of line ids. Round k of the doubling gives each suffix the order-preserving
rank of its first 2**k lines: a rank pair (first half, second half) is ranked by a range-partitioned
sort of the distinct pairs, so a pair that a third of all suffixes share is still one row there. Only
suffixes whose rank is shared go on, as only those lie in an interval of suffixes with a common
prefix of that length; the doubling ends when the runs asked for are shorter than 2**k. Suffixes
with L first lines in common, 2**k <= L < 2**(k + 1), are those with equal ranks at both ends of the
run, (rank_k(i), rank_k(i + L - 2**k)): that is the longest-common-prefix interval at depth L.

A line is deleted when it lies in a run of whole lines of `min_chars` characters or more (a line
counts its length plus one) that also occurs earlier, in order of (doc_id, line). It is enough to
look at the shortest such run from each line onwards and the shortest one up to each line: every
line of a maximal repeated run lies in one of those, and each of them is repeated if it is in one.

Defined results: null text counts as empty. Lines end at a line feed. Rows repeated with one doc_id
and text are one document, returned as often as it is there; of rows with one doc_id and different
texts the order is by a hash of the text. Ties go to the smallest doc_id. Extra columns are kept and
may have any name. An empty table gives an empty result. Ids of lines are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, small

KEY = ["d", "h"]


def _identity() -> tuple[Column, Column]:
    """d, the document in joins and orders (a null doc_id is the least number), and h, the hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_runs(docs: DataFrame, min_chars: int, disk: Scratch) -> DataFrame:
    """(d, h, a, n): runs of n lines from line a of a document that have an earlier copy."""
    text = F.col("text")
    lines = docs.select(*_identity(), F.posexplode(_lines(text)).alias("p", "line"))
    lines = lines.select(*KEY, "p", F.xxhash64("line").alias("id"), (F.length("line") + 1).cast("long").alias("n"))
    in_doc = Window.partitionBy(*KEY)
    lines = lines.withColumn("e", F.sum("n").over(in_doc.orderBy("p"))).withColumn("s", F.col("e") - F.col("n"))
    # lines that begin less than min_chars after this one begins, or end less than that before it ends
    lines = lines.withColumn("onward", F.count("*").over(in_doc.orderBy("s").rangeBetween(1, min_chars - 1)))
    lines = lines.withColumn("back", F.count("*").over(in_doc.orderBy("e").rangeBetween(1 - min_chars, -1)))
    lines = lines.withColumn("whole", F.max("e").over(in_doc.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    lines = disk.save(lines.select(*KEY, "p", "id", "s", "e", "onward", "back", "whole"), "lines")

    shared = disk.save(lines.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "shared")
    rank = disk.save(lines.select(*KEY, "p", "id").join(shared, "id").select(*KEY, "p", F.col("id").alias("rank")), "rank")

    forward = lines.where(F.col("whole") - F.col("s") >= min_chars).select(*KEY, F.col("p").alias("a"), (F.col("onward") + 1).alias("n"))
    backward = lines.where(F.col("e") >= min_chars).select(*KEY, (F.col("p") - F.col("back")).alias("a"), (F.col("back") + 1).alias("n"))
    runs = forward.union(backward)
    # the first line of a repeated run is shared: the others cannot be
    runs = runs.join(rank.select(*KEY, F.col("p").alias("a")), [*KEY, "a"], "left_semi").distinct()
    runs = disk.save(runs.withColumn("k", F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")), "runs")
    deepest = runs.agg(F.max("k")).first()[0] or 0

    levels = rank.withColumn("k", F.lit(0))
    for k in range(deepest):
        half = 1 << k
        ahead = F.max("rank").over(in_doc.orderBy(F.col("p").cast("long")).rangeBetween(half, half))
        pairs = rank.withColumn("next", ahead).where("next is not null")
        pairs = disk.save(pairs, "pairs")
        heads = pairs.groupBy("rank", "next").agg(F.count("*").alias("c")).where("c > 1").select("rank", "next")
        # distinct pairs in order: the id rises with the range partition and the row in it
        heads = heads.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
        heads = disk.save(heads.withColumn("new", F.monotonically_increasing_id()), "heads")
        rank = disk.save(pairs.join(heads, ["rank", "next"]).select(*KEY, "p", F.col("new").alias("rank")), "rank")
        disk.drop(pairs)
        levels = levels.union(rank.withColumn("k", F.lit(k + 1)))
        if rank.isEmpty():
            break

    first = levels.select(*KEY, "k", F.col("p").cast("long").alias("a"), F.col("rank").alias("r1"))
    last = levels.select(*KEY, "k", F.col("p").cast("long").alias("z"), F.col("rank").alias("r2"))
    placed = runs.withColumn("z", F.col("a") + F.col("n") - F.expr("shiftleft(1, k)"))
    placed = placed.join(first, [*KEY, "k", "a"]).join(last, [*KEY, "k", "z"])
    placed = disk.save(placed.select("n", "r1", "r2", *KEY, "a"), "placed")
    # an interval's least suffix is kept, the others are later copies
    at = F.struct("d", "h", "a")
    interval = placed.groupBy("n", "r1", "r2").agg(F.min(at).alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    interval = disk.save(interval, "intervals")
    return placed.join(interval, ["n", "r1", "r2"]).where(at > F.col("least")).select(*KEY, "a", "n")


def dedup(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """`docs` with `text` cut by the deleted lines, and n_lines, n_removed, emptied after its columns.

    `emptied` marks texts of which no line but blank ones is left.
    """
    disk = Scratch(docs.sparkSession, "lines")
    gone = repeated_runs(docs.select("doc_id", "text"), min_chars, disk)
    gone = gone.select(*KEY, F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("p"))
    gone = disk.save(gone.groupBy(*KEY).agg(F.collect_set(F.col("p").cast("int")).alias("gone")), "gone")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")]
    whole = "row" + "_" * max(map(len, docs.columns))  # no column has this name
    base = docs.select(F.struct("*").alias(whole), *_identity())
    # the deleted lines are sent whole only when they are few, all documents taken together
    total = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    out = base.join(small(gone, rows=total), KEY, "left")
    all_ = _lines(F.col(whole)["text"])
    keep = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("gone"))
    left = F.array_join(F.transform(keep, lambda i: F.element_at(all_, i + 1)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(whole)["text"]).otherwise(left)
    return out.select(
        *[(text if c == "text" else F.col(whole).getField(c)).alias(c) for c in names],
        F.size(all_).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        (F.col("gone").isNotNull() & ~F.coalesce(text, F.lit("")).rlike(r"\S")).alias("emptied"),
    )


#: The same rows by brute force, for DuckDB.
SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, ls, unnest(generate_series(0, len(ls) - 1)) as p from d),
c as (select doc_id, p, length(ls[p + 1]) + 1 as n, sum(length(ls[p + 1]) + 1) over (partition by doc_id order by p) as e, ls[p + 1] as line from l),
w as (
  select a.doc_id, a.p as a, min(b.p) as b from c a join c b on a.doc_id = b.doc_id and b.p >= a.p and b.e - (a.e - a.n) >= {min_chars} group by 1, 2
  union
  select b.doc_id, max(a.p) as a, b.p as b from c a join c b on a.doc_id = b.doc_id and b.p >= a.p and b.e - (a.e - a.n) >= {min_chars} group by b.doc_id, b.p),
k as (select w.doc_id, a, b, list_slice(ls, a + 1, b + 1) as run from w join d using (doc_id)),
f as (select run, min({{'doc_id': doc_id, 'a': a}}) as least from k group by run having count(*) > 1),
g as (select distinct k.doc_id, unnest(generate_series(k.a, k.b)) as p from k join f using (run) where {{'doc_id': k.doc_id, 'a': k.a}} > least)
"""

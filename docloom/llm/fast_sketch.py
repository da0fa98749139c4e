"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

`sketch` fills every coordinate in rounds. In round i < T each element goes to one hashed bin with
a hashed value; in round T + i each element goes to bin i. Values carry the round in their top
bits, so an earlier round always wins and all T coordinates are filled after 2T rounds at most. The
share of agreeing coordinates estimates the Jaccard similarity with Chernoff-type bounds.

Bands of coordinates give buckets. Every member of a bucket is verified against one pivot, never all
pairs: the member whose own buckets are fullest. In a group of near copies that is a text near the
middle of the group, and the same one in nearly all of the group's buckets, so pairs grow with the members.

What no pivot has joined is decided without loss. Two members x, y of a pivot p's star differ from p by
the sets D(x), D(y); |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so a link asks for a least overlap
of the two, and that is above 0 unless both are linked with p. An overlap of t or more leaves a
common element among the first |D| - t + 1 of either in one order (first those p lacks, which few others
hold). Members of different components meet on these elements by an equi-join, apart for pairs with
one or no member linked with p, and only where the elements that are left can still give the overlap.
So every link between two texts that share a bucket counts.

Defined results: null or blank texts have an empty set (n_shingles 0) and link with nothing. Texts
with fewer words than a shingle have one shingle, the whole sequence. Equal sets share a component.
Rows repeated with one doc_id are one document: the links of each of its texts are its links. A row
without words stays alone even so. Ties go to the smallest doc_id. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, connected_components, pick
from docloom.llm.textkernel import U, Words, lowered, mix, slices, steps

#: Bands of ROWS coordinates: at similarity 0.8 a pair is missed with (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
T = BANDS * ROWS
PAIR = ["p", "ph", "d", "h"]


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after the other, and where each text's begin."""
    words = Words(texts)
    h, out, ends = words.hash, [], [0]
    n = len(h)
    acc = np.zeros(max(n - width + 1, 0), U)
    for k in range(width):
        acc = mix(acc * U(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k] + U(k + 1)) if len(acc) else acc
    for t in range(len(texts)):
        a, b = words.at[t], words.at[t + 1]
        if b - a >= width:
            found = np.unique(acc[a : b - width + 1])
        elif b > a:
            one = np.array([b - a], U)
            for x in h[a:b]:
                one = mix(one * U(31) + x)
            found = one
        else:
            found = np.empty(0, U)
        out.append(found)
        ends.append(ends[-1] + len(found))
    return (np.concatenate(out) if out else np.empty(0, U)), np.array(ends)


def sketch(values: np.ndarray, at: np.ndarray, t: int = T) -> np.ndarray:
    """One row of t coordinates for each non-empty set values[at[i]:at[i + 1]]."""
    n = len(at) - 1
    table = np.full(n * t, U(0xFFFFFFFFFFFFFFFF))
    sizes = np.diff(at)
    open_ = sizes > 0
    owner = np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not open_.any():
                break
            live = open_[owner]
            x, who = (values, owner) if live.all() else (values[live], owner[live])
            v = mix(x ^ (U(i + 1) * U(0xD6E8FEB86659FD93)))
            bins = ((v >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
            v = mix(v + U(0x632BE59BD9B4E019))
            np.minimum.at(table, who * t + bins, (U(i) << U(54)) | (v >> U(10)))
            open_ &= (table.reshape(n, t) == U(0xFFFFFFFFFFFFFFFF)).any(axis=1)
    return table.reshape(n, t)


def band_keys(table: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    acc = np.zeros((len(table), bands), U)
    with np.errstate(over="ignore"):
        for r in range(rows):
            acc = mix(acc * U(31) + table[:, r::rows][:, :bands])
        acc = mix(acc + (np.arange(1, bands + 1, dtype=U) * U(0x2545F4914F6CDD1D)))
    return acc.view(np.int64)


def _sketched(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            values, at = shingles(lowered(part["text"]), width)
            with np.errstate(over="ignore"):
                sums = np.concatenate(([U(0)], np.cumsum(mix(values + U(0x51)))))
                more = np.concatenate(([U(0)], np.cumsum(mix(values ^ U(0xA5A5A5A5)))))
            keys = band_keys(sketch(values, at))
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "h": part["h"].to_numpy(), "n_shingles": np.diff(at),
                "set_a": (sums[at[1:]] - sums[at[:-1]]).view(np.int64), "set_b": (more[at[1:]] - more[at[:-1]]).view(np.int64), "bands": list(keys),
            })

    return run


def _sets(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            values, at = shingles(lowered(part["text"]), width)
            yield pd.DataFrame({"d": part["d"].to_numpy(), "h": part["h"].to_numpy(), "held": [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})

    return run


def _verified(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, ["held_p", "held"]):
            keep = []
            for left, right in zip(frame["held_p"], frame["held"], strict=True):
                x, y = np.frombuffer(left, U), np.frombuffer(right, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.iloc[np.flatnonzero(keep)][PAIR]

    return run


#: Roles of an element in the rest: of a member linked with the pivot, of another one against those, of another one against its like.
INSIDE, OUTSIDE, APART = 0, 1, 2


def _differences(percent: int):
    """Elements by which members differ from their pivot, as many as a link in each role leaves room for.

    `need` is (100 + percent) |D| - (100 - percent) |member|: a pair's overlap is at least the sum of
    both over 2 (100 + percent). `left` counts the elements from this one on.
    """
    full, part_ = 100 + percent, 100 - percent

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, ["held_p", "held"]):
            out = []
            for p, ph, d, h, cp, cc, left, right in frame[[*PAIR, "cp", "cc", "held_p", "held"]].itertuples(index=False):
                x, y = np.frombuffer(left, U), np.frombuffer(right, U)
                e = np.concatenate([np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)])
                need, pivot = full * len(e) - part_ * len(y), part_ * len(x)
                if need <= pivot:
                    roles = [(INSIDE, pivot + need)]
                else:
                    roles = [(APART, need + pivot)] + ([(OUTSIDE, need - pivot)] if cp != cc else [])
                for role, least in roles:
                    n = max(0, len(e) - max(1, -(-least // (2 * full))) + 1)
                    if n:
                        out.append(pd.DataFrame({
                            "p": p, "ph": ph, "d": d, "h": h, "cc": cc, "role": np.full(n, role, np.int32), "e": e[:n].view(np.int64),
                            "left": np.arange(len(e), len(e) - n, -1), "need": need,
                        }))
            if out:
                yield pd.concat(out)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document of `docs`.

    Links documents whose sets of `width`-word shingles have 100 * intersection >= percent * union.
    """
    disk = Scratch(docs.sparkSession, "minhash")
    base = pick(docs, "doc_id", "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketched = base.mapInPandas(_sketched(width), "doc_id bigint, h bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")
    sketched = disk.save(sketched, "sketch")

    # copies of one set are one class; its least document and text stand for it
    same = ["set_a", "set_b", "n_shingles"]
    filled = sketched.where("n_shingles > 0")
    classes = filled.groupBy(*same).agg(F.min(F.struct("doc_id", "h")).alias("m"), F.first("bands").alias("bands"))
    classes = disk.save(classes.select(*same, F.col("m.doc_id").alias("d"), F.col("m.h").alias("h"), "bands"), "classes")
    member = classes.select("d", "h", F.explode("bands").alias("key"))
    shared = disk.save(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = disk.save(member.join(shared, "key"), "members")
    disk.drop(shared)

    # the pivot of a bucket: of its members the one whose own buckets are fullest
    score = members.groupBy("d", "h").agg(F.sum("n").alias("score"))
    rank = F.struct("score", -F.col("d"), "h")
    pivots = members.join(score, ["d", "h"]).groupBy("key").agg(F.max_by(F.struct("d", "h"), rank).alias("m"))
    pivots = pivots.select("key", F.col("m.d").alias("p"), F.col("m.h").alias("ph"))
    star = members.join(pivots, "key").where("p <> d or ph <> h").select(*PAIR).distinct()
    star = disk.save(star, "star")

    wanted = members.select("d", "h").distinct()
    texts = base.select(F.col("doc_id").alias("d"), "h", "text").join(wanted, ["d", "h"], "left_semi").groupBy("d", "h").agg(F.min("text").alias("text"))
    sets = disk.save(texts.mapInPandas(_sets(width), "d bigint, h bigint, held binary"), "sets")
    disk.drop(members)
    pivot_sets = sets.select(F.col("d").alias("p"), F.col("h").alias("ph"), F.col("held").alias("held_p"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets, ["d", "h"]).join(pivot_sets, ["p", "ph"])
        links = both.select(*PAIR, "held_p", "held").mapInPandas(_verified(percent), "p bigint, ph bigint, d bigint, h bigint")
        return disk.save(links.select(F.col("p").alias("a"), F.col("d").alias("b")), "links")

    # a doc_id with several texts ties their classes together
    twice = filled.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).where("lo <> hi").select("doc_id")
    ties = filled.join(disk.save(twice, "twice"), "doc_id").join(classes.select(*same, "d"), same).select(F.col("doc_id").alias("a"), F.col("d").alias("b"))
    comp = disk.save(connected_components(verified(star).union(ties), disk), "components")

    # what is left: members of stars that hold several components
    at = comp.select(F.col("node").alias("d"), F.col("component").alias("cc"))
    placed = star.join(at, "d", "left").join(at.select(F.col("d").alias("p"), F.col("cc").alias("cp")), "p", "left")
    placed = disk.save(placed.select(*PAIR, F.coalesce("cp", "p").alias("cp"), F.coalesce("cc", "d").alias("cc")), "placed")
    mixed = placed.where("cp <> cc").select("p", "ph").distinct()
    rest = placed.join(mixed, ["p", "ph"], "left_semi").join(sets, ["d", "h"]).join(pivot_sets, ["p", "ph"])
    rest = rest.select(*PAIR, "cp", "cc", "held_p", "held").mapInPandas(_differences(percent), "p bigint, ph bigint, d bigint, h bigint, cc bigint, role int, e bigint, left bigint, need bigint")
    rest = disk.save(rest, "differences")
    disk.drop(placed)
    side = lambda df, to: df.select("p", "ph", "e", *[F.col(c).alias(f"{c}_{to}") for c in ("d", "h", "cc", "left", "need")])
    spot = ["p", "ph", "e"]
    enough = F.least("left_x", "left_y") * (2 * (100 + percent)) >= F.col("need_x") + F.col("need_y")
    inside, outside, apart = (rest.where(F.col("role") == r) for r in (INSIDE, OUTSIDE, APART))
    one = side(outside, "x").join(side(inside, "y"), spot).where(enough)
    # those apart from the pivot: members outside the largest component of an element meet all others there
    parts = apart.groupBy(*spot, "cc").agg(F.count("*").alias("n")).groupBy(*spot).agg(F.max_by("cc", F.struct("n", "cc")).alias("largest"), F.count("*").alias("parts"))
    apart = disk.save(apart.join(parts.where("parts > 1").drop("parts"), spot), "apart")
    both = side(apart.where("cc <> largest"), "x").join(side(apart, "y"), spot).where(enough & (F.col("cc_x") != F.col("cc_y")))
    pairs = one.select("d_x", "h_x", "d_y", "h_y").union(both.select("d_x", "h_x", "d_y", "h_y"))
    ordered = F.array_sort(F.array(F.struct(F.col("d_x").alias("d"), F.col("h_x").alias("h")), F.struct(F.col("d_y").alias("d"), F.col("h_y").alias("h"))))
    pairs = pairs.select(ordered.alias("o")).select(*[F.col("o")[i][f].alias(n) for n, i, f in (("p", 0, "d"), ("ph", 0, "h"), ("d", 1, "d"), ("h", 1, "h"))]).distinct()
    more = verified(disk.save(pairs, "pairs"))
    for done in (rest, apart, sets, star):
        disk.drop(done)
    label = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    more = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    again = connected_components(more, disk).withColumnsRenamed({"node": "c", "component": "c2"})

    # every document gets its class, and the class its component
    named = classes.select(*same, "d").join(at, "d", "left").withColumn("c", F.coalesce("cc", "d")).join(again, "c", "left")
    named = disk.save(named.select(*same, F.coalesce("c2", "c").alias("component")), "named")
    out = sketched.select("doc_id", *same).join(named, same, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))

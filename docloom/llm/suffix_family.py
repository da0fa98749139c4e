"""Suffix-array dedup with a logarithmic index family over sparse suffixes.

Every string of `length` bytes has one anchor: the leftmost of its blocks of `block` bytes with the
least hash. Equal strings have their anchor at the same place, so suffixes that begin at anchors are
enough to find all long matches; about 2 in length - block bytes begin one.

A suffix array holds the suffixes of some documents in the order of their first `block` bytes, run-length
coded: a row (key, n, lcp) for each distinct beginning, with the number of suffixes and the length of the
prefix it has in common with the row before in its range partition. A beginning that a third of all
documents share is one row. New documents come in batches. A batch's array is merge-scanned against
every existing level: both are brought into one order, and where neighbours of the two have all `block` bytes in
common, the suffixes match. Then the batch becomes a level; levels of equal size merge in that
same scan, so there are at most log2(batches) + 1 of them. `IndexFamily` keeps its levels, suffixes
and matches in a folder with a manifest, so a later session adds batches to it.

The exact check follows: matched suffixes get their context, the bytes to the left and right that the
strings of the anchor reach. Suffixes with equal context are one class
with a count. Within a match, strings of different classes are compared by (distance to the anchor, left
bytes, right bytes), in key order within partitions; matches with very many classes are compared by a
shuffle of single strings with partial sums instead. A string that begins at two places is removed
at both, on the input and not on what is left.

Defined results: null text is empty; texts below `length` bytes lose nothing. Texts are UTF-8 bytes;
matches never run over the end of a text. Repeated rows are documents of their own and match each
other, rows with null doc_id too. Ties do not arise: all copies go. Extra columns are ignored; an empty
table gives an empty result. Matched beginnings and strings are joined by 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, delete, pick
from docloom.llm.textkernel import U, mix, powers, prefix, steps

#: Bytes of a piece of text that is worked on at once; pieces overlap by length - 1 bytes.
PIECE = 1 << 20
#: Classes of a match beyond which its strings are compared by a shuffle; below, one task holds some 500 bytes for each.
CROWD = 8192
KEY = ["g", "h"]


def identity(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of the text, by which rows are joined: equal texts lose the same bytes."""
    text = F.coalesce("text", F.lit(""))
    return pick(docs, "doc_id", "text").withColumns({"g": F.xxhash64(F.lit(1), text), "h": F.xxhash64(text)})


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values (block-wise prefix and suffix minima)."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, U)
    full[: len(x)] = x
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int, block: int) -> tuple[np.ndarray, ...]:
    """(position, least and largest distance of a string's begin to it) of a piece's anchors."""
    w = length - block + 1
    none = (np.empty(0, np.int64),) * 3
    if len(data) < length:
        return none
    sums = prefix(data)
    n = len(data) - block + 1
    h = mix((sums[block:] - sums[:n]) * powers("down", n))
    place = np.arange(n, dtype=U)
    least = window_min((h & U(0xFFFFFFFFFF000000)) | place, w)
    at = (least & U(0xFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ends = np.concatenate((begins[1:], [len(at)])) - 1
    a = at[begins]
    return a, a - ends, a - begins


def pieces(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer(text, np.uint8)
    for lo in range(0, max(len(data) - length + 1, 1), PIECE):
        yield lo, data[lo : lo + PIECE + length - 1]


def _suffixes(length: int, block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            out, row = [], []
            for i, text in enumerate(part["text"]):
                for lo, data in pieces(raw(text), length):
                    a, near, far = anchors(data, length, block)
                    heads = np.lib.stride_tricks.sliding_window_view(data, block)[a].tobytes() if len(a) else b""
                    out.append((a + lo, near, far, [heads[k : k + block] for k in range(0, len(heads), block)]))
                    row.append(np.full(len(a), i))
            row = np.concatenate(row)
            a, near, far = (np.concatenate(x) for x in list(zip(*out, strict=True))[:3])
            yield pd.DataFrame({
                "key": [k for x in out for k in x[3]], "g": part["g"].to_numpy()[row], "h": part["h"].to_numpy()[row],
                "pos": a, "near": near.astype(np.int32), "far": far.astype(np.int32),
            })

    return run


def _scan(block: int):
    """Merges sorted rows (key, n, side): one row for each key, its prefix in common with the row before, and whether both sides have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(x: pa.Array) -> np.ndarray:
            at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            return np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, block)

        def rows(keys, n, side, before):
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            one = keys[first]
            same = one == np.concatenate([before if before is not None else one[:1], one[:-1]])
            lcp = np.where(same.all(axis=1), block, same.argmin(axis=1))
            if before is None:
                lcp[0] = 0
            met = np.maximum.reduceat(side, first) > np.minimum.reduceat(side, first)
            heads = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.arange(0, one.size + 1, block, dtype=np.int32)), pa.py_buffer(one.tobytes())])
            return one[-1:], pa.RecordBatch.from_arrays([heads, pa.array(np.add.reduceat(n, first)), pa.array(lcp.astype(np.int32)), pa.array(met)], ["key", "n", "lcp", "met"])

        held, before = None, None
        for batch in batches:
            if not len(batch):
                continue
            new = (flat(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy())
            keys, n, side = new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1  # the last key may go on
            held = keys[last:], n[last:], side[last:]
            if last:
                before, out = rows(keys[:last], n[:last], side[:last], before)
                yield out
        if held is not None:
            yield rows(*held, before)[1]

    return run


class IndexFamily:
    """Suffix-array levels of growing sizes in a folder that all executors share.

    An instance opens what the folder holds; `add` takes a batch of documents. `sizes` are distinct
    powers of two batches. A batch whose `add` failed leaves no trace in the manifest.
    """

    def __init__(self, spark: SparkSession, base: str, length: int = 400, block: int = 64):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.store = self.path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = {"version": 0, "length": length, "block": block, "levels": [], "suffixes": [], "met": []}
        if self.store.exists(self.path(f"{self.base}/manifests")):
            newest = max(str(f.getPath().getName()) for f in self.store.listStatus(self.path(f"{self.base}/manifests")))
            self.state = json.loads(spark.read.text(f"{self.base}/manifests/{newest}", wholetext=True).first()[0])

    @property
    def sizes(self) -> list[int]:
        return [size for size, _ in self.state["levels"]]

    def _commit(self, state: dict) -> None:
        """The next manifest appears whole, by a rename."""
        state["version"] = self.state["version"] + 1
        draft, final = (self.path(f"{self.base}/{x}") for x in (f"draft-{uuid.uuid4().hex}", f"manifests/{state['version']:012d}.json"))
        self.store.mkdirs(final.getParent())
        out = self.store.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.store.rename(draft, final):
            raise OSError(f"another writer has added batch {state['version']}")
        self.state = state

    def _save(self, df: DataFrame, name: str) -> str:
        path = f"{self.base}/tables/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _merged(self, array: DataFrame, level: DataFrame | None) -> DataFrame:
        """Array and level in one order of beginnings, met where neighbours of both are the same."""
        both = array.select("key", "n", F.lit(0).alias("side"))
        both = both if level is None else both.union(level.select("key", "n", F.lit(1).alias("side")))
        both = both.repartitionByRange("key").sortWithinPartitions("key", "side")
        return both.mapInArrow(_scan(self.state["block"]), "key binary, n bigint, lcp int, met boolean")

    def add(self, docs: DataFrame) -> None:
        """Adds a batch: its array is scanned against all levels, then equal-sized levels merge."""
        read, state, done = self.spark.read.parquet, json.loads(json.dumps(self.state)), []
        kinds = "key binary, g bigint, h bigint, pos bigint, near int, far int"
        suffixes = identity(docs).select("g", "h", "text").mapInPandas(_suffixes(state["length"], state["block"]), kinds)
        state["suffixes"].append(self._save(suffixes, "suffixes"))
        own = self._save(self._merged(read(state["suffixes"][-1]).groupBy("key").agg(F.count("*").alias("n")), None), "level")
        met = read(own).where("n > 1").select("key")
        array, size = own, 1
        for other, level in reversed(state["levels"]):
            if other == size:  # the merge and its scan are one pass
                done += [array, level] if array != own else [level]
                array, size = self._save(self._merged(read(array), read(level)), "level"), 2 * size
                met = met.union(read(array).where("met").select("key"))
            else:
                met = met.union(self._merged(read(own), read(level)).where("met").select("key"))
        state["met"].append(self._save(met.select(F.xxhash64("key").alias("k")).distinct(), "met"))
        state["levels"] = [x for x in state["levels"] if x[1] not in done] + [[size, array]]
        self._commit(state)
        for path in done + ([own] if own != array else []):
            delete(path)

    def matched(self) -> DataFrame:
        """(k, g, h, pos, near, far): suffixes whose beginning another suffix of any batch has."""
        read = self.spark.read.parquet
        if not self.state["suffixes"]:
            return self.spark.createDataFrame([], "k bigint, g bigint, h bigint, pos bigint, near int, far int")
        suffixes = read(*self.state["suffixes"]).select(F.xxhash64("key").alias("k"), *KEY, "pos", "near", "far")
        return suffixes.join(read(*self.state["met"]).distinct(), "k")

    def drop(self) -> None:
        delete(self.base)


def strings(part: pd.DataFrame, length: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance to the anchor, fingerprint) of all strings of some suffixes with context."""
    near, far = part["near"].to_numpy(np.int64), part["far"].to_numpy(np.int64)
    count = far - near + 1
    row = np.repeat(np.arange(len(part)), count)
    o = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    texts = [a + b for a, b in zip(part["left"], part["right"], strict=True)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    sums = prefix(np.frombuffer(b"".join(texts), np.uint8))
    middle = begin[row] + far[row]
    s = middle - o
    h = (sums[s + length - block] - sums[s]) * powers("down", len(sums))[s]
    return row, o, mix(mix(h) ^ part["k"].to_numpy(np.int64).view(U)[row] + o.astype(U) * U(0x9E3779B97F4A7C15))


def intervals(row: np.ndarray, o: np.ndarray, n: int) -> list[list[int]]:
    """For each row the maximal runs of distances, flattened: [first, last, first, last, ...]."""
    out: list[list[int]] = [[] for _ in range(n)]
    if len(row):
        cut = np.flatnonzero((row[1:] != row[:-1]) | (o[1:] != o[:-1] + 1)) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(row)])), strict=True):
            out[row[a]] += [int(o[a]), int(o[b - 1])]
    return out


def spans(docs: DataFrame, family: IndexFamily, disk: Scratch) -> DataFrame:
    """(g, h, places) of the texts of `docs`, all documents of the family: begins and ends of removed bytes, unmerged and flattened.

    Equal texts are worked on once and count as often as they are there. A match that has its anchor in
    the middle shares half of the other bytes on one side of the anchor's block at least: with the
    block these bytes are what suffixes are grouped by, once for each side.
    """
    length, block = family.state["length"], family.state["block"]
    half = (length - block + 1) // 2
    places = family.matched().groupBy(*KEY).agg(F.collect_set(F.struct("pos", "near", "far", "k")).alias("at"))
    texts = identity(docs).groupBy(*KEY).agg(F.min("text").alias("text"), F.count("*").alias("m"))
    # no broadcast here: the places grow with the input
    here = texts.join(places.hint("shuffle_merge"), KEY)

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames, step=1 << 18):
            rows = []
            for g, h, text, m, at in part[["g", "h", "text", "m", "at"]].itertuples(index=False):
                data = raw(text)
                for x in at:
                    p = x["pos"]
                    for side, near, far in ((0, x["near"], min(x["far"], half - 1)), (1, max(x["near"], half), x["far"])):
                        if near <= far:
                            left, right = data[p - far : p], data[p + block : p - near + length]
                            shared = left[-half:] if side else right[: length - block - half + 1]
                            rows.append((x["k"], side, shared, near, far, g, h, p, m, left, right))
            yield pd.DataFrame(rows, columns=["k", "side", "shared", "near", "far", "g", "h", "pos", "m", "left", "right"])

    rich = here.mapInPandas(contexts, "k bigint, side int, shared binary, near int, far int, g bigint, h bigint, pos bigint, m bigint, left binary, right binary")
    rich = rich.withColumn("k", F.xxhash64("k", "side", "shared")).drop("side", "shared")
    rich = disk.save(rich.withColumn("c", F.xxhash64("left", "right")), "contexts")
    klass = ["k", "near", "far", "c"]
    classes = disk.save(rich.groupBy(*klass).agg(F.sum("m").alias("n"), F.min("left").alias("left"), F.min("right").alias("right")), "classes")
    crowd = disk.save(classes.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "crowds")
    several = classes.join(crowd, "k")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def judged(part: pd.DataFrame) -> pd.DataFrame:
            row, o, f = strings(part, length, block)
            _, which = np.unique(f, return_inverse=True)
            twice = np.bincount(which, part["n"].to_numpy(float)[row])[which] > 1.5
            return part[klass].assign(runs=intervals(row[twice], o[twice], len(part)))

        held: list[pd.DataFrame] = []
        for frame in frames:
            for lo in range(0, len(frame), 2048):
                part = frame.iloc[lo : lo + 2048]
                last = part["k"].iloc[-1]
                done = part["k"] != last
                if done.any():
                    yield judged(pd.concat([*held, part[done]]))
                    held = [part[~done]]
                else:
                    held.append(part)
        if held:
            yield judged(pd.concat(held))

    def single(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 2048):
                part = frame.iloc[lo : lo + 2048]
                row, o, f = strings(part, length, block)
                yield part.iloc[row][[*klass, "n"]].assign(o=o.astype(np.int32), f=f.view(np.int64))

    kinds = "k bigint, near int, far int, c bigint"
    few = several.where(F.col("m") <= CROWD).repartition("k").sortWithinPartitions("k").select(*klass, "n", "left", "right")
    few = few.mapInPandas(local, f"{kinds}, runs array<int>")
    many = several.where(F.col("m") > CROWD).select(*klass, "n", "left", "right").mapInPandas(single, f"{kinds}, n bigint, o int, f bigint")
    many_ = disk.save(many, "strings")
    twice = disk.save(many_.groupBy("f").agg(F.sum("n").alias("t")).where("t > 1").select("f"), "twice")
    many = many_.join(twice, "f").select(*klass, F.array("o", "o").alias("runs"))
    lone = classes.join(crowd, "k", "left_anti").where("n > 1").select(*klass, F.array("near", "far").alias("runs"))
    runs = few.where(F.size("runs") > 0).union(many).union(lone)
    runs = disk.save(runs.groupBy(*klass).agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    for done in (classes, crowd, many_, twice):
        disk.drop(done)
    found = rich.select(*klass, *KEY, "pos").join(runs, klass)
    # a run of distances [a, b] to the anchor is the strings that begin in [pos - b, pos - a]
    at = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), lambda i: F.array(F.col("pos") - F.element_at("runs", i + 2), F.col("pos") - F.element_at("runs", i + 1) + length))
    found = found.select(*KEY, F.flatten(at).alias("places")).groupBy(*KEY).agg(F.flatten(F.collect_list("places")).alias("places"))
    found = disk.save(found, "places")
    disk.drop(rich)
    disk.drop(runs)
    return found


def merged(places: np.ndarray) -> np.ndarray:
    """Maximal disjoint spans, one row each, of flattened begins and ends."""
    both = places.reshape(-1, 2)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    first = np.flatnonzero(np.concatenate(([True], both[1:, 0] > reach[:-1])))
    return np.stack([both[first, 0], reach[np.concatenate((first[1:], [len(both)])) - 1]], 1)


def removed(docs: DataFrame, family: IndexFamily, disk: Scratch, more=None, kinds: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for every row of `docs`, all documents of the family.

    spans: array<struct<start, end>> of bytes; kept: the other bytes, as binary.
    """
    more, kinds = more or _whole, kinds or "spans array<struct<start: bigint, end: bigint>>, kept binary"
    here = identity(docs).join(spans(docs, family, disk).hint("shuffle_merge"), KEY, "left").select("doc_id", "text", "places")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            rows = []
            for doc, text, places in part[["doc_id", "text", "places"]].itertuples(index=False):
                data = raw(text)
                cut = merged(np.asarray(places, np.int64)) if places is not None and len(places) else np.empty((0, 2), np.int64)
                at = np.concatenate(([0], cut.ravel(), [len(data)])).reshape(-1, 2)
                kept = b"".join(data[a:b] for a, b in at.tolist())
                rows.append({"doc_id": doc, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(cut)} | more(cut, kept))
            out = pd.DataFrame(rows)
            yield out.assign(doc_id=pd.array(out["doc_id"], "Int64"))

    return here.mapInPandas(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {kinds}")


def _whole(cut: np.ndarray, kept: bytes) -> dict:
    return {"spans": [{"start": a, "end": b} for a, b in cut.tolist()], "kept": kept}


def _digest(cut: np.ndarray, kept: bytes) -> dict:
    return {"kept_sha256": hashlib.sha256(kept).hexdigest(), "n_kept": len(kept), "text": kept.decode("utf-8", "replace")}


def _at_once(docs: DataFrame, length: int, batches: int, more, kinds) -> DataFrame:
    """A family of its own for one table, which comes in `batches` by a hash of the text."""
    disk = Scratch(docs.sparkSession, "suffix")
    family = IndexFamily(docs.sparkSession, f"{disk.base}/family", length, min(64, max(1, length // 2)))
    base = pick(docs, "doc_id", "text")
    for b in range(batches):
        family.add(base.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == b))
    return removed(base, family, disk, more, kinds)


def dedup(docs: DataFrame, length: int = 400, batches: int = 2) -> DataFrame:
    """`removed` for a table that stands alone."""
    return _at_once(docs, length, batches, None, None)


def report(docs: DataFrame, length: int = 400, batches: int = 2) -> DataFrame:
    """As `dedup`, with the digest and number of the kept bytes in place of spans, and the kept bytes as text."""
    return _at_once(docs, length, batches, _digest, "kept_sha256 string, n_kept bigint, text string")

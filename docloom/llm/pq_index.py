"""Embedding near-duplicates by product quantisation.

Coarse inverted lists (k-means) hold residual subspace codes with the length of each code's error.
Every class of equal vectors probes each list that can hold a vector within the threshold of it: the
list's centre is within threshold + radius, and the vector is no further than the threshold beyond the
bisector of its own centre and the list's. Asymmetric table look-ups give the distance
from the exact query to a coded member, and since that differs from the true distance by at most
the member's error, members further than threshold + error are dropped without loss. Survivors
are reranked by exact cosine in double precision. A pair is looked for in the list of the higher
number (in one list: from the smaller id) and counted once. No step loses a pair.

Quantisers are fitted on a bounded sample (`sample` vectors); every vector is indexed. Lists are put
together in groups, and groups that hold or are probed by many vectors are cut into cells of bounded
size, all of which are worked through. A cell returns sums of links and a spanning forest, never its
pairs. Where lists are wide against the threshold (vectors without near ones, in many dimensions), nearly
all lists are probed, and the work grows with the square of the rows.

Vectors of different lengths are not compared. Each length with more than MEMBERS distinct vectors has an
index of its own; those of a rarer length are few enough for one task, which fits and searches an index for them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing. Equal vectors are linked. Repeated ids are taken as separate rows with one node. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, connected_components, pick

MEMBERS, ASKERS = 4096, 8192
BLOCK = 256
CODES = 64


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre, 1)[0][:, 0]
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The p nearest centres of each row, nearest first, and their squared distances."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None]
    p = min(p, len(centre))
    best = np.argpartition(d, p - 1, axis=1)[:, :p] if p < len(centre) else np.tile(np.arange(p), (len(x), 1))
    got = np.take_along_axis(d, best, 1)
    order = np.argsort(got, axis=1, kind="stable")
    return np.take_along_axis(best, order, 1), np.take_along_axis(got, order, 1)


def vectors_of(column: pd.Series, kind: np.dtype) -> np.ndarray:
    """Unit vectors in double precision of raw ones packed as bytes."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclass
class Quantiser:
    coarse: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # one (codes, width) for each subspace
    cuts: np.ndarray  # where each subspace begins
    probes: int

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, miss = np.zeros((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for j, book in enumerate(self.books):
            part = residual[:, self.cuts[j] : self.cuts[j + 1]]
            near = nearest(part, book, 1)[0][:, 0]
            code[:, j] = near
            miss += ((part - book[near]) ** 2).sum(1)
        return code, np.sqrt(miss)

    def needed(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of `lists` can hold a vector within `reach` of each row, and its centre's squared distance."""
        own, there = self.coarse[home], self.coarse[lists]
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ there.T + (there * there).sum(1)[None], 0)
        near = ((x - own) ** 2).sum(1)[:, None]
        apart = np.sqrt(np.maximum((own * own).sum(1)[:, None] - 2 * own @ there.T + (there * there).sum(1)[None], 0))
        inside = np.sqrt(d) <= reach + np.minimum(radius[lists][None], np.sqrt(near) + reach) + 1e-6
        return inside & (d - near <= 2 * reach * apart + 1e-6), d

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([book[code[:, j]] for j, book in enumerate(self.books)], axis=1)

    def products(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Inner products of coded residuals with exact queries by table look-up: a row for each code."""
        out = np.zeros((len(code), len(x)))
        for j, book in enumerate(self.books):
            out += (book @ x[:, self.cuts[j] : self.cuts[j + 1]].T)[code[:, j]]
        return out


def fit(x: np.ndarray, total: int, probes: int, subspaces: int = 8, seed: int = 3) -> Quantiser:
    lists = int(np.clip(2 * np.sqrt(total), 1, min(4096, max(1, len(x) // 4))))
    coarse = kmeans(x, lists, 8, seed)
    rest = x - coarse[nearest(x, coarse, 1)[0][:, 0]]
    cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
    books = [kmeans(rest[:, a:b], CODES, 8, seed + 1 + a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Quantiser(coarse, books, cuts, min(probes, len(coarse)))


def join(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """`label` (the least node of each node's component) after the links (p, q)."""
    while True:
        a, b = label[p], label[q]
        open_ = a != b
        if not open_.any():
            return label
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def coded(v: np.ndarray, quantiser: Quantiser) -> dict:
    """Home list, distance to its centre, code, and the code's error of unit vectors."""
    home = nearest(v, quantiser.coarse, 1)[0][:, 0]
    rest = v - quantiser.coarse[home]
    code, miss = quantiser.encode(rest)
    return {"home": home.astype(np.int32), "far": np.sqrt((rest * rest).sum(1)), "code": [c.tobytes() for c in code], "miss": miss}


def search(there: pd.DataFrame, here: pd.DataFrame, kind: np.dtype, quantiser: Quantiser, radius: np.ndarray, reach: float, cosine: float) -> pd.DataFrame:
    """Links between the members `there` and the askers `here` as (a, links, to): sums, and a spanning forest with 0 links."""
    # sorted by list, so that a block of askers needs few lists where the vectors have groups
    there, here = there.sort_values(["home", "a"]), here.sort_values(["home", "a"])
    if not len(there) or not len(here):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})
    x, q = vectors_of(there["v"], kind), vectors_of(here["v"], kind)
    code = np.frombuffer(b"".join(there["code"]), np.uint8).reshape(len(there), -1)
    xa, qa, xh, qh = there["a"].to_numpy(), here["a"].to_numpy(), there["home"].to_numpy(), here["home"].to_numpy()
    xn, qn = there["n"].to_numpy(float), here["n"].to_numpy(float)
    lists, at = np.unique(xh, return_inverse=True)
    # |query - (centre + code)|^2 = |query - centre|^2 + rest - 2 * product of the query with the code
    part = quantiser.decode(code)
    rest = (part * part).sum(1) + 2 * (quantiser.coarse[xh] * part).sum(1)
    limit = (there["miss"].to_numpy(float) + reach) ** 2 + 1e-6
    nodes, spots = np.unique(np.concatenate([qa, xa]), return_inverse=True)
    qs, xs, label, links = spots[: len(qa)], spots[len(qa) :], np.arange(len(nodes)), np.zeros(len(nodes))
    for lo in range(0, len(q), BLOCK):
        s = slice(lo, lo + BLOCK)
        need, d = quantiser.needed(q[s], qh[s], lists, radius, reach)
        need &= lists[None] >= qh[s][:, None]
        c = np.flatnonzero(need.any(0)[at])
        if not len(c):
            continue
        near = d.T[at[c]] + rest[c][:, None] - 2 * quantiser.products(q[s], code[c]) <= limit[c][:, None]
        near &= need.T[at[c]] & ((xh[c][:, None] > qh[s][None]) | (xa[c][:, None] > qa[s][None]))
        row = np.flatnonzero(near.any(1))
        near, c = near[row], c[row]
        dot = x[c] @ q[s].T
        j, i = np.nonzero(near & (dot >= cosine - 1e-9))
        # products so close to the threshold that the order of the sum counts are taken pair by pair
        tight = np.flatnonzero(dot[j, i] < cosine + 1e-9)
        good = np.ones(len(j), bool)
        good[tight] = np.einsum("ij,ij->i", q[lo + i[tight]], x[c[j[tight]]]) >= cosine
        i, j = lo + i[good], c[j[good]]
        links += np.bincount(qs[i], xn[j], len(nodes)) + np.bincount(xs[j], qn[i], len(nodes))
        label = join(label, qs[i], xs[j])
    some = links > 0
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    sums = pd.DataFrame({"a": nodes[some], "links": links[some].astype(np.int64), "to": nodes[some]})
    return pd.concat([sums, pd.DataFrame({"a": nodes[moved], "links": 0, "to": nodes[label[moved]]})])


FOUND = "a bigint, links bigint, to bigint"


def _indexed(classes: DataFrame, total: int, kind: np.dtype, cosine: float, reach: float, probes: int, sample: int, disk: Scratch) -> DataFrame:
    """Links between all classes (k1, k2, a, n, v) of one length."""
    spark = classes.sparkSession
    # about `sample` of them, at random by their hash, and 2 * sample at the most
    taken = classes.where(F.pmod("k1", F.lit(1_000_000)) < max(min(1.0, sample / total) * 1_000_000, 1)).orderBy("k1", "k2").limit(2 * sample).select("v").toPandas()
    if not len(taken):
        taken = classes.orderBy("k1", "k2").limit(sample).select("v").toPandas()
    quantiser = fit(vectors_of(taken["v"], kind), total, probes)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                yield part.assign(**coded(vectors_of(part["v"], kind), quantiser))

    indexed = classes.select("a", "n", "v").mapInPandas(index, "a bigint, n bigint, v binary, home int, far double, code binary, miss double")
    indexed = disk.save(indexed, "index")

    # lists of consecutive numbers form groups of about MEMBERS vectors
    radius, held, group = np.full(len(quantiser.coarse), -np.inf), [0], np.zeros(len(quantiser.coarse), int)
    for home, n, far in sorted(tuple(r) for r in indexed.groupBy("home").agg(F.count("*"), F.max("far")).collect()):
        if held[-1] and held[-1] + n > MEMBERS:
            held.append(0)
        radius[home], group[home] = far, len(held) - 1
        held[-1] += n
    filled = np.flatnonzero(np.isfinite(radius))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                v, home = vectors_of(part["v"], kind), part["home"].to_numpy()
                probe = quantiser.needed(v, home, filled, radius, reach)[0]
                np.put_along_axis(probe, nearest(v, quantiser.coarse[filled], quantiser.probes)[0], True, 1)  # as the least
                probe &= filled[None] >= home[:, None]
                to = [np.unique(group[filled[row]]).astype(np.int32) for row in probe]
                yield part.assign(to=to)

    asking = indexed.select("a", "n", "home", "v").mapInPandas(ask, "a bigint, n bigint, home int, v binary, to array<int>").select("a", "n", "home", "v", F.explode("to").alias("group"))
    asked = {r[0]: r[1] for r in asking.groupBy("group").count().collect()}

    # cells of bounded size; one row for each group
    cut = lambda n, by: int(-(-n // by))
    grid = [(g, cut(n, MEMBERS), cut(asked.get(g, 0), ASKERS)) for g, n in enumerate(held)]
    grid = F.broadcast(spark.createDataFrame(grid, "group int, ms int, qs int"))  # at most 4096 groups
    of = F.broadcast(spark.createDataFrame([(int(k), int(group[k])) for k in filled], "home int, group int"))
    spot = F.pmod(F.xxhash64("a"), F.lit(1 << 40))
    member = indexed.join(of, "home").join(grid, "group").where("qs > 0").select(
        F.lit(0).alias("role"), "group", F.pmod(spot, F.col("ms")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "a", "n", "home", "code", "miss", "v")
    asker = asking.join(grid, "group").select(
        F.lit(1).alias("role"), "group", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("m"), F.pmod(spot, F.col("qs")).cast("int").alias("q"), "a", "n", "home",
        F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("miss"), "v")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        return search(frame[frame["role"] == 0], frame[frame["role"] == 1], kind, quantiser, radius, reach, cosine)

    found = disk.save(member.unionByName(asker).groupBy("group", "m", "q").applyInPandas(cell, FOUND), "found")
    disk.drop(indexed)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, probes: int = 32, sample: int = 12_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding)."""
    disk = Scratch(vectors.sparkSession, "pq")
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    raw = pick(vectors, "vec_id", "embedding")
    kind = np.dtype(np.float32 if raw.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64)
    x = F.col("embedding")
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    # a norm that underflows to zero or overflows in double precision has no cosine
    norm = F.aggregate(F.coalesce(x, F.array().cast("array<float>")), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    fine = finite & (F.size(x) > 0) & (norm > 0) & (norm < float("inf"))
    rows = raw.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(7), F.reverse("embedding")))
    classes = rows.where("fine").groupBy("k1", "k2").agg(F.min("vec_id").alias("a"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="embedding").assign(v=[np.asarray(v, kind).tobytes() for v in frame["embedding"]])

    classes = classes.withColumn("dim", F.size("embedding")).mapInPandas(packed, "k1 bigint, k2 bigint, a bigint, n bigint, dim int, v binary")
    classes = disk.save(classes, "classes")
    # each has more than MEMBERS vectors, so there are few
    large = {r[0]: r[1] for r in classes.groupBy("dim").count().where(F.col("count") > MEMBERS).collect()}

    def rare(frame: pd.DataFrame) -> pd.DataFrame:
        v = vectors_of(frame["v"], kind)
        quantiser = fit(v, len(v), probes)
        both = frame.assign(**coded(v, quantiser))
        radius = both.groupby("home")["far"].max().reindex(range(len(quantiser.coarse)), fill_value=-np.inf).to_numpy()
        return search(both, both, kind, quantiser, radius, reach, cosine)

    found = classes.where(~F.col("dim").isin(list(large))).select("dim", "a", "n", "v").groupBy("dim").applyInPandas(rare, FOUND)
    found = disk.save(found, "rare")
    for dim, total in sorted(large.items()):
        found = found.union(_indexed(classes.where(F.col("dim") == dim), total, kind, cosine, reach, probes, sample, disk))
    comp = connected_components(found.where("links = 0").select("a", F.col("to").alias("b")), disk)
    sums = found.groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("k1", "k2", "a", "n").join(sums, "a", "left").join(comp.withColumnRenamed("node", "a"), "a", "left")
    named = disk.save(named.select("k1", "k2", F.lit(True).alias("fine"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "a").alias("component")), "named")
    disk.drop(classes)
    out = rows.select("vec_id", "k1", "k2", "fine").join(named, ["k1", "k2", "fine"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

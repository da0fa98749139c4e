"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), which is
linear in the number of distinct features of a text. Features: distinct lower-cased words hashed to
WORD_BUCKETS values, weighted by 1 + log of their count and scaled to unit length; structure
statistics (shares of byte classes, word and line shape, repetition), each in one of BINS quantile
bins; the n_chars metadata in bins, and whether it disagrees with the text. The model is fitted by
AdaGrad on about `sample` labelled rows chosen by a hash of doc_id.

Defined results: null text counts as empty; empty texts get a score like any other. Rows with null
labels teach nothing; no labelled row at all gives 0.5 for every text. A null n_chars has a bin of
its own. Repeated rows are scored one by one; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pick, small
from docloom.llm.textkernel import U, Words, lowered, steps

WORD_BUCKETS = 1 << 15
BINS = 12
FACTORS = 6
CLASSES = np.zeros(256, np.int8)
CLASSES[ord("A") : ord("Z") + 1] = 1
CLASSES[ord("0") : ord("9") + 1] = 2
CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
CLASSES[10] = 4
CLASSES[[32, 9, 11, 12, 13]] = 5
CLASSES[128:] = 6
STATS = ("upper", "digit", "punct", "lines", "space", "wide", "words", "word_len", "distinct", "repeat", "ends_punct", "bytes", "n_chars", "n_chars_off")
DIM = WORD_BUCKETS + len(STATS) * (BINS + 1)


def features(texts: list[str | None], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features (bucket, value, where each text's begin) and the statistics of each text."""
    lower = lowered(pd.Series(texts, dtype=object))
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = Words(lower)
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    kind, at, n = CLASSES[raw], words.text_at, np.maximum(np.diff(words.text_at) - 1, 1)
    stats = np.zeros((len(texts), len(STATS)))
    for c in range(1, 7):
        sums = np.concatenate(([0], np.cumsum(kind == c)))
        stats[:, c - 1] = (sums[at[1:]] - sums[at[:-1]]) / n
    count = np.maximum(words.count, 1)
    stats[:, 6] = np.log1p(words.count)
    stats[:, 7] = n / count
    bucket = (words.hash >> U(40)).astype(np.int64) % WORD_BUCKETS
    keys, tf = np.unique(words.text * WORD_BUCKETS + bucket, return_counts=True)
    owner = keys // WORD_BUCKETS
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    stats[:, 8] = np.diff(begins) / count
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    stats[:, 9] = np.bincount(words.text[same], minlength=len(texts)) / count
    last = kind[np.maximum(words.end - 1, 0)] == 3 if len(words.end) else np.empty(0, bool)
    stats[:, 10] = np.bincount(words.text[last], minlength=len(texts)) / count
    stats[:, 11] = np.log1p(n)
    size = np.array([len(t or "") for t in texts])
    stats[:, 12] = np.log1p(np.maximum(n_chars, 0))
    stats[:, 13] = np.abs(n_chars - size)
    value = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=len(texts)))
    return keys % WORD_BUCKETS, value / np.maximum(norm[owner], 1e-9), begins, stats


@dataclass
class Model:
    edges: np.ndarray  # (statistics, BINS - 1) upper ends of the bins
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def rows_of(edges: np.ndarray, bucket: np.ndarray, value: np.ndarray, begins: np.ndarray, stats: np.ndarray):
    """Sparse rows (index, value, where each begins): words, then one bin for each statistic."""
    n, s = stats.shape
    bins = np.stack([np.where(np.isnan(stats[:, j]), BINS, np.searchsorted(edges[j], stats[:, j])) for j in range(s)], 1) if n else np.zeros((0, s), int)
    index, val = np.empty(len(bucket) + n * s, np.int64), np.ones(len(bucket) + n * s)
    ptr = begins + np.arange(n + 1) * s
    spot = np.repeat(ptr[:-1], np.diff(begins)) + np.arange(len(bucket)) - np.repeat(begins[:-1], np.diff(begins))
    index[spot], val[spot] = bucket, value
    tail = (ptr[1:, None] - s + np.arange(s)).ravel()
    index[tail] = (WORD_BUCKETS + np.arange(s) * (BINS + 1) + bins).ravel()
    val[tail] = 0.5
    return index, val, ptr


def raw_score(model: Model, index: np.ndarray, val: np.ndarray, ptr: np.ndarray):
    """The sum-of-squares identity; also the sums over factors, for the gradient."""
    if len(ptr) < 2:
        return np.empty(0), np.empty((0, FACTORS))
    vx = model.factor[index] * val[:, None]
    sums = np.add.reduceat(vx, ptr[:-1], axis=0)
    squares = np.add.reduceat(vx * vx, ptr[:-1], axis=0)
    linear = np.add.reduceat(model.weight[index] * val, ptr[:-1])
    return model.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(parts: list[tuple], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.08) -> Model:
    stats = np.stack([p[2] for p in parts])
    edges = np.stack([np.quantile(c[~np.isnan(c)], np.linspace(0, 1, BINS + 1)[1:-1]) if (~np.isnan(c)).any() else np.zeros(BINS - 1) for c in stats.T])
    rng = np.random.default_rng(11)
    base = np.clip(labels.mean(), 0.01, 0.99)
    model = Model(edges, float(np.log(base / (1 - base))), np.zeros(DIM), rng.normal(0, 0.02, (DIM, FACTORS)))
    if len(set(labels.tolist())) < 2:
        return model
    seen_w, seen_v, seen_b = np.full(DIM, 1e-3), np.full((DIM, FACTORS), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            begins = np.concatenate(([0], np.cumsum([len(parts[i][0]) for i in rows])))
            index, val, ptr = rows_of(edges, np.concatenate([parts[i][0] for i in rows]), np.concatenate([parts[i][1] for i in rows]), begins, stats[rows])
            z, sums = raw_score(model, index, val, ptr)
            err = sigmoid(z) - labels[rows]
            owner = np.repeat(np.arange(len(rows)), np.diff(ptr))
            near, where = np.unique(index, return_inverse=True)
            e = err[owner] / len(rows)
            gw = np.bincount(where, e * val) + 1e-5 * model.weight[near]
            vx = model.factor[index] * val[:, None]
            gv = np.zeros((len(near), FACTORS))
            np.add.at(gv, where, (e * val)[:, None] * (sums[owner] - vx))
            gv += 1e-5 * model.factor[near]
            seen_w[near] += gw * gw
            seen_v[near] += gv * gv
            seen_b += err.mean() ** 2
            model.weight[near] -= rate * gw / np.sqrt(seen_w[near])
            model.factor[near] -= rate * gv / np.sqrt(seen_v[near])
            model.bias -= rate * err.mean() / np.sqrt(seen_b)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model | None:
    """`docs` (doc_id, text, n_chars) and `labels` (doc_id, quality): about `sample` rows are used."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1)))
    joined = pick(docs, "doc_id", "text", "n_chars").join(small(chosen), "doc_id")

    def feature(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            bucket, value, begins, stats = features(list(part["text"]), part["n_chars"].astype(float).to_numpy())
            cut = lambda a, i: a[begins[i] : begins[i + 1]].tobytes()
            yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "i": [cut(bucket, i) for i in range(len(part))], "v": [cut(value, i) for i in range(len(part))], "s": [r.tobytes() for r in stats]})

    got = sorted(joined.mapInPandas(feature, "doc_id bigint, quality int, i binary, v binary, s binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    if not got:
        return None
    parts = [(np.frombuffer(bytes(r[2]), np.int64), np.frombuffer(bytes(r[3])), np.frombuffer(bytes(r[4]))) for r in got]
    return fit(parts, np.array([float(r[1] == 1) for r in got]))


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """(doc_id, score[, keep...]) for every row of `docs` (doc_id, text, n_chars)."""
    source = pick(docs, *dict.fromkeys(["doc_id", "text", "n_chars", *keep]))
    extra = [f for f in source.schema.fields if f.name in keep and f.name != "doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            if model is None:
                s = np.full(len(part), 0.5)
            else:
                found = features(list(part["text"]), part["n_chars"].astype(float).to_numpy())
                s = sigmoid(raw_score(model, *rows_of(model.edges, *found))[0])
            yield part[["doc_id", *[f.name for f in extra]]].assign(score=s)

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name == "doc_id" or f in extra])
    return source.mapInPandas(run, f"{kinds}, score double")

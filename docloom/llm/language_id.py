"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

Features are hashed byte n-grams (1 to 4) of the lower-cased whole text as shares of all n-grams of
the text, so a score is the mean weight over the n-grams and long texts need no vectors. Every
classifier is an L2-regularised linear SVM with squared hinge loss, fitted by dual coordinate
descent on a bounded sample: about `sample` labelled documents in all, the same number for each
language, chosen by a hash of doc_id.

Defined results: null texts and texts without a letter are `und` with score 0. Rows with null lang
or null text teach nothing. Without any labelled text every prediction is `und`. With one language
that language is predicted with score 1. Ties go to the language first in alphabetical order.
Repeated rows are predicted one by one; extra columns are ignored; an empty table gives an empty
result. Scores are in 0 to 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pick
from docloom.llm.textkernel import steps

DIM = 1 << 13
ORDERS = (1, 2, 3, 4)
STEP = 1 << 20
ASCII_LETTER = re.compile("[A-Za-z]")
#: Family of an ISO 639-1 code. Other codes form a family of their own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
}


def has_letter(text: str) -> bool:
    """Whether any character is alphabetic; superscripts, fractions and circled digits are not."""
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of each order at every byte of the joined texts; where each text begins."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n\n\n".join([b"", *raws, b""]), np.uint8).astype(np.uint32)
    at = 3 + np.concatenate(([0], np.cumsum([len(r) + 3 for r in raws])))
    out, acc, n = [], np.zeros(len(raw), np.uint32), len(raw)
    for k in ORDERS:  # an n-gram ends at its byte
        acc = acc * np.uint32(2654435761)
        acc[k - 1 :] += (raw[: n - k + 1] + np.uint32(k)) * np.uint32(40503 * k * 2 + 1)
        h = acc ^ (acc >> np.uint32(15))
        h = h * np.uint32(2246822519)
        out.append((h >> np.uint32(32 - 13)).astype(np.int32))
    return out, at


def spectrum(texts: list[str]) -> np.ndarray:
    """Dense shares of hashed n-grams, one row for each text."""
    found, at = grams(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    for i in range(len(texts)):
        n = max(at[i + 1] - at[i], 1)
        for h in found:
            out[i] += np.bincount(h[at[i] : at[i + 1]], minlength=DIM).astype(np.float32) / n
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge linear SVM (dual coordinate descent on the Gram matrix)."""
    scale = float(np.sqrt((x * x).sum(axis=1).mean())) or 1.0
    z = x.astype(np.float64) / scale
    gram = z @ z.T + 1.0
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = (1 - y[i] * f[i] - alpha[i] / (2 * c)) / (gram[i, i] + 1 / (2 * c))
            new = max(alpha[i] + step, 0.0)
            if new != alpha[i]:
                f += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    return (z.T @ (alpha * y)) / scale, float((alpha * y).sum())


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    #: name of a classifier -> its column: a family, or (language, language)
    columns: dict = field(default_factory=dict)
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None


def fit(x: np.ndarray, langs: list[str]) -> Model:
    known = sorted(set(langs))
    model, w, b = Model(), [], []
    lang = np.array(langs, dtype=object)
    for name in known:
        model.members.setdefault(FAMILY.get(name, name), []).append(name)
    model.families = sorted(model.members)
    family = np.array([FAMILY.get(n, n) for n in langs], dtype=object)

    def add(key, rows, positive):
        one = svm(x[rows], np.where(positive, 1.0, -1.0))
        model.columns[key] = len(w)
        w.append(one[0])
        b.append(one[1])

    if len(model.families) > 1:
        for name in model.families:
            add(name, np.arange(len(x)), family == name)
    for names in model.members.values():
        for i, p in enumerate(names):
            for q in names[i + 1 :]:
                rows = np.flatnonzero((lang == p) | (lang == q))
                add((p, q), rows, lang[rows] == p)
    model.weight = np.array(w, np.float32).reshape(len(w), -1).T.copy() if w else np.zeros((DIM, 0), np.float32)
    model.bias = np.array(b)
    return model


def margins(model: Model, texts: list[str]) -> np.ndarray:
    found, at = grams(texts)
    out = np.zeros((len(texts), len(model.bias)))
    n = np.maximum(np.diff(at), 1)
    for j in range(len(model.bias)):
        column = model.weight[:, j].copy()
        total = column[found[0]]
        for h in found[1:]:
            total += column[h]
        sums = np.add.reduceat(total, at[:-1], dtype=np.float64) if len(texts) else np.empty(0)
        out[:, j] = sums / n + model.bias[j]
    return out


def decide(model: Model, m: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Family by the largest margin, then pairwise votes inside it; the score is a product of sigmoids."""
    sig = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
    n = len(m)
    if len(model.families) > 1:
        cols = [model.columns[f] for f in model.families]
        best = m[:, cols].argmax(axis=1)
        score = sig[:, cols].max(axis=1)
    else:
        best, score = np.zeros(n, int), np.ones(n)
    names = np.empty(n, object)
    for k, fam in enumerate(model.families):
        rows = np.flatnonzero(best == k)
        langs = model.members[fam]
        votes, worst = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
        for i, p in enumerate(langs):
            for j in range(i + 1, len(langs)):
                s = sig[rows, model.columns[(p, langs[j])]]
                votes[:, i] += s >= 0.5
                votes[:, j] += s < 0.5
                worst[:, i] = np.minimum(worst[:, i], s)
                worst[:, j] = np.minimum(worst[:, j], 1 - s)
        won = (votes + 1e-3 * worst).argmax(axis=1) if len(rows) else np.empty(0, int)
        names[rows] = [langs[i] for i in won]
        score[rows] *= worst[np.arange(len(rows)), won]
    return list(names), score


def train(docs: DataFrame, sample: int = 1600, languages: int = 100) -> Model:
    """`docs` (doc_id, text, lang): fits on about `sample` rows in all, as many for each language.

    Learns the `languages` most frequent values of lang (ties: the first in alphabetical order).
    """
    rows = pick(docs, "doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return Model()
    each = max(sample // len(counts), 1)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    chosen = rows.where(F.col("lang").isin(list(counts))).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def feature(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames, step=STEP):
            yield pd.DataFrame({"lang": part["lang"], "x": [r.tobytes() for r in spectrum(list(part["text"]))]})

    got = sorted(chosen.mapInPandas(feature, "lang string, x binary").collect(), key=lambda r: (r[0], bytes(r[1])))
    if not got:
        return Model()
    return fit(np.stack([np.frombuffer(bytes(r[1]), np.float32) for r in got]), [r[0] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, family_pred, score) for every row of `docs` (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames, step=STEP):
            texts = [t if t is not None else "" for t in part["text"]]
            names, score = decide(model, margins(model, texts)) if model.families else ([None] * len(texts), np.zeros(len(texts)))
            fine = [bool(model.families) and has_letter(t) for t in texts]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(),
                "lang_pred": [n if ok else "und" for n, ok in zip(names, fine, strict=True)],
                "family_pred": [FAMILY.get(n, n) if ok else "und" for n, ok in zip(names, fine, strict=True)],
                "score": np.where(fine, score, 0.0),
            })

    return pick(docs, "doc_id", "text").mapInPandas(run, "doc_id bigint, lang_pred string, family_pred string, score double")

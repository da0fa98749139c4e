"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words (lower-cased, cut at everything but letters and digits). A document is
contaminated by an item when some stretch of it is within edit distance floor((1 - similarity) * n)
of the item's n words.

Windows are embedded by CGK random walks: a shared random bit for each step and word says whether the walk
moves on in the word sequence, which maps an edit distance to a Hamming distance. A repetition is
a walk of its own of which `bits` steps are sampled; what the walk reads there is a window's
signature. Items put their signatures of all repetitions into LSH tables; a window that meets an item in a table
is a candidate, and nothing else is. Two walks that have parted meet again only by chance, so a repetition's
walk begins at a drawn word of the window and is sampled within SPAN steps. Items fall into classes of similar
lengths. A class has as many repetitions as reach `recall` on simulated pairs at the largest allowed
distance, by substitutions, by insertions, by deletions and by a mixture of them; the least of the four
counts. There is no limit to their number.

Every word of every text begins a window. One that has too few word pairs of any items within an item's length is not
embedded: of n - 1 pairs an edit spoils two at most, so this loses nothing. Candidates carry
their stretch of words, are joined with the items they met, and are verified by the exact
edit distance of the item to the best part of the stretch.

The workers get two bitmaps of fixed size, the items' word pairs and their signatures, whatever the number of
items, and the documents are read once. Defined results: null or empty texts match nothing; items without a word
match nothing; items shorter than `least` words have distance 0 only. Rows repeated with one doc_id are one
document; repeated item ids count once, with the least text. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, pick, small
from docloom.llm.textkernel import U, Words, lowered, mix, slices, steps

GAP = np.ones(256, bool)
GAP[ord("a") : ord("z") + 1] = GAP[ord("0") : ord("9") + 1] = GAP[ord("A") : ord("Z") + 1] = False
GAP[128:] = False
#: Bits of a bitmap's index: a bitmap has 2**FLAGS places, whatever the number of items.
FLAGS = 22
SPREAD = U(0x9E3779B97F4A7C15)
#: Steps of a walk that a repetition samples from; walks of long windows begin at drawn words of them.
SPAN = 24
#: Windows embedded at once.
BLOCK = 4096


def spot(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(64 - FLAGS)).astype(np.int64)


def pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each word and the next one."""
    return mix(words[:-1] * SPREAD + words[1:])


def class_of(n: int) -> tuple[int, int]:
    """The class of items of n words: its least and largest length."""
    lo = 1
    while True:
        hi = max(lo, lo * 5 // 4)
        if n <= hi:
            return lo, hi
        lo = hi + 1


def walks(words: np.ndarray, starts: np.ndarray, seed: int, chosen: np.ndarray) -> np.ndarray:
    """What the CGK walk of a seed reads at the chosen steps (rising) from each start; past the last word it stays."""
    at, out, last = starts.copy(), np.empty((len(starts), len(chosen)), U), len(words) - 1
    k = 0
    for step in range(int(chosen[-1]) + 1):
        here = words[at]
        while k < len(chosen) and chosen[k] == step:
            out[:, k] = here
            k += 1
        x = (here ^ U(seed * 0x10001 + step + 1)) * U(0xFF51AFD7ED558CCD)
        at = np.minimum(at + ((x ^ (x >> U(29))) * SPREAD >> U(63)).astype(np.int64), last)
    return out


@dataclass
class Class:
    """Items of `lo` to `hi` words: what a match has at least, and each repetition's sampled steps."""

    lo: int
    hi: int
    far: int  # edits that the longest item allows
    least: int  # words of the shortest match
    pairs: int  # word pairs of an item that are left in any match
    steps: list[np.ndarray] = field(default_factory=list)
    ahead: list[int] = field(default_factory=list)  # words of the window that a repetition's walk leaves out first

    def signatures(self, words: np.ndarray, starts: np.ndarray, rep: int) -> np.ndarray:
        acc = np.full(len(starts), U(self.lo * 1_000_003 + rep))
        starts = np.clip(starts + self.ahead[rep], 0, len(words) - 1)
        for column in walks(words, starts, rep, self.steps[rep]).T:
            acc = mix(acc * U(31) + column)
        return acc


def edited(word: np.ndarray, d: int, kind: int, rng: np.random.Generator) -> np.ndarray:
    """d random edits: substitutions, insertions, deletions or a mixture."""
    out = word.tolist()
    for _ in range(d):
        p, do = int(rng.integers(len(out))), kind if kind < 3 else int(rng.integers(3))
        fresh = [int(rng.integers(1 << 40, 1 << 41))] if do < 2 else []
        out[p : p + (do != 1)] = fresh
    return np.array(out, U)


@lru_cache(maxsize=256)
def fitted(lo: int, hi: int, similarity: float, least: int, bits: int, recall: float, trials: int = 400) -> Class:
    """The class with as many repetitions as reach the recall at the largest distance."""
    edits = lambda n: int((1 - similarity) * n + 1e-9) if n >= least else 0
    sizes, rng = range(lo, hi + 1), np.random.default_rng(lo)
    out = Class(lo, hi, edits(hi), min(n - edits(n) for n in sizes), min(n - 1 - 2 * edits(n) for n in sizes))
    texts, items, at = [], [], []
    for t in range(trials):
        n = (lo, hi)[t % 2]
        item = rng.integers(1, 1 << 40, n).astype(np.uint64)
        text = edited(item, edits(n), t // 2 % 4, rng)
        at.append(sum(map(len, texts)) + hi)
        texts += [rng.integers(1 << 42, 1 << 43, hi).astype(np.uint64), text, rng.integers(1 << 42, 1 << 43, hi).astype(np.uint64)]
        items += [item, np.zeros(2 * hi, U)]
    begins = np.cumsum([0] + [len(x) for x in items])[:-1:2]
    texts, items, at = np.concatenate(texts), np.concatenate(items), np.array(at)
    found, kind = np.zeros(trials, bool), np.arange(trials) // 2 % 4
    span = max(1, min(SPAN, 3 * lo // 2))
    with np.errstate(over="ignore"):
        while not out.steps or min(found[kind == k].mean() for k in range(4)) < recall:
            draw = np.random.default_rng(1000 * lo + len(out.steps))
            out.steps.append(np.sort(draw.choice(span, min(bits, span), replace=False)))
            out.ahead.append(int(draw.integers(max(0, lo - 2 * SPAN // 3) + 1)))
            mine = out.signatures(items, begins, len(out.steps) - 1)
            left = np.flatnonzero(~found)
            for shift in range(-out.far, out.far + 1):
                found[left] |= out.signatures(texts, at[left] + shift, len(out.steps) - 1) == mine[left]
    return out


def hits(classes: list[Class], bitmap: np.ndarray, table: np.ndarray, h: np.ndarray, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Class, np.ndarray]]:
    """(begins of windows, their texts, class, keys) that are in the items' tables. `text` numbers the text of each word.

    Windows whose first words are lost may begin up to `far` words before their text.
    """
    if not len(h):
        return
    known = np.concatenate(([0], np.cumsum(bitmap[spot(pairs(h))] & (text[1:] == text[:-1])))) if len(h) > 1 else np.zeros(1, np.int64)
    begin = np.arange(len(h))
    heads = at[:-1][np.diff(at) > 0]
    for c in classes:
        early = (heads[:, None] - np.arange(1, c.far + 1)[None]).ravel()
        starts = np.concatenate([begin, early])
        own = np.concatenate([text, np.repeat(text[heads], c.far)])
        if c.pairs > 0:
            low, end = np.maximum(starts, at[own]), at[own + 1]
            stop = np.maximum(np.minimum(starts + c.hi + c.far, end) - 1, low)
            good = np.flatnonzero((known[stop] - known[low] >= c.pairs) & (end - low >= c.least))
            starts, own = starts[good], own[good]
        for block in np.array_split(np.arange(len(starts)), max(1, len(starts) // BLOCK)):
            for rep in range(len(c.steps) if len(block) else 0):
                keys = c.signatures(h, starts[block], rep)
                good = np.flatnonzero(table[spot(keys)])
                if len(good):
                    yield starts[block[good]], own[block[good]], c, keys[good]


def distances_in(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of the item to any stretch of each row of `texts` (exact); 0 pads a row."""
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int32)
    j = np.arange(texts.shape[1] + 1, dtype=np.int32)
    best = np.empty_like(row)
    for i, w in enumerate(item, 1):
        best[:, 0] = i
        np.minimum(row[:, :-1] + (texts != w), row[:, 1:] + 1, out=best[:, 1:])
        row = np.minimum.accumulate(best - j, axis=1) + j
    return row.min(axis=1)


def distance_in(item: np.ndarray, text: np.ndarray) -> int:
    return int(distances_in(item, text[None])[0]) if len(text) else len(item)


def prepared(texts: list[str], similarity: float, least: int, bits: int, recall: float) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """(number, word hashes, allowed distance, keys of all repetitions) of the items that have a word."""
    words = Words(lowered(pd.Series(texts, dtype=object)), GAP)
    for k in range(len(texts)):
        w = words.hash[words.at[k] : words.at[k + 1]]
        if len(w):
            c = fitted(*class_of(len(w)), similarity, least, bits, recall)
            padded = np.concatenate([w, np.zeros(2 * c.hi, U)])
            keys = np.concatenate([c.signatures(padded, np.zeros(1, np.int64), r) for r in range(len(c.steps))])
            yield k, w, int((1 - similarity) * len(w) + 1e-9) if len(w) >= least else 0, keys


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least: int = 5, bits: int = 2, recall: float = 0.995) -> DataFrame:
    """(doc_id, item_id, distance, n_words): items found in `docs` (doc_id, text); `benchmark` (item_id, text)."""
    spark, given = docs.sparkSession, (similarity, least, bits, recall)
    disk = Scratch(spark, "edits")
    rows = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))

    def table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            ids, out = part["item_id"].to_numpy(), []
            for k, w, far, keys in prepared(part["text"].tolist(), *given):
                marks = spot(pairs(w)).tolist() if len(w) > 1 else []
                out.append((ids[k], len(w), far, w.tobytes(), keys.view(np.int64).tolist(), marks, spot(keys).tolist()))
            yield pd.DataFrame(out, columns=["item_id", "n_words", "far", "words", "keys", "marks", "spots"])

    items = rows.mapInPandas(table, "item_id bigint, n_words bigint, far bigint, words binary, keys array<bigint>, marks array<bigint>, spots array<bigint>")
    items = disk.save(items, "items")
    # at most one row for each class of lengths, and at most 2**FLAGS places in each bitmap
    classes = [fitted(*c, *given) for c in sorted({class_of(r[0]) for r in items.select("n_words").distinct().collect()})]

    def bits_of(column: str) -> np.ndarray:
        out = np.zeros(1 << FLAGS, bool)
        out[items.select(F.explode(column).alias("x")).distinct().toPandas()["x"].to_numpy(np.int64)] = True
        return out

    bitmap, filled = bits_of("marks"), bits_of("spots")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames):
            words = Words(lowered(part["text"]), GAP)
            h, ids, out = words.hash, part["doc_id"].astype("Int64").array, []
            with np.errstate(over="ignore"):
                for begin, own, c, keys in hits(classes, bitmap, filled, h, words.text, words.at):
                    # windows that begin close together share a stretch, which holds all that they can match
                    grid = begin - (begin - words.at[own]) % (c.far + 1)
                    lo, hi = np.maximum(words.at[own], grid - c.far), np.minimum(words.at[own + 1], grid + c.hi + 3 * c.far + 1)
                    stretch = [h[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    out.append(pd.DataFrame({"doc_id": ids[own], "key": keys.view(np.int64), "stretch": stretch}))
            if out:
                yield pd.concat(out)

    found = pick(docs, "doc_id", "text").mapInPandas(search, "doc_id bigint, key bigint, stretch binary")
    tables = items.select("item_id", F.explode("keys").alias("key"))
    # a window may meet an item in several repetitions
    met = found.join(small(tables), "key").groupBy("doc_id", "item_id", F.xxhash64("stretch").alias("s")).agg(F.first("stretch").alias("stretch"))
    met = met.join(items.select("item_id", "n_words", "far", "words"), "item_id")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, ["stretch", "words"]):
            for _, mine in frame.groupby("item_id", sort=False):
                item, far = np.frombuffer(mine["words"].iloc[0], U), int(mine["far"].iloc[0])
                for lo in range(0, len(mine), 512):
                    part = mine.iloc[lo : lo + 512]
                    texts = [np.frombuffer(s, U) for s in part["stretch"]]
                    grid = np.zeros((len(texts), max(map(len, texts))), U)
                    for row, t in zip(grid, texts, strict=True):
                        row[: len(t)] = t
                    # a match keeps n - far words of the item
                    known = np.unique(item)
                    shared = known[np.minimum(np.searchsorted(known, grid), len(known) - 1)] == grid
                    some = np.flatnonzero(shared.sum(1) >= len(item) - far)
                    d = distances_in(item, grid[some])
                    good = some[d <= far]
                    yield part.iloc[good][["doc_id", "item_id", "n_words"]].assign(distance=d[d <= far].astype(np.int64))

    kinds = "doc_id bigint, item_id bigint, n_words bigint, distance bigint"
    return met.select("doc_id", "item_id", "n_words", "far", "words", "stretch").mapInPandas(verify, kinds).groupBy("doc_id", "item_id").agg(
        F.min("distance").alias("distance"), F.first("n_words").alias("n_words"))

"""SentencePiece segmentation sampling without replacement, and decoding.

A text is the lattice of all its segmentations into pieces of a given vocabulary (never trained
here). Spaces become the word mark, one mark is put in front, and as no piece runs over the start of
a word, the lattice is a chain of word lattices. A piece of merge rank r weighs log(1 / (r + OFFSET)),
a Zipf law over the vocabulary's own order; a character without a piece falls back to its bytes. A
segmentation's probability is the product of its weights over the sum for all segmentations.

Gumbel top-k: the segmentations with the k largest Gumbel-perturbed log-probabilities are a sample of k
without replacement. They come from a perturbed A* search that never lists the lattice. A node is a
path up to a position and a set of pieces excluded there; its bound is the largest perturbed value
below it, a Gumbel draw at the node's log mass truncated at its parent's value. The best open node is
popped, one leaf below it is completed by forward sampling from the backward sums, and the node splits
into the alternatives along the new path. Pops come in falling order, so the first k leaves are exact.
The inclusion score of a segmentation with log-probability p is 1 - exp(-exp(p - t)), t being the largest
perturbed value that is left, the threshold of the sample.

Random numbers are hashes of (seed, doc_id, sample, word, step), so a row's samples do not depend on
its neighbours, partitions or retries.

Defined results: null and empty texts have one segmentation without pieces, inclusion 1. A text with
fewer than k segmentations gives all of them, inclusion 1. Literal word marks are encoded by their
bytes. Lone surrogates are replaced by U+FFFD first. Rows repeated with one doc_id get equal samples.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pick
from docloom.llm.textkernel import U, mix, steps

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
OFFSET = 10.0
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Code points that are no characters; one that a text lacks stands for a literal mark.
SPARE = ("￿", "￾", "﷐", "﷑", "﷒")
STEP = 150_000
#: Characters of distinct words whose lattices a worker keeps; beyond that it begins anew.
KEEP = 900_000
SPREAD = U(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary: weights, texts, and a hash table from code points to pieces."""

    _have: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int32)
        ids = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.text[i][3:-1], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i):
                ids.append(i)
        # merge ranks in the vocabulary's order; pieces without a merge score rank by their place
        self.weight = np.zeros(n)
        for i in ids:
            score = -sp.get_score(i)
            self.weight[i] = -np.log((score if score < n else i) + OFFSET)
        self.unknown = -np.log(n + OFFSET)
        self.longest = max(len(self.text[i]) for i in ids)
        keys = np.array([self.prefixes(self.text[i])[-1] for i in ids], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int32)[order]
        # where a key is found; -1: several keys share the place, they are searched for
        spots, times = np.unique(self.spot(self.keys), return_counts=True)
        self.slot = np.zeros(1 << 18, np.int32)
        self.slot[self.spot(self.keys)] = np.arange(len(self.keys))
        self.slot[spots[times > 1]] = -1
        # 1: may begin a piece, 2: may be a piece
        self.flags = np.zeros(1 << 22, np.uint8)
        begins = np.array(list({h for i in ids for h in self.prefixes(self.text[i])}), U)
        self.flags[self.place(begins)] = 1
        self.flags[self.place(keys)] |= 2
        # what a piece decodes to, in bytes
        raws = [t.replace(MARK, " ").encode() for t in self.text]
        for value, i in enumerate(self.byte.tolist()):
            raws[i] = bytes([value])
        self.sizes = np.array([len(r) for r in raws])
        self.begin, self.raws = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raws), np.uint8)
        self.lattice = Lattice(self)

    @staticmethod
    def prefixes(text: str) -> list[int]:
        """Hashes of all beginnings of a text, the whole last."""
        out, h = [], 0
        for c in text:
            h = (h * int(SPREAD) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    @staticmethod
    def place(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes ^ (hashes >> U(32))) * U(0xD6E8FEB86659FD93) >> U(42)).astype(np.int64)

    @staticmethod
    def spot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> U(29))) * SPREAD >> U(46)).astype(np.int64)

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Where in `keys` the hashes would be."""
        at = self.slot[self.spot(hashes)]
        lost = np.flatnonzero(at < 0)
        at[lost] = np.minimum(np.searchsorted(self.keys, hashes[lost]), len(self.keys) - 1)
        return at

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._have:
            cls._have[path] = cls(path)
        return cls._have[path]

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes that the pieces stand for, with the space in front of the first word."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.raws[np.repeat(self.begin[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")[1:]


def hashed(h, *parts):
    """The hash h taken on by further parts."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix((np.asarray(p).astype(U) if not isinstance(p, np.ndarray) or p.dtype != U else p) + h * SPREAD + U(1))
    return h


def uniform(h):
    return ((h >> U(12)).astype(np.float64) + 0.5) / 2.0**52


def draw(*parts) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes of the parts."""
    return uniform(hashed(U(0x243F6A8885A308D3), *parts))


class Lattice:
    """Arcs and their distributions of the distinct words met so far, position by position.

    The arcs of a position lie together: `key` is the position plus the share of the arcs up to
    this one, so one search draws an arc; `logrest` is the log share of the position's other arcs.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.bytes_of = pieces, {}
        self.reset(KEEP)

    def reset(self, size: int) -> None:
        self.number: dict[str, int] = {}
        self.start, self.n, self.arcs = [], 0, 0
        self.code, self.rest, self.ptr = np.empty(size, np.uint32), np.empty(size, np.int32), np.zeros(size + 1, np.int32)
        self.room(5 * size // 2)

    def room(self, arcs: int) -> None:
        for name, kind in (("key", np.float64), ("logp", np.float64), ("logrest", np.float32), ("id", np.int32), ("long", np.int8)):
            new = np.empty(arcs, kind)
            if self.arcs:
                new[: self.arcs] = getattr(self, name)[: self.arcs]
            setattr(self, name, new)

    def words(self, chunks: list[list[str]]) -> np.ndarray:
        """Where each of the words, text by text and without the mark in front, begins."""
        flat = list(chain.from_iterable(chunks))
        found = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        lacking = np.flatnonzero(found < 0).tolist()
        new = list(dict.fromkeys([flat[i] for i in lacking]))
        if self.n + sum(map(len, new)) + len(new) > len(self.code):
            lacking, new = range(len(flat)), list(dict.fromkeys(flat))
            self.reset(max(KEEP, sum(map(len, new)) + len(new)))
        if new:
            self._add(new)
            found[lacking] = [self.number[flat[i]] for i in lacking]
        return found

    def _add(self, words: list[str]) -> None:
        pieces = self.pieces
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        code = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32).astype(U)
        n, start = len(code), np.cumsum(sizes) - sizes
        rest = np.repeat(start + sizes, sizes) - np.arange(n)  # characters up to the word's end
        row, col, ids, weight = [], [], [], []
        live, h = np.arange(n), np.zeros(n, U)
        with np.errstate(over="ignore"):
            for k in range(pieces.longest):
                h = h * SPREAD + code[live + k] + U(1)
                flag = pieces.flags[pieces.place(h)]
                hit = np.flatnonzero(flag > 1)
                found = h[hit]
                at = pieces.at(found)
                good = pieces.keys[at] == found
                row.append(live[hit[good]])
                col.append(np.full(len(row[-1]), k + 1))
                ids.append(pieces.ids[at[good]])
                weight.append(pieces.weight[ids[-1]])
                on = np.flatnonzero((flag > 0) & (rest[live] > k + 1))
                live, h = live[on], h[on]
                if not len(live):
                    break
        some = np.zeros(n, bool)
        some[row[0]] = True
        alone = np.flatnonzero(~some)  # characters that fall back to bytes
        for c in np.unique(code[alone]).tolist():
            self.bytes_of[c] = chr(c).encode("utf-8", "replace")
        row.append(alone)
        col.append(np.ones(len(alone), np.int64))
        one = code[alone] < 128  # a single byte is a piece
        ids.append(np.where(one, pieces.byte[np.where(one, code[alone], 0).astype(np.int64)], -1).astype(np.int32))
        weight.append(np.array([pieces.unknown * len(self.bytes_of[c]) for c in code[alone].tolist()]))
        row, col, ids, weight = (np.concatenate(x) for x in (row, col, ids, weight))
        order = np.argsort(row.astype(np.int32), kind="stable")
        row, col, ids, weight = row[order], col[order], ids[order], weight[order]
        m, inner = len(row), rest[row] > col
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # every position has an arc
        sizes = np.diff(np.append(head, m))
        # backward sums, from the words' ends on: all positions with as many characters left at once
        beta, full = np.zeros(n + 1), np.empty(m)
        order = np.argsort(rest.astype(np.uint16) if rest.max() < 65536 else rest, kind="stable")
        bounds = np.searchsorted(rest[order], np.arange(1, int(rest.max()) + 2))
        k = sizes[order]
        local = np.cumsum(k) - k
        arcs = np.repeat(head[order] - local, k) + np.arange(m)
        w, goal = weight[arcs], np.where(inner, row + col, n)[arcs]  # beyond a word's end the sum is 0
        ends = np.append(local, m)[bounds]
        for lo, hi, x, y in zip(bounds, bounds[1:], ends, ends[1:], strict=False):
            if lo < hi:
                w[x:y] += beta[goal[x:y]]
                first = local[lo:hi] - x
                top = np.maximum.reduceat(w[x:y], first)
                beta[order[lo:hi]] = top + np.log(np.add.reduceat(np.exp(w[x:y] - np.repeat(top, k[lo:hi])), first))
        full[arcs] = w
        logp = full - beta[row]
        p = np.exp(logp)
        sums = np.cumsum(p)
        share = sums - np.repeat(sums[head] - p[head], sizes)
        # the other arcs' share: of the likeliest arc their sum, of others what they leave of 1
        likely = p >= np.repeat(np.maximum.reduceat(p, head), sizes)
        others = np.where(likely, np.repeat(np.add.reduceat(np.where(likely, 0.0, p), head), sizes), 1.0 - p)
        ties = np.repeat(np.add.reduceat(likely.astype(np.int64), head), sizes) > 1
        others[ties & likely] = 1.0 - p[ties & likely]
        a, b = self.arcs, self.n
        if a + m > len(self.key):
            self.room(a + m + len(self.code) // 4)
        last = np.append(row[1:] != row[:-1], True)
        self.key[a : a + m] = b + row + np.where(last, 1.0, np.minimum(share, 1.0))
        self.logp[a : a + m], self.id[a : a + m], self.long[a : a + m] = logp, ids, col
        with np.errstate(divide="ignore"):
            self.logrest[a : a + m] = np.log(others)
        self.code[b : b + n], self.rest[b : b + n] = code, rest
        self.ptr[b + 1 : b + n + 1] = a + np.append(head[1:], m)
        self.number.update(zip(words, (b + start).tolist(), strict=True))
        self.n, self.arcs = b + n, a + m

    def walk(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward sampling from positions to the ends of their words: (walker, position, arc) in order."""
        walkers = np.arange(len(at))
        who, out, step = walkers, [], 0
        while len(who):
            arc, goal = self.ptr[at].astype(np.int64), at + uniform(hashed(seed, step))
            short = np.flatnonzero(self.key[arc] < goal)
            while len(short):  # two or three arcs begin at a position
                arc[short] += 1
                short = short[self.key[arc[short]] < goal[short]]
            out.append((who, at, arc))
            long = self.long[arc]
            more = self.rest[at] > long
            who, at, seed, step = who[more], (at + long)[more], seed[more], step + 1
        counts = np.zeros(len(walkers), np.int64)
        for who, _, _ in out:
            counts[who] += 1
        begin = np.cumsum(counts) - counts
        pos, arcs = np.empty((2, int(counts.sum())), np.int64)
        for step, (who, at, arc) in enumerate(out):
            pos[begin[who] + step], arcs[begin[who] + step] = at, arc
        return np.repeat(walkers, counts), pos, arcs


class Path:
    """One sampled segmentation of a text and the open nodes along it.

    `begin` is the first token that is not shared with the parent path; nodes before stay with that one.
    `free` holds the Gumbel draws of the nodes not popped yet, before they are truncated at the path's value,
    which keeps their order; `cut` holds what is left of popped ones, truncated.
    """

    def __init__(self, word, pos, arc, begin, fresh, logp, value):
        self.word, self.pos, self.arc, self.begin, self.value = word, pos, arc, begin, value
        self.before, self.free = fresh  # of the tokens from `begin` on
        self.logp, self.shut, self.cut = logp, {}, {}  # token -> arcs excluded there, what is left of it
        self.settle()

    def settle(self) -> None:
        self.where = int(self.free.argmax()) if len(self.free) else 0
        best = self.free[self.where] if len(self.free) else -np.inf
        self.top = float(-np.logaddexp(-self.value, -best)) if best > -np.inf else -np.inf
        for o, value in self.cut.items():
            if value > self.top:
                self.where, self.top = o, float(value)


def opened(lattice: Lattice, arc: np.ndarray, ends: np.ndarray, base: np.ndarray, begin: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the new tokens of many paths, one after the other: log-probability before each, free Gumbel draws, and each path's log-probability."""
    counts = np.diff(ends)
    step = lattice.logp[arc]
    sums = np.concatenate(([0.0], np.cumsum(step)))
    before = sums[:-1] + np.repeat(base - sums[ends[:-1]], counts)
    free = before + lattice.logrest[arc]
    some = np.flatnonzero(free > -np.inf)  # elsewhere there is no other arc
    path = np.repeat(np.arange(len(counts)), counts)[some]
    free[some] -= np.log(-np.log(uniform(hashed(hashed(U(0x243F6A8885A308D3), seed, U(77))[path], some - ends[path] + begin[path]))))
    return before, free, base + sums[ends[1:]] - sums[ends[:-1]]


def sample_batch(texts: list[str], keys: np.ndarray, k: int, seed: int, pieces: Pieces) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text up to k of (log-probability, perturbed value, inclusion, piece ids), best first."""
    chunks, marks = [], []
    for t in texts:
        marks.append(next((s for s in SPARE if s not in t), SPARE[0]) if MARK in t else "")
        t = t.replace(MARK, marks[-1]) if marks[-1] else t
        if not t or ("  " not in t and t[0] != " " and t[-1] != " "):
            chunks.append(t.split(" ") if t else [])
        else:  # more than one mark at a word
            chunks.append([c[1:] for c in CHUNK.findall(MARK + t.replace(" ", MARK))])
    lattice = pieces.lattice
    flat = lattice.words(chunks)
    count = np.array([len(c) for c in chunks], np.int64)
    first = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(texts)), count)
    word = np.arange(len(flat)) - first[owner] if len(flat) else flat
    rowkey = mix(keys.astype(np.int64).view(U) + U(seed) * SPREAD)
    who, pos, arc = lattice.walk(flat, hashed(U(0x243F6A8885A308D3), rowkey[owner], U(0), word))
    ends = np.searchsorted(owner[who] if len(who) else who, np.arange(len(texts) + 1))
    root = -np.log(-np.log(draw(rowkey, U(99))))
    zero = np.zeros(len(texts), np.int64)
    before, free, logp = opened(lattice, arc, ends, zero.astype(float), zero, rowkey)
    paths: list[list[Path]] = []
    for i in range(len(texts)):
        s = slice(ends[i], ends[i + 1])
        paths.append([Path(word[who[s]], pos[s], arc[s], 0, (before[s], free[s]), float(logp[i]), root[i])] if count[i] else [])

    for turn in range(1, k):
        jobs = []  # (text, parent, token, new arc)
        for i, mine in enumerate(paths):
            if not mine or len(mine) < turn:
                continue
            best = max(mine, key=lambda p: p.top)
            value = best.top
            if value == -np.inf:
                continue
            o = best.where
            t = o + best.begin
            at = best.pos[t]
            arcs = np.arange(lattice.ptr[at], lattice.ptr[at + 1])
            shut = best.shut.setdefault(t, [int(best.arc[t])])
            p = np.exp(lattice.logp[arcs])
            p[np.array(shut) - arcs[0]] = 0
            c = np.cumsum(p)
            new = int((c < draw(rowkey[i], U(turn), U(55)) * c[-1]).sum())
            shut.append(int(arcs[new]))
            p[new] = 0
            live = p.sum()
            e = -np.log(draw(rowkey[i], U(turn), U(66)))
            # what is left of the node is truncated at the value that it has given away
            best.free[o] = -np.inf
            best.cut[o] = -np.logaddexp(-value, np.log(e) - best.before[o] - np.log(live)) if live > 0 else -np.inf
            best.settle()
            new = int(arcs[new])
            jobs.append((i, best, t, new, value))
        if not jobs:
            break
        begins, seeds, words, tags = [], [], [], []
        for j, (i, best, t, new, _) in enumerate(jobs):
            w, nxt = int(best.word[t]), int(best.pos[t]) + int(lattice.long[new])
            inside = lattice.rest[best.pos[t]] > lattice.long[new]
            later, ahead = np.arange(w + 1, count[i]), flat[first[i] + w + 1 : first[i] + count[i]]
            begins.append(np.concatenate(([nxt], ahead)) if inside else ahead)
            words.append(np.concatenate(([w], later)) if inside else later)
            seeds.append(np.full(len(words[-1]), rowkey[i], U))
            tags.append(np.full(len(words[-1]), j))
        begins, words, seeds, tags = (np.concatenate(x) for x in (begins, words, seeds, tags))
        who, pos, arc = lattice.walk(begins, hashed(U(0x243F6A8885A308D3), seeds, U(turn), words))
        ends = np.searchsorted(tags[who] if len(who) else who, np.arange(len(jobs) + 1))
        base = np.array([best.before[t - best.begin] for _, best, t, _, _ in jobs]) + lattice.logp[[new for _, _, _, new, _ in jobs]]
        begin = np.array([t + 1 for _, _, t, _, _ in jobs])
        before, free, logp = opened(lattice, arc, ends, base, begin, mix(rowkey[[i for i, *_ in jobs]] + U(turn)))
        for j, (i, best, t, new, value) in enumerate(jobs):
            s = slice(ends[j], ends[j + 1])
            paths[i].append(Path(
                np.concatenate([best.word[: t + 1], words[who[s]]]), np.concatenate([best.pos[: t + 1], pos[s]]),
                np.concatenate([best.arc[:t], [new], arc[s]]), t + 1, (before[s], free[s]), float(logp[j]), value,
            ))

    out = []
    for mine, mark in zip(paths, marks, strict=True):
        if not mine:
            out.append([(0.0, 0.0, 1.0, np.empty(0, np.int32))])
            continue
        left = max(p.top for p in mine)
        rows = []
        for p in mine:
            share = 1.0 if left == -np.inf else float(-np.expm1(-np.exp(min(p.logp - left, 50.0))))
            ids = lattice.id[p.arc]
            lost = np.flatnonzero(ids < 0)
            if len(lost):
                raws = [MARK.encode() if mark and chr(c) == mark else lattice.bytes_of[c] for c in lattice.code[p.pos[lost]].tolist()]
                sizes = np.ones(len(ids), np.int64)
                sizes[lost] = [len(r) for r in raws]
                at = np.repeat(ids < 0, sizes)
                ids = np.repeat(ids, sizes)
                ids[at] = pieces.byte[np.frombuffer(b"".join(raws), np.uint8)]
            rows.append((float(p.logp), float(p.value), share, ids.astype(np.int32)))
        out.append(rows)
    return out


SAMPLES = pa.schema([
    ("doc_id", pa.int64()), ("rank", pa.int32()), ("n_pieces", pa.int32()), ("logp", pa.float64()), ("perturbed", pa.float64()),
    ("inclusion", pa.float64()), ("text_ok", pa.bool_()), ("ids_sha256", pa.string()), ("ids", pa.list_(pa.int32())),
])


def segment(docs: DataFrame, k: int = 3, seed: int = 0, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """(doc_id, rank, n_pieces, logp, perturbed, inclusion, text_ok, ids_sha256, ids): up to k rows, best first, for every row of `docs` (doc_id, text).

    text_ok: these pieces decode to the text. Without `with_ids` the ids are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for part in steps((b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches), step=STEP):
            texts = [(t or "").encode("utf-8", "replace").decode("utf-8") for t in part["text"]]
            keys = part["doc_id"].fillna(-1).astype("int64").to_numpy()
            rows, ids = [], []
            for doc, text, mine in zip(part["doc_id"], texts, sample_batch(texts, keys, k, seed, pieces), strict=True):
                raw = text.encode()
                for r, (lp, v, q, found) in enumerate(mine, 1):
                    rows.append((None if doc is pd.NA else doc, r, len(found), lp, v, q, pieces.raw(found)[1:] == raw, hashlib.sha256(found.astype("<i4").tobytes()).hexdigest()))
                    ids.append(found)
            at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32))) if with_ids else pa.nulls(len(ids), pa.list_(pa.int32()))
            columns = [pa.array(c, SAMPLES.field(i).type) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*columns, lists], schema=SAMPLES)

    kinds = "doc_id bigint, rank int, n_pieces int, logp double, perturbed double, inclusion double, text_ok boolean, ids_sha256 string, ids array<int>"
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, kinds)


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """`rows` (doc_id, array of piece ids) as (doc_id, text); null ids decode to null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.load(model)
        for part in frames:
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": [None if v is None else pieces.decode(np.asarray(v, np.int32)) for v in part[ids]]})

    return pick(rows, "doc_id", ids).mapInPandas(run, "doc_id bigint, text string")


def report(docs: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """One row for each document and sample, with the digest of the ids in place of them."""
    return segment(docs, k, seed, with_ids=False).drop("ids")

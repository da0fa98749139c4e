"""Vectorised word and byte hashing over batches of texts (numpy, no per-word Python)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at once; the tables take about 60 bytes for each.
STEP = 1 << 20
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_pow: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    have = _pow.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1024)
        out = np.full(size, BASE if kind == "up" else BASE_INV, U)
        out[0] = 1
        have = _pow[kind] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums with which the hash of raw[s:e] is (out[e] - out[s]) * BASE**-s."""
    out = np.empty(len(raw) + 1, U)
    out[0] = 0
    np.cumsum(BYTE[raw] * powers("up", len(raw)), out=out[1:])
    return out


class Words:
    """Words of a batch: hash, text number, and where each text's words begin."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        gap = space[raw]
        gap[self.text_at[1:] - 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
        self.start, self.end = edge[0::2], edge[1::2]
        sums = prefix(raw)
        self.hash = mix((sums[self.end] - sums[self.start]) * powers("down", len(raw) + 1)[self.start])
        self.at = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.at)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.raw = raw


def release() -> None:
    """Gives memory that is free in this worker back, as workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def steps(frames: Iterator[pd.DataFrame], column: str = "text", step: int = STEP) -> Iterator[pd.DataFrame]:
    """Cuts each Arrow batch into runs of rows of about `step` bytes of text; frees memory at the end."""
    try:
        yield from _cut(frames, column, step)
    finally:
        release()


def slices(frames: Iterator[pd.DataFrame], columns: list[str], size: int = 1 << 23) -> Iterator[pd.DataFrame]:
    """Cuts each Arrow batch into runs of rows of about `size` bytes in the binary columns; frees memory at the end."""
    try:
        for frame in frames:
            if len(frame):
                held = sum(frame[c].map(len).to_numpy() for c in columns).cumsum() // size
                for part in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(held)) + 1):
                    yield frame.iloc[part]
    finally:
        release()


def _cut(frames: Iterator[pd.DataFrame], column: str, step: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if not len(frame):
            continue
        size = frame[column].map(lambda t: len(t) if t is not None else 0).cumsum().to_numpy() // step
        cuts = np.flatnonzero(np.diff(size)) + 1
        for part in np.split(np.arange(len(frame)), cuts):
            yield frame.iloc[part]


def lowered(column: pd.Series) -> list[bytes]:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in column]

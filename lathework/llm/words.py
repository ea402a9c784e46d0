"""Words of a batch of texts as hashed numpy arrays.

A word is a run of characters other than space and U+0009 to U+000D. All of these are single bytes in
UTF-8 and never part of another character, so words are found in the bytes of an Arrow column.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: An odd multiplier of 64-bit numbers.
STEP = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Starts of two independent hashes of one run of bytes.
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Longer runs of bytes are hashed one by one.
LONG = 64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words without punctuation: ASCII other than letters and digits. All other characters are parts of words.
BETWEEN = np.ones(256, bool)
BETWEEN[0x80:] = False
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    BETWEEN[ord(_low) : ord(_high) + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(MIX_1)
    x = x ^ (x >> U64(27))
    x = x * U64(MIX_2)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of consecutive texts: bytes start[i]:end[i] of data, hash[i]; text d has the words first[d]:first[d+1].

    check is a second, independent hash if it was asked for.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    check: np.ndarray | None
    first: np.ndarray
    offsets: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls as empty texts, and each text's bounds in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; no run crosses the bounds of a text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of each data[start[i]:end[i]], taken in lanes of 8 bytes; runs of equal length under 9 bytes never collide."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(U64) + U64(seed))
    some, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(some):
        left = np.minimum(size[some] - at, 8).astype(U64)
        lane = lanes[start[some] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left))
        out[some] = mix(out[some] * U64(STEP) + lane)
        at += 8
        some = some[size[some] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def find_words(texts: pa.Array | pa.ChunkedArray, step: int = 1 << 20, outside: np.ndarray = WHITE, check: bool = False) -> Words:
    """All words of all texts; step bounds the bytes that are hashed at once (one text at least).

    outside marks the byte values that belong to no word.
    """
    data, offsets = bytes_of(texts)
    starts, ends, hashes = [], [], [[] for _ in SEEDS[: 1 + check]]
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1)
        piece, base = data[offsets[lo] : offsets[hi]], offsets[lo]
        start, end = runs(~outside[piece], offsets[lo : hi + 1] - base)
        for found, seed in zip(hashes, SEEDS, strict=False):
            found.append(hash_runs(piece, start, end, seed))
        starts.append(start + base)
        ends.append(end + base)
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hashed = [np.concatenate(x) if x else np.zeros(0, U64) for x in hashes]
    return Words(data, start, end, hashed[0], hashed[1] if check else None, np.searchsorted(start, offsets), offsets)


def windows(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive entries, whichever texts they belong to: built from runs of 1, 2, 4, ... entries."""
    n = max(0, len(hashed) - size + 1)
    out, at, run, width = np.full(n, size, U64), 0, hashed, 1
    while True:
        if size & width:
            out = mix(out * U64(STEP) + run[at : at + n])
            at += width
        if at == size:
            return out
        run = mix(run[:-width] * U64(STEP) + run[width:])
        width *= 2


def slices(batch: pa.RecordBatch, step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about `step` bytes, so that a task's memory does not follow its batch."""
    each = max(1, min(len(batch), int(step * len(batch) / max(1, batch.nbytes))))
    for at in range(0, len(batch), each):
        yield batch.slice(at, each)


def process_cache() -> dict:
    """Lives as long as the Python worker; functions and their globals arrive anew with every task."""
    name = "lathework_process_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def room(first: np.ndarray) -> np.ndarray:
    """For each word, how many words its text has from there on."""
    counts = np.diff(first)
    return np.repeat(first[1:], counts) - np.arange(first[-1] - first[0]) if len(counts) else np.zeros(0, np.int64)

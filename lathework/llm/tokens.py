"""Token ids of whole columns of text with a byte-level BPE tokenizer."""

from __future__ import annotations

import itertools
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import BETWEEN, SEEDS, U64, WHITE, bytes_of, hash_runs, process_cache

#: ASCII letters, and ASCII punctuation but for the apostrophe.
LETTERS = ~BETWEEN
LETTERS[0x80:], LETTERS[ord("0") : ord("9") + 1] = False, False
MARKS = BETWEEN & ~WHITE
MARKS[:0x21], MARKS[0x7F], MARKS[ord("'")] = False, False, False


@dataclass
class Pieces:
    """Pieces of consecutive texts, which cover all bytes of data: piece i is data[bounds[i]:bounds[i+1]], and text d has the pieces first[d]:first[d+1]."""

    data: np.ndarray
    bounds: np.ndarray
    first: np.ndarray

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that name each piece: a hash and its size, which are one piece's alone up to 8 bytes; for longer ones two independent hashes."""
        start, end = self.bounds[:-1], self.bounds[1:]
        check = (end - start).astype(U64)
        long = np.flatnonzero(check > 8)
        check[long] = hash_runs(self.data, start[long], end[long], SEEDS[1])
        return hash_runs(self.data, start, end), check

    def cut_from_others(self, some: np.ndarray) -> np.ndarray:
        """Whether each of some pieces, between others of this sort, is cut from them: it begins with white space and ends with another ASCII character."""
        last = self.data[self.bounds[some + 1] - 1]
        return WHITE[self.data[self.bounds[some]]] & (last < 0x80) & ~WHITE[last]


def of_runs(values: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + counts[i]] of all i, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(start - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def find_pieces(texts: pa.Array) -> Pieces:
    """Cuts texts where the byte-level pre-tokenizer always cuts them: at white space after an ASCII character that is none,
    at a single space between a non-ASCII and an ASCII character that is no white space, and between an ASCII letter
    and ASCII punctuation other than an apostrophe. A piece is mostly a word and the white space before it."""
    data, offsets = bytes_of(texts)
    white, high = WHITE[data], data >= 0x80
    begin = np.zeros(len(data), bool)
    begin[1:] = white[1:] & ~white[:-1] & ~high[:-1]
    begin[1:-1] |= (data[1:-1] == 0x20) & high[:-2] & ~white[2:] & ~high[2:]
    begin[1:] |= LETTERS[data[:-1]] & MARKS[data[1:]]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begin)
    return Pieces(data, np.append(start, len(data)).astype(np.int64), np.searchsorted(start, offsets))


class Known:
    """Numbers pieces in order of entry by their two names, in an open hash table of numpy arrays."""

    def __init__(self, key: np.ndarray | None = None, check: np.ndarray | None = None):
        self.key, self.check = np.zeros(0, U64), np.zeros(0, U64)
        self.slots = np.full(1 << 10, -1, np.int32)
        if key is not None:
            self.add(key, check)

    def __len__(self) -> int:
        return len(self.key)

    def __contains__(self, piece: bytes) -> bool:
        one = Pieces(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), np.array([0, 1]))
        return bool(self.find(*one.names())[0] >= 0)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> U64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 of those that are not known."""
        out, left, slot = np.full(len(key), -1, np.int64), np.arange(len(key)), self._slot(key)
        while len(left) and len(self):
            n = self.slots[slot]
            used = n >= 0
            same = used & (self.key[n] == key[left]) & (self.check[n] == check[left])
            out[left[same]] = n[same]
            on = used & ~same
            left, slot = left[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def add(self, key: np.ndarray, check: np.ndarray) -> None:
        """Enters distinct pieces that are not known; at least three slots of four stay free."""
        new = np.arange(len(self.key), len(self.key) + len(key), dtype=np.int32)
        self.key, self.check = np.concatenate([self.key, key]), np.concatenate([self.check, check])
        if 4 * len(self.key) > len(self.slots):
            self.slots = np.full(1 << (4 * len(self.key)).bit_length(), -1, np.int32)
            new = np.arange(len(self.key), dtype=np.int32)
        slot = self._slot(self.key[new])
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            on = self.slots[slot] != new
            new, slot = new[on], (slot[on] + 1) & (len(self.slots) - 1)


class Encoder:
    """Encodes a text piece by piece and each distinct piece once; known pieces stay in memory, up to about `limit`. Beyond it
    those that came in several calls stay, up to half of that, so that the many that come once don't push out the common ones.

    Strings of the tokenizer's added tokens (like <|endoftext|>) get those tokens, as the tokenizer does by itself; texts that hold one are
    encoded whole. With added_as_text they are ordinary text.
    """

    def __init__(self, vocabulary: str, limit: int = 1 << 18, together: int = 64, added_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = added_as_text
        self.encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.dtype = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # Each character of a byte-level token stands for one byte.
        described = json.loads(vocabulary)
        self.added = [] if added_as_text else [x["content"] for x in described.get("added_tokens") or []]
        tokens = described["model"]["vocab"]
        self.n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
        self.n_bytes[list(tokens.values())] = list(map(len, tokens))
        self.limit, self.together = limit, together
        self.known = Known()
        self.ids = np.zeros(0, self.dtype)
        self.bounds = np.zeros(1, np.int64)
        self.calls = np.zeros(0, np.int32)

    def forget(self) -> None:
        """Keeps of the known pieces those of several calls, the most frequent ones if they are too many; older calls count half."""
        kept = np.flatnonzero(self.calls > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-self.calls[kept], kind="stable")[: self.limit // 2]])
        self.known = Known(self.known.key[kept], self.known.check[kept])
        counts = np.diff(self.bounds)[kept]
        self.ids = of_runs(self.ids, self.bounds[kept], counts)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.calls = self.calls[kept] // 2

    def learn(self, pieces: Pieces, fresh: np.ndarray) -> np.ndarray:
        """Encodes further pieces; those that are cut from one another there, too, many in one text. Returns them in the order in which they are kept."""
        cut = pieces.cut_from_others(fresh)
        n_joint = int(cut.sum())
        fresh = np.concatenate([fresh[cut], fresh[~cut]])
        sizes = np.diff(pieces.bounds)[fresh]
        data, wanted = of_runs(pieces.data, pieces.bounds[fresh], sizes).tobytes(), np.cumsum(sizes)
        ends = wanted[np.union1d(np.arange(self.together - 1, n_joint, self.together), np.arange(max(0, n_joint - 1), len(fresh)))].tolist()
        found = np.concatenate([np.array(x, self.dtype) for x in self.encode([data[a:b].decode() for a, b in itertools.pairwise([0, *ends])])])
        ends = np.cumsum(self.n_bytes[found])
        last = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[np.minimum(last, len(ends) - 1)], wanted):
            raise ValueError("the tokenizer is not byte-level BPE that cuts texts at white space")
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + last + 1])
        self.ids = np.concatenate([self.ids, found])
        return fresh

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Pieces]:
        """The ids of all texts, each text's bounds in them, and the pieces of those without added tokens."""
        odd = np.zeros(len(texts), bool)
        for content in self.added:
            odd |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.by_pieces(texts)
        ids, bounds, pieces = self.by_pieces(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts))
        at = np.flatnonzero(odd)
        own = [np.array(self.encode([texts[i].as_py()])[0], self.dtype) for i in at.tolist()]
        sizes = np.diff(bounds)
        sizes[at] = list(map(len, own))
        between = np.split(ids, bounds[at])  # the odd texts have no ids there
        parts = [part for pair in itertools.zip_longest(between, own) for part in pair if part is not None]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), pieces

    def by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Pieces]:
        """The same of texts without added tokens."""
        pieces = find_pieces(texts)
        if len(pieces.bounds) < 2:
            return np.zeros(0, self.dtype), np.zeros(len(pieces.first), np.int64), pieces
        if len(self.known) > self.limit:
            self.forget()
        key, check = pieces.names()
        piece = self.known.find(key, check)
        missed = np.flatnonzero(piece < 0)
        if len(missed):
            order = missed[np.lexsort((check[missed], key[missed]))]
            new = np.ones(len(order), bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            fresh = self.learn(pieces, order[new])
            self.known.add(key[fresh], check[fresh])
            piece[missed] = self.known.find(key[missed], check[missed])
        called = np.zeros(len(self.known), bool)
        called[piece] = True
        self.calls = np.concatenate([self.calls, np.zeros(len(self.known) - len(self.calls), np.int32)]) + called
        counts = np.diff(self.bounds)[piece]
        return of_runs(self.ids, self.bounds[piece], counts), np.concatenate([[0], np.cumsum(counts)])[pieces.first], pieces


def encoder(vocabulary: str) -> Encoder:
    cache = process_cache()
    if cache.get("vocabulary") != vocabulary:
        cache["vocabulary"], cache["encoder"] = vocabulary, Encoder(vocabulary, limit=1 << 19)  # some 50 bytes a piece
    return cache["encoder"]


def drop_encoder() -> None:
    """Frees what encoder() keeps in this process."""
    cache = process_cache()
    for name in ("vocabulary", "encoder"):
        cache.pop(name, None)

"""Substring dedup by level-wise doubling.

Windows repeated at one length alone are extended to (at most) twice that length, level by level, until the
wanted length is reached; where no candidate survives, the levels left have nothing to report. Texts are dealt
once into blocks. At every level a block reports each window hash once, with the smallest document id it has
there; one shuffle by hash brings the reports of all blocks together, so a window that a third of all documents
share costs one row a block, and the answers go back to the blocks that need them.

Below the wanted length, only the short window with the least hash in each surviving long one is reported (at
the first level of 13, one in about four). Equal long windows choose equally, so no repeated one is missed.
Short windows only pick candidates, by 48 bits; windows of the wanted length are told apart by 96 bits. Reports
travel as few numbers: a block and a flag, or a block and half a hash, share one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import shuffle_partitions
from .words import U64, Words, find_words, room, windows

#: The id that stands for a null one: larger than all others.
NO_ID = (1 << 63) - 1


def lengths(window: int, shortest: int = 7) -> list[int]:
    """The lengths of the levels: the last is `window`, each at most twice the one before, the first at least `shortest` if possible."""
    out = [window]
    while math.ceil(out[0] / 2) >= shortest:
        out.insert(0, math.ceil(out[0] / 2))
    return out


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of `window` words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if with_text, kept_text (kept words joined by one
    space). Windows are judged on the input. A null text has no words. Null ids count as larger than all
    others; rows that share an id are one document (none is smaller). Texts shorter than a window keep all
    words. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(4 * shuffle_partitions(spark), math.ceil(total / block_bytes))
    # By the text, too: neither null ids nor one repeated id make a large block.
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    by_block = docs.groupBy("block")
    levels, told = lengths(window)[:-1], None

    def reports(function, schema: str) -> DataFrame:
        if told is None:
            return by_block.applyInArrow(lambda key, table: function(key, table, None), schema)
        return by_block.cogroup(told.groupBy("block")).applyInArrow(lambda key, table, known: function(key, table, known), schema)

    for n in range(len(levels)):
        found = reports(lambda key, table, known, n=n: _anchors(key, table, known, window, levels[: n + 1]), "h long, whence long")
        # A block that has a window in several documents knows that it is repeated; the others are told.
        repeated = found.withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1 and whence % 2 = 0").select(F.shiftright("whence", 1).cast("int").alias("block"), F.lit(n).alias("level"), "h")
        told = repeated if told is None else told.unionAll(repeated)

    found = reports(lambda key, table, known: _candidates(key, table, known, window, levels), "h long, whence long, least long")
    # Dealt by h as they are; the two halves of whence are parted only behind the shuffle.
    found = found.repartition("h").select("h", F.shiftright("whence", 32).cast("int").alias("block"), F.col("whence").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tail"), "least")
    # Where another block has a smaller id than all of a block's own, all its occurrences go.
    earlier = found.withColumn("first", F.min("least").over(Window.partitionBy("h", "tail"))).filter("first < least").select("block", "h", "tail")

    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_block.cogroup(earlier.groupBy("block")).applyInArrow(lambda key, table, known: _cut(table, known, window, with_text), fields)


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, Words]:
    """A block's rows by id, so that the first of equal windows has the smallest id."""
    ids = table.column("doc_id").combine_chunks()
    order = np.argsort(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), kind="stable")
    table = table.take(pa.array(order))
    return table, table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False), find_words(table.column("text"), check=True)


def _least(words: Words, starts: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a whole window the place of its least short window; the hashes of all short windows."""
    hashed = windows(words.hash, short)
    if not len(starts):
        return starts, hashed
    inner = np.lib.stride_tricks.sliding_window_view(hashed, window - short + 1)
    return inner.argmin(axis=1)[starts] + starts, hashed


def _groups(keys: np.ndarray, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of keys (and tails), and the first and last place of each distinct one in it."""
    order = np.argsort(keys, kind="stable") if tails is None else np.lexsort((tails, keys))
    differ = np.diff(keys[order]) != 0
    if tails is not None:
        differ |= np.diff(tails[order]) != 0
    new = np.flatnonzero(np.concatenate([[True], differ])) if len(keys) else np.zeros(0, np.int64)
    return order, new, np.concatenate([new[1:], [len(keys)]]) - 1 if len(new) else new


def _shared(words: Words, ids: np.ndarray, places: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes at places, and whether each occurs in documents of different ids."""
    at = np.unique(places)
    owner = ids[words.text_of[at]]
    order, new, last = _groups(hashed[at])
    return hashed[at][order[new]], owner[order[new]] != owner[order[last]]


def _short(words: Words, starts: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """What _least() gives, with 48 bits of each hash."""
    places, hashed = _least(words, starts, window, short)
    return places, hashed >> U64(16)


def _surviving(words: Words, ids: np.ndarray, window: int, levels: list[int], known: pa.Table | None) -> np.ndarray:
    """Starts of whole windows whose least short windows of all these levels are repeated."""
    starts = np.flatnonzero(room(words.first) >= window)
    for n, short in enumerate(levels):
        places, hashed = _short(words, starts, window, short)
        found, several = _shared(words, ids, places, hashed)
        told = known.column("h").to_numpy().view(U64)[known.column("level").to_numpy() == n]
        starts = starts[np.isin(hashed[places], np.concatenate([found[several], told]))]
    return starts


def _anchors(key: tuple, table: pa.Table, known: pa.Table | None, window: int, levels: list[int]) -> pa.Table:
    _, ids, words = _in_order(table)
    places, hashed = _short(words, _surviving(words, ids, window, levels[:-1], known), window, levels[-1])
    found, several = _shared(words, ids, places, hashed)
    return pa.table({"h": found.view(np.int64), "whence": 2 * key[0].as_py() + several.astype(np.int64)})


def _whole(words: Words, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each whole window: a hash of its words, and half of one of their second hashes."""
    return windows(words.hash, window)[starts], (windows(words.check, window)[starts] >> U64(32)).astype(np.uint32)


def _candidates(key: tuple, table: pa.Table, known: pa.Table | None, window: int, levels: list[int]) -> pa.Table:
    _, ids, words = _in_order(table)
    starts = _surviving(words, ids, window, levels, known)
    whole, tail = _whole(words, window, starts)
    order, new, _ = _groups(whole, tail)
    first = order[new]
    return pa.table({"h": whole[first].view(np.int64), "whence": (key[0].as_py() << 32) + tail[first].astype(np.int64), "least": ids[words.text_of[starts]][first]})


def _cut(table: pa.Table, known: pa.Table, window: int, with_text: bool) -> pa.Table:
    table, ids, words = _in_order(table)
    starts = np.flatnonzero(room(words.first) >= window)
    whole, tail = _whole(words, window, starts)
    owner = ids[words.text_of[starts]]
    order, new, last = _groups(whole, tail)
    least = np.empty(len(whole), np.int64)
    least[order] = np.repeat(owner[order[new]], last - new + 1)
    told, told_tail = known.column("h").to_numpy().view(U64), known.column("tail").to_numpy()
    repeated = least < owner
    if len(told) and len(whole):
        by_hash = np.argsort(told, kind="stable")
        told, told_tail = told[by_hash], told_tail[by_hash]
        at, end = np.searchsorted(told, whole), np.searchsorted(told, whole, "right")
        while (at < end).any():  # once, unless answers share the first 64 bits
            here = np.minimum(at, len(told) - 1)
            repeated |= (at < end) & (told_tail[here] == tail)
            at += 1
    cover = np.zeros(len(words.hash) + 1, np.int64)
    repeated = starts[repeated]
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + window, -1)
    removed = np.cumsum(cover[:-1]) > 0

    # Kept bytes: those of kept words, and one for the space after each kept word that another follows.
    kept = np.flatnonzero(~removed)
    text_of = words.text_of[kept]
    followed = np.zeros(len(kept), bool)
    followed[:-1] = text_of[1:] == text_of[:-1]
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start[kept]] += 1
    edge[words.end[kept]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    data = words.data.copy()
    gaps = words.end[kept[followed]]
    mask[gaps] = True
    data[gaps] = 0x20
    out = data[mask]
    bounds = np.concatenate([[0], np.cumsum(mask)])[words.offsets]
    texts = [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    counts = np.concatenate([[0], np.cumsum(removed)])[words.first]
    result = {"doc_id": table.column("doc_id"), "n_words": np.diff(words.first), "n_removed": np.diff(counts), "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}
    if with_text:
        result["kept_text"] = pa.array([t.decode() for t in texts], pa.string())
    return pa.table(result)

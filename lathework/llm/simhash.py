"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits the variants within half the radius of itself; two fingerprints within the radius have a
variant in common, so a shuffle on variants brings them together. The radius 3 has no whole half, so a pair at
distance 3 needs two flips on one side and one on the other, which would be 2,081 variants of every fingerprint.
The work is therefore done in two rounds:

1. Bits are cut into blocks, and every fingerprint emits its variants with one flip, once for each block left out.
   Of three differing bits at least one lies in some block, and without it two are left, one flip on each side. A
   fingerprint that meets no other here has no link at all.
2. Those that met some emit their variants with up to one flip, and those of even weight also the ones with two
   flips in the same half of the bits (of three differing bits two lie in the same half, and of two fingerprints at an
   odd distance one has even weight). What meets at a variant is linked by the triangle inequality: everything to the
   least fingerprint within one flip of it. A variant has at most 2,081 fingerprints around it, and gives a star
   instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import remove, scratch, shuffle_partitions, written
from .words import U64, slices

BITS, RADIUS, SEED = 64, 3, 42
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: Fingerprints whose variants are made at once.
AT_ONCE = 512
ONE = np.array([1], U64)


def _pieces(text: bytes, step: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about `step` bytes that cut no word."""
    at = 0
    while at < len(text):
        end = at + step
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end]
        at = end


def bit_counts(text: bytes, size: int) -> tuple[np.ndarray, int]:
    """How many hashes of shingles have each bit set, and how many shingles there are. A bytes object's own lower() and
    split() know A to Z and the white space of words alone."""
    counts, n, carried = np.zeros(BITS, np.int64), 0, []
    hashed = lambda shingles, many: np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), U64, many)

    def add(hashes: np.ndarray) -> None:
        nonlocal n
        n += len(hashes)
        counts[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for piece in _pieces(text):
        words = carried + piece.lower().split()
        if len(words) >= size:
            add(hashed(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)), len(words) - size + 1))
        carried = words[max(0, len(words) - size + 1) :] if size > 1 else []
    if not n and carried:
        add(hashed([b" ".join(carried)], 1))
    return counts, n


def _marked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            bits = np.zeros((len(part), BITS), np.uint8)
            for row, text in enumerate(part.column("text")):
                counts, n = bit_counts((text.as_py() or "").encode(), size)
                bits[row] = 2 * counts > n
            prints = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "print"])


def masks(blocks: int) -> Iterator[tuple[int, int]]:
    """The bounds of each block of bits."""
    for i in range(blocks):
        yield BITS * i // blocks, BITS * (i + 1) // blocks


def masked_variants(prints: np.ndarray, blocks: int) -> np.ndarray:
    """prints x variants: without each block in turn, as it is and with one flip; the block's number fills the place it leaves."""
    out = []
    for number, (low, high) in enumerate(masks(blocks)):
        width = BITS - (high - low)
        below = prints & U64((1 << low) - 1)
        above = (prints >> U64(high)) << U64(low) if high < BITS else np.zeros_like(prints)
        flips = np.concatenate([np.zeros(1, U64), ONE << np.arange(width, dtype=U64)])
        out.append((below | above | U64(number << width))[:, None] ^ flips)
    return np.concatenate(out, axis=1)


NEAR = np.concatenate([np.zeros(1, U64), ONE << np.arange(BITS, dtype=U64)])
FAR = np.array([1 << i | 1 << j for half in (range(BITS // 2), range(BITS // 2, BITS)) for i, j in combinations(half, 2)], U64)


def _emitted(batches: Iterator[pa.RecordBatch], blocks: int | None) -> Iterator[pa.RecordBatch]:
    """(variant, print) of the first round; with (variant, print, far) of the second one if blocks is None."""

    def rows(prints: np.ndarray, variants: np.ndarray, far: bool) -> pa.RecordBatch:
        columns = {"variant": variants.ravel().view(np.int64), "print": np.repeat(prints, variants.shape[1]).view(np.int64)}
        if blocks is None:
            columns["far"] = np.full(variants.size, far)
        return pa.record_batch({k: pa.array(v) for k, v in columns.items()})

    for batch in batches:
        found = batch.column("print").to_numpy(zero_copy_only=False).view(U64)
        for at in range(0, len(found), AT_ONCE):
            prints = found[at : at + AT_ONCE]
            if blocks:
                yield rows(prints, masked_variants(prints, blocks), False)
            else:
                yield rows(prints, prints[:, None] ^ NEAR, False)
                even = prints[np.bitwise_count(prints) % 2 == 0]
                yield rows(even, even[:, None] ^ FAR, True)


def print_links(prints: DataFrame, blocks: int = 4) -> DataFrame:
    """(a, b) pairs of distinct fingerprints at a distance of 1 to 3 that connect all that are so linked.

    prints(print long) must be distinct. Not every linked pair is given: of those that meet at a variant each is linked with the least one.
    """
    around = Window.partitionBy("variant")
    # The fingerprints are few bytes, their variants many: without a number of partitions a few tasks would make them all.
    dealt = lambda table: table.repartition(shuffle_partitions(prints.sparkSession), "print")
    first = dealt(prints).mapInArrow(lambda batches: _emitted(batches, blocks), "variant long, print long")
    met = first.withColumn("n", F.count("*").over(around)).filter("n > 1").select("print").distinct()
    second = dealt(written(met, "met")).mapInArrow(lambda batches: _emitted(batches, None), "variant long, print long, far boolean")
    stars = second.withColumn("a", F.min(F.when(~F.col("far"), F.col("print"))).over(around)).filter("a <> print")
    return stars.select("a", F.col("print").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def simhash_components(docs: DataFrame, size: int = 3, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links lead to).

    A fingerprint has a bit set if over half the hashes of a text's `size`-word shingles have it, repeats included; letters
    A to Z count as small. Fingerprints link at 3 or fewer differing bits. blocks sets how many bits the first
    round must agree in (48 of 64 with 4); 5 or 6 keep it selective beyond some ten billion texts.

    A null or empty text has the fingerprint zero, which links like any other; one with fewer words than a shingle is
    one shingle. Repeated rows and rows that share an id or a text stay rows of their own. A null id is never the
    smallest: its row has the component of its fingerprint, null if no row there has an id. An empty table gives an
    empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        marked = written(docs.mapInArrow(lambda batches: _marked(batches, size), "doc_id long, print long"), "marked")
        groups = written(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "groups")
        links = written(print_links(groups.select("print"), blocks), "links")
        labels = connected_components(links).withColumnRenamed("id", "print")
        joined = groups.join(labels, "print")
        roots = joined.groupBy("component").agg(F.min("least").alias("root"))
        moved = written(joined.join(roots, "component").select("print", "root"), "roots")
        remove(links)
        classes = written(groups.join(moved, "print", "left").select("print", F.coalesce("root", "least").alias("component_id")), "classes")
        keep(marked, classes)
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return marked.join(classes, "print").select("doc_id", shown, "component_id")

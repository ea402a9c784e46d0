"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification, components.

Each element (a word shingle) is a region as high as its weight. Darts fall on it as a hashed Poisson
process in rank order, so equal elements get equal darts in every document; a dart names one coordinate
of the signature, which keeps its earliest dart. About k (ln k + 3) darts fall on a document, however
many elements it has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import remove, scratch, small_batches, written
from .words import STEP, U64, find_words, mix, room, slices, windows

COORD, HEIGHT, BAND = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """n signatures of k ranks: the earliest dart in each coordinate among the elements of each owner.

    Weights above 0. The region of an element is cut into layers [0, 1), [1, 2), [2, 4), ... so that a
    larger weight adds layers and changes none below; a dart higher than the weight misses.
    Two owners agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    total = np.bincount(owner, weights, n)
    out = np.full((n, k), np.inf)
    layers = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64) + 1
    at = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer > 0, 2.0 ** (layer - 1), 0.0)
    width = np.where(layer > 0, low, 1.0)
    all_keys, all_owner, all_weight = mix(elements[at] + layer.astype(U64) * U64(STEP)), owner[at], weights[at]
    open_, reach = total > 0, (math.log(k) + 3) / np.maximum(total, 1e-300)
    flat = out.reshape(-1)
    while open_.any():
        some = open_[all_owner]
        keys, own, weight, lo, high = all_keys[some], all_owner[some], all_weight[some], low[some], width[some]
        rank, throw = np.zeros(len(keys)), 0
        while len(keys):
            throw += 1
            dart = mix(keys + U64(throw * STEP & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log1p(-uniform(dart)) / (k * high)
            near = rank <= reach[own]
            keys, own, weight, lo, high, rank, dart = keys[near], own[near], weight[near], lo[near], high[near], rank[near], dart[near]
            hit = (lo + high * uniform(mix(dart ^ HEIGHT))) < weight
            np.minimum.at(flat, own[hit] * k + (mix(dart[hit] ^ COORD) % U64(k)).astype(np.int64), rank[hit])
        open_ &= ~np.isfinite(out).all(axis=1)
        reach = np.where(open_, reach * 2, reach)
    return out


def shingles(words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words and their texts; a shorter text with a word is one shingle."""
    left, counts, text_of = room(words.first), np.diff(words.first), words.text_of
    whole = np.flatnonzero(left >= size)
    hashed, owner = windows(words.hash, size)[whole], text_of[whole]
    for n in range(1, size):
        few = words.first[:-1][counts == n]
        if len(few):
            hashed = np.concatenate([hashed, mix(windows(words.hash, n)[few] + U64(n))])
            owner = np.concatenate([owner, text_of[few]])
    return hashed, owner


def counted(hashed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements by owner and hash, and how many of the same hash each has before it."""
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(hashed))
    return hashed, owner, at - np.maximum.accumulate(np.where(new, at, 0))


def _sign(batches, size: int, bands: int, rows: int, weighted: bool):
    for batch in batches:
        for part in slices(batch):
            words = find_words(part.column("text"))
            hashed, owner = shingles(words, size)
            n = len(part)
            # Unweighted, repeats of a shingle in a text throw the same darts; only the count of darts depends on them.
            weights = np.ones(len(hashed))
            if weighted:
                hashed, owner, nth = counted(hashed, owner)
                last = np.append(nth[1:] == 0, True) if len(nth) else nth.astype(bool)
                hashed, owner, weights = hashed[last], owner[last], nth[last] + 1.0
            ranks = dart_signatures(hashed, weights, owner, n, bands * rows).view(U64).reshape(n, bands, rows)
            keys = np.broadcast_to(np.arange(bands, dtype=U64) * BAND, (n, bands))
            for j in range(rows):
                keys = mix(keys * U64(STEP) + ranks[:, :, j])
            some = np.diff(words.first) > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            bounds = words.offsets
            text_keys = [xxhash.xxh3_128_digest(words.data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(text_keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1).view(np.int64)))],
                names=["doc_id", "text_key", "bands"],
            )


def _sets(batches, size: int, weighted: bool):
    """The distinct shingles of each text; weighted, a further occurrence of one is an element of its own."""
    for batch in batches:
        for part in slices(batch):
            hashed, owner, nth = counted(*shingles(find_words(part.column("text")), size))
            new = nth == 0
            if weighted:
                hashed, new = np.where(new, hashed, mix(hashed + nth.astype(U64) * U64(STEP))), np.ones(len(nth), bool)
            offsets = np.searchsorted(owner[new], np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed[new].view(np.int64)))], names=["doc_id", "elements"])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float, weighted: bool) -> DataFrame:
    """Those of pairs(a, b) whose shingle sets have at least the wanted Jaccard similarity.

    texts has the documents' texts, or already their sets as elements.
    """
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = texts.join(ids, "doc_id", "left_semi")
    if "elements" not in texts.columns:
        sets = sets.mapInArrow(lambda batches: _sets(batches, size, weighted), "doc_id long, elements array<long>").dropDuplicates(["doc_id"])
    sets = written(sets, "sets")
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("elements").alias(f"of_{c}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    alike = common >= F.lit(threshold) * (F.size("of_a") + F.size("of_b") - common)
    # The sizes alone rule out many pairs before the sets are shuffled.
    sizes = lambda c: sets.select(F.col("doc_id").alias(c), F.size("elements").alias(f"n_{c}"))
    near = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")).select("a", "b")
    out = written(near.join(side("a"), "a").join(side("b"), "b").filter(alike).select("a", "b"), "links")
    for table in (pairs, ids, sets):
        remove(table)
    return out


def _mixed(places: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of places(place, doc_id) whose place holds documents of several classes, with their component."""
    placed = written(places.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed")
    several = placed.groupBy("place").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("place")
    return placed.join(written(several, "several"), "place", "left_semi")


def _needed(n, m, threshold: float) -> F.Column:
    """How many elements sets of n and m elements have in common at least, if their Jaccard similarity is the threshold."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(place, doc_id, n, left): each document at those of its elements by which any similar one must be met.

    With elements in order of frequency, rarest first, the first element that two sets share has all others
    they share behind it. left counts those from there on: it bounds what a pair that first meets there can
    have in common. Elements of one document alone meet none, but come first.
    """
    entries = sets.select("doc_id", F.size("elements").alias("n"), F.explode("elements").alias("place"))
    frequent = written(entries.groupBy("place").agg(F.count("*").alias("df")).filter("df > 1"), "frequent")
    by_doc = Window.partitionBy("doc_id").orderBy(F.col("df").desc(), F.col("place").desc())
    met = entries.join(frequent, "place").withColumn("left", F.row_number().over(by_doc))
    return met.filter(F.col("left") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).select("place", "doc_id", "n", "left")


def _meeting(places: DataFrame, threshold: float) -> DataFrame:
    """Without documents that have too little left at a place to be similar to even the smallest set there."""
    smallest = written(places.groupBy("place").agg(F.min("n").alias("smallest")), "smallest")
    return places.join(smallest, "place").filter(_needed(F.col("n"), F.col("smallest"), threshold) <= F.col("left")).drop("smallest")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes(id, component) after further links: only the components that they connect are labelled anew."""
    label = lambda c: classes.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    roots = connected_components(between)
    moved = classes.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return written(moved.unionByName(roots.join(classes.select("id"), "id", "left_anti")), "classes")


def _classes(known: DataFrame, threshold: float, size: int, bands: int, rows: int, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy_of, bands) of all documents and (id, component) of those with links, as written tables."""
    signed = written(known.mapInArrow(lambda batches: _sign(batches, size, bands, rows, weighted), "doc_id long, text_key binary, bands array<long>"), "signed")
    copies = written(signed.groupBy("text_key").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("other")).filter("copy_of < other").drop("other"), "copies")
    members = signed.join(copies, "text_key", "left").select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), "bands")
    members = written(members, "members")
    remove(signed)

    entries = members.filter("doc_id = copy_of").select("doc_id", F.explode("bands").alias("bucket"))
    full = written(entries.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("other")).filter("centre < other").drop("other"), "full")
    buckets = written(entries.join(full, "bucket").select("bucket", "doc_id", "centre"), "buckets")
    remove(full)
    stars = buckets.filter("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    classes = connected_components(_verified(stars, known, size, threshold, weighted))

    mixed = _mixed(buckets.select(F.col("bucket").alias("place"), "doc_id"), classes)
    rest = written(known.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(lambda batches: _sets(batches, size, weighted), "doc_id long, elements array<long>").dropDuplicates(["doc_id"]), "rest")
    open_ = written(_prefixes(rest, threshold), "prefixes")
    remove(buckets)
    # Members become centres in order of a random number, the same at all their places, so that pairs repeat and no place
    # needs sorting: upto is the share asked so far.
    open_ = open_.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    asked, more = known.sparkSession.range(0).select(F.col("id").alias("place"), F.lit(0.0).alias("upto")), 8
    while True:
        open_ = written(_meeting(_mixed(open_, classes), threshold), "open")
        waiting = open_.join(asked, "place", "left").withColumn("upto", F.coalesce("upto", F.lit(0.0)))
        now = written(waiting.groupBy("place").agg(F.max("u").alias("u"), F.max("upto").alias("upto"), (more / F.count("*")).alias("share")).filter("u >= upto").drop("u"), "shares")
        if not now.limit(1).count():
            break
        centres = open_.join(now, "place").filter("u >= upto and u < share")
        centres = written(centres.select("place", F.col("doc_id").alias("centre"), F.col("component").alias("other"), F.col("n").alias("centre_n"), F.col("left").alias("centre_left")), "centres")
        possible = (F.col("component") != F.col("other")) & (_needed(F.col("n"), F.col("centre_n"), threshold) <= F.least("left", "centre_left"))
        pairs = open_.join(centres, "place").filter(possible).select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
        classes = _merged(classes, _verified(pairs, rest, size, threshold, weighted))
        asked = written(asked.unionByName(now.select("place", F.col("share").alias("upto"))).groupBy("place").agg(F.max("upto").alias("upto")), "asked")
        open_, more = open_.drop("component"), more * 8
    return members, classes


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 32, rows: int = 6, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, copy_of (smallest id with the same text) and class_id (smallest id of its class).

    Classes are the connected components of links between documents whose sets of `size`-word shingles
    have a Jaccard similarity of at least `threshold`, verified exactly; weighted, shingles weigh as often as they
    occur, and the similarity is the sum of the lesser weights over that of the greater ones. Candidates share a band of the
    signature. At the defaults a pair of similarity 0.8 misses every band with probability 6e-5.
    Within a bucket, documents are compared with the smallest id, not each with each. Documents of buckets
    that then still hold several classes are met again at their rarest shingles, where any pair of the wanted
    similarity must meet; there they are compared across classes with about 8, 64, 512, ... centres, until every
    member of a place with several classes was one. No bucket and no place is capped.

    Null texts and texts without words are copies of equal texts only (null counts as empty). A shorter
    text than a shingle is one shingle. Rows sharing an id are one document. A null id stays in the
    result, in no class. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.filter("doc_id is not null")
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        members, classes = _classes(known, threshold, size, bands, rows, weighted)
        keep(members, classes)
    classes = classes.withColumnRenamed("id", "copy_of")
    # Ids outside any link are their own class; the join by copy_of can be split where a text has very many copies.
    result = members.select("doc_id", "copy_of").join(classes, "copy_of", "left").select("doc_id", "copy_of", F.coalesce("component", "copy_of").alias("class_id"))
    unknown = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("long").alias("class_id"))
    return result.unionByName(unknown)


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its class; of rows that share an id, that
    whose columns, written as JSON, come first.

    Rows with a null id stay. Columns pass through, whatever their names. An empty table gives an empty result.
    settings are those of near_duplicates().
    """
    key = docs[id_col].cast("long")
    classes = written(near_duplicates(docs, id_col=id_col, **settings), "classes")
    gone = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone, key == gone["gone_id"], "left_anti")
    shared = written(classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("shared_id")), "shared")
    if not shared.limit(1).count():
        return kept
    row = F.struct(*docs.columns)
    once = kept.join(shared, key == shared["shared_id"], "left_semi").groupBy(F.col(id_col).cast("long").alias("key")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(shared, key == shared["shared_id"], "left_anti").unionByName(once)

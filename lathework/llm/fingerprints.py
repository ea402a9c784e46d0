"""Document fingerprints from closed syncmers.

A k-mer of tokens is chosen if the least of the hashed s-mers inside it is its first or its last one. That
depends on the k-mer alone, so texts that share a passage choose the same anchors in it, at the same distances
from one another. A fingerprint is the whole sequence of anchors, each with its distance from the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import bound
from .storage import shuffle_partitions, written

WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a k-mer and of an s-mer inside it.
K, S = 5, 2


def tokens(text) -> F.Column:
    """The words of a text; its characters if it has fewer words than a k-mer."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return bound(words, lambda found: F.when(F.size(found) >= K, found).otherwise(F.filter(F.split(text, ""), lambda c: c != "")))


def smers(words) -> F.Column:
    """The hashes of all runs of S tokens."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - S), lambda i: F.xxhash64(*(F.get(words, i + d) for d in range(S))))
    return F.when(F.size(words) >= S, hashed).otherwise(F.array().cast("array<bigint>"))


def syncmers(hashed) -> F.Column:
    """array<struct(at, hash)> of the closed syncmers, from the hashes of a text's s-mers."""
    inner = K - S + 1
    s = lambda i, d: F.get(hashed, i + d)
    edge = lambda i: F.least(s(i, 0), s(i, inner - 1)) <= F.least(*(s(i, d) for d in range(1, inner - 1)))
    whole = lambda i: F.xxhash64(*(s(i, d) for d in range(0, inner, S)), s(i, inner - 1))
    starts = F.sequence(F.lit(0), F.size(hashed) - inner)
    found = F.transform(F.filter(starts, edge), lambda i: F.struct(i.alias("at"), whole(i).alias("hash")))
    return F.when(F.size(hashed) >= inner, found).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def anchors_of(text) -> F.Column:
    """array<struct(at, hash)>: the closed syncmers of a text. One too short for a k-mer has the hash of the whole; an empty one none."""
    whole = F.when(text != "", F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(text).alias("hash")))).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))
    found = bound(tokens(text), lambda words: bound(smers(words), syncmers))
    return bound(found, lambda all_: F.when(F.size(all_) > 0, all_).otherwise(whole))


def codes(text) -> F.Column:
    """The anchors of a text in order, as numbers: 32 bits of the hash below the distance from the anchor before.

    The first has distance 0. Closed syncmers are never more than K - S tokens apart, so a distance is one hex digit.
    """

    def code(all_):
        gap = lambda x, j: x["at"] - F.coalesce(F.get(all_, j - 1)["at"], x["at"])
        return F.transform(all_, lambda x, j: F.shiftleft(gap(x, j).cast("long"), 32) + x["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))

    return bound(anchors_of(text), code)


def likeness(a, b) -> F.Column:
    """The Jaccard similarity of the distinct codes of two texts: anchors count as shared at the same distance from the one before."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def as_text(found) -> F.Column:
    """Each code as 9 hex digits, one after the other."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), 9, "0")), "")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs with `codes` and `fingerprint` (the codes as text), which replace any of those names.

    Texts with fewer than K words are taken by characters, those with fewer than K characters whole; a null text is
    empty and has no code. Repeated rows get a fingerprint each. An empty table gives an empty result.
    """
    rows = docs.withColumn("codes", codes(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return rows.withColumn("fingerprint", as_text(F.col("codes")))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, hash) of every anchor, for positional matching of passages by a join on hash.

    Null and empty texts have none, null ids stay, repeated rows give theirs each, an empty table gives an empty result.
    """
    found = anchors_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("x")).select("doc_id", "x.at", "x.hash")


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids: the next smaller id, and after the smallest the largest.

    Ids are dealt into ranges; only the ranges' ends meet in one task.
    """
    spark = ids.sparkSession
    ranges = written(ids.select("doc_id").repartitionByRange(shuffle_partitions(spark), "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranges.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    everywhere = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("high").over(everywhere.orderBy("part")), F.max("high").over(everywhere))
    ends = ends.select(F.col("low").alias("doc_id"), before.alias("outside"))
    inside = ranges.withColumn("inside", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(ends, "doc_id", "left").select("doc_id", F.coalesce("inside", "outside").alias("next_id"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to the edited and to the next one.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document in descending order of id; after the last comes the first. A null text is empty. Of rows
    that share an id, the least text stands for the next document, and each gets its own row. A document with
    a null id has no next one: its last third is cut and its likeness to the next is 0. Texts with fewer than K
    words are taken by characters. An empty table gives an empty result. Other columns are not read.
    """
    # Renamed, so that both joins below read one and the same shuffle of the texts by id.
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.filter("_id is not null")
    lengths = written(known.groupBy(F.col("_id").alias("doc_id")).agg(F.max(F.length("text")).alias("n")), "lengths")
    order = following(lengths).join(lengths, "doc_id").select(F.col("next_id").alias("_id"), F.col("doc_id").alias("reader"), F.floor(F.col("n") / 3).cast("int").alias("wanted"))
    order = written(order, "order")
    given = known.join(order, "_id").withColumn("next_codes", codes(F.col("text")))
    given = given.select(F.col("reader").alias("_id"), F.struct(F.expr("substring(text, 1, wanted)").alias("head"), "next_codes").alias("given"))
    given = given.groupBy("_id").agg(F.min("given").alias("given")).select("_id", "given.head", "given.next_codes")
    rows = known.join(given, "_id")
    none = docs.filter("_id is null").withColumns({"head": F.lit(""), "next_codes": F.lit(None).cast("array<bigint>")})
    rows = rows.unionByName(none).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3)
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("head"), F.lit(1), third.cast("int"))))
    rows = rows.withColumns({"codes": codes(F.col("text")), "edited_codes": codes(F.col("edited"))})
    return rows.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        F.when(F.col("next_codes").isNull(), 0.0).otherwise(likeness(F.col("codes"), F.col("next_codes"))).alias("near_next"),
    )

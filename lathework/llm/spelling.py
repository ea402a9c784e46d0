"""Spelling variants: words that differ by one character, met as pairs of trie nodes.

All words stand in a trie, and all reversed words in another one. The characters before a place of a word lead to a
node of the first, those behind it to a node of the second, so a word with one place left out is a pair of
numbers. Words with the same pair around a left-out character differ in that character alone; a word with a pair
around a left-out character and one with the same pair around nothing differ by that character's insertion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch, shuffle_partitions, written

LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers of the two roots.
FORWARD, REVERSED = 0, 1
#: Rows of one Arrow batch.
BATCH = 1 << 16


def counted_words(docs: DataFrame, shortest: int = 6, fewest: int = 5, rate: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters with at least `shortest` code points that occur at least `fewest` times.

    A to Z are lower-cased. A run whose crc32, taken with the document's id, is divisible by `rate` loses one
    code point first (a rate of 0 leaves all as they are). Null texts have no words; a null id counts as an empty one; repeated
    rows count each.
    """
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTER}{{{max(1, shortest)},}}+"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if rate:
        hashed = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word")).alias("h"))
        lost = F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")
        runs = hashed.select(F.when(F.col("h") % rate == 0, lost).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def node_numbers(characters: str, root: int) -> list[int]:
    """The numbers of the trie nodes from the root on that the characters lead to.

    A node's number is the hash of its character, seeded with its parent's number: every task numbers the same node alike without
    asking another. Two pairs of different nodes have the same two numbers with a probability of 2**-128.
    """
    out = [root]
    for character in characters:
        out.append(xxhash.xxh64_intdigest(character.encode(), out[-1]))
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, behind, id, n, skips, first) of every place of every word.

    skips: a character lies between the two nodes; first: it differs from the one before it. Leaving out any of several equal
    characters in a row gives the same word, so only the first of them is compared with insertions.
    """
    rows: list[tuple[np.ndarray, ...]] = []

    def batch_of() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        rows.clear()
        return pa.record_batch([pa.array(c) for c in columns], ["before", "behind", "id", "n", "skips", "first"])

    held = 0
    for batch in batches:
        for word, id_, n in zip(batch.column("word"), batch.column("id").to_pylist(), batch.column("n").to_pylist(), strict=True):
            word = word.as_py()
            before = np.array(node_numbers(word, FORWARD), np.uint64).view(np.int64)
            behind = np.array(node_numbers(word[::-1], REVERSED), np.uint64).view(np.int64)[::-1]
            size = len(word)
            first = np.array([i == 0 or word[i] != word[i - 1] for i in range(size)], bool)
            many = 2 * size + 1
            rows.append((np.concatenate([before[:-1], before]), np.concatenate([behind[1:], behind]), np.full(many, id_), np.full(many, n), np.arange(many) < size, np.concatenate([first, np.ones(size + 1, bool)])))
            held += many
            if held >= BATCH:
                held = 0
                yield batch_of()
    if rows:
        yield batch_of()


def _neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have near words: their number, and (-n, id) of the most frequent one.

    No pair of words is a row: a word meets the others of a pair of nodes as one array. Those differ in a single character, so
    there are at most as many as there are letters, and one.
    """
    pair = Window.partitionBy("before", "behind")
    # The words are few bytes, their places more: without a number of partitions a few tasks would make them all.
    places = words.repartition(shuffle_partitions(words.sparkSession), "id").mapInArrow(_places, "before long, behind long, id long, n long, skips boolean, first boolean")
    met = places.withColumn("size", F.count("*").over(pair)).filter("size > 1")
    there = met.groupBy("before", "behind").agg(F.collect_list(F.struct((-F.col("n")).alias("fewer"), "id", "skips", "first")).alias("there"))
    near = "filter(there, y -> y.id <> x.id and (x.skips and y.skips or x.skips <> y.skips and x.first and y.first))"
    each = there.select("there", F.explode("there").alias("x")).select("x.id", F.expr(f"transform({near}, y -> struct(y.fewer, y.id))").alias("near"))
    return each.filter("size(near) > 0").groupBy("id").agg(F.sum(F.size("near")).alias("n_near"), F.min(F.array_min("near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms(id, form) -> (id, root): the form's form and so on, each round twice as far. Forms grow more frequent by a factor, so no chain is long."""
    reached = forms.select("id", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = written(reached.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = after.select("id", "root")
        if not after.filter("moved").limit(1).count():
            return reached


def spelling_variants(counted: DataFrame, ratio: int = 5) -> DataFrame:
    """counted(word, n) of distinct words -> word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its most frequent near word
    (of several the first in code-point order) if that is at least `ratio` (above 1) times as frequent, else null; its root is where its
    form's form and so on leads, the word itself without a form. A word of one code point has no pair with the empty word unless
    that is counted. Null words go. An empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms could lead in circles")
    with scratch(counted.sparkSession) as keep:
        # Sorted first, so that ids follow the code-point order and break ties without the strings.
        ordered = counted.filter("word is not null").select("word", "n").orderBy("word").withColumn("id", F.monotonically_increasing_id())
        words = written(ordered, "words")
        near = written(_neighbours(words).select("id", "n_near", (-F.col("best.fewer")).alias("best_n"), F.col("best.id").alias("best")), "near")
        known = words.join(near, "id", "left").withColumn("has_form", F.col("best_n") >= ratio * F.col("n"))
        rows = written(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has_form"), F.col("best")).alias("form")), "rows")
        roots = _roots(rows.filter("form is not null").select("id", "form"))
        keep(words, rows, roots)
    form = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    root = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    joined = rows.join(roots, "id", "left").join(form, "form", "left").join(root, "root", "left")
    return joined.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")

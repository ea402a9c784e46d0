"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch, small_batches, written
from .words import BETWEEN, STEP, U64, find_words, mix, room, slices

#: Distances between the two words of a feature: 1 is the bigram, the others are skip-grams; 0 is the word itself.
DISTANCES = (0, 1, 2, 3)


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-cased texts and the texts they are in, repeats included."""
    words = find_words(pc.utf8_lower(pc.fill_null(texts, "")), outside=BETWEEN)
    left, text_of = room(words.first), words.text_of
    found, owner = [], []
    for d in DISTANCES:
        at = np.flatnonzero(left > d)
        second = words.hash[at + d] if d else U64(0)
        found.append(mix(words.hash[at] * U64(STEP) + second + U64(d)) >> U64(64 - bits))
        owner.append(text_of[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def _examples(batches, bits: int):
    for batch in batches:
        for part in slices(batch):
            found, owner = features(part.column("text"), bits)
            pairs = np.unique((owner << bits) | found)
            offsets = np.searchsorted(pairs >> bits, np.arange(len(part) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("place"), part.column("label"), lists], names=["doc_id", "place", "label", "features"])


def ftrl(examples: list[tuple[int, np.ndarray]], size: int, epochs: int = 10, alpha: float = 0.5, beta: float = 1.0, noise: float = 0.5, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of present features and the bias, learnt one example after the other.

    Every coordinate has its own learning rate alpha / (beta + root of its squared gradients) and stays
    exactly 0 until its accumulated gradient exceeds l1: `noise` standard deviations of the sum of gradients
    that a feature of all examples gets by chance. Below that, the thousands of features of a long document
    move its score more than what tells the labels apart. The bias is not regularised.
    """
    share = sum(label for label, _ in examples) / max(1, len(examples))
    l1 = max(1.0, noise * math.sqrt(len(examples) * share * (1 - share)))
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for label, at in examples:
            w = weight(z[at], n[at])
            bias = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - label
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    return weight(z, n), -bias_z / ((beta + math.sqrt(bias_n)) / alpha)


def _learn(table: pa.Table, bits: int, settings: dict) -> pa.Table:
    # The features are read where they lie, not copied into order.
    order = pc.sort_indices(table, [("place", "ascending"), ("label", "ascending")]).to_pylist()
    labels, found = table.column("label").to_pylist(), [x.values.to_numpy() for x in table.column("features")]
    examples = [(labels[i], found[i]) for i in order]
    weights, bias = ftrl(examples, 1 << bits, **settings)
    some = np.flatnonzero(weights)
    return pa.table({"feature": np.append(some, -1), "weight": np.append(weights[some], bias)})


def fit(docs: DataFrame, labelled: DataFrame, per_class: int = 4096, bits: int = 20, max_features: int = 1 << 26, **settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and the bias, from docs(doc_id, text) and labelled(doc_id, label).

    The fit takes at most per_class rows of each label that have a document, those first by a hash of their id, and of these, in that
    order, as many as have max_features features together. So the examples fit one task; of the weights there are at most 2**bits, and the driver passes on the few that are not 0.
    The bound takes a larger share of the rarer label; the bias is set right by the shares among all labelled documents. An id with
    both labels is an example of each.
    """
    with scratch(docs.sparkSession):
        rows = labelled.filter("doc_id is not null and label in (0, 1)").distinct().join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("place", F.xxhash64("doc_id"))
        rows = written(rows, "labelled")
        chosen = [rows.filter(F.col("label") == label).orderBy("place", "doc_id").limit(per_class) for label in (0, 1)]
        texts = docs.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))
        examples = texts.select("doc_id", "place", "label", "text").mapInArrow(lambda batches: _examples(batches, bits), "doc_id long, place long, label int, features array<int>")
        examples = written(examples.withColumn("n", F.size("features")), "examples")
        # Which of them fit is told by their sizes: 2 * per_class rows of four numbers; only the features of those that do are gathered.
        so_far = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("place", "label").rowsBetween(Window.unboundedPreceding, 0))
        fitting = examples.select("doc_id", "place", "label", "n").withColumn("so_far", so_far).filter(F.col("so_far") <= max_features)
        fitting = written(fitting.select("doc_id", "label"), "fitting")
        examples = examples.join(F.broadcast(fitting), ["doc_id", "label"]).withColumn("all", F.lit(0))
        learnt = examples.select("all", "place", "label", "features").groupBy("all").applyInArrow(lambda table: _learn(table, bits, settings), "feature long, weight double").collect()
        weights = {r.feature: r.weight for r in learnt}
        bias = weights.pop(-1, 0.0)
        counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
        used = {r.label: r["count"] for r in fitting.groupBy("label").count().collect()}
        if len(used) == 2:
            bias += math.log(counts[1] / counts[0]) - math.log(used[1] / used[0])
    return np.fromiter(weights, np.int64, len(weights)), np.fromiter(weights.values(), float, len(weights)), bias


def scores(texts: pa.Array, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """The probability of label 1 for each text; a feature counts once a text."""
    found, owner = features(texts, bits)
    some = weights[found] != 0
    pairs = np.unique((owner[some] << bits) | found[some])
    sums = np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def _dense(model, bits: int) -> tuple[np.ndarray, float]:
    at, values, bias = model.value
    weights = np.zeros(1 << bits)
    weights[at] = values
    return weights, bias


def _score(batches, model, bits: int):
    weights, bias = _dense(model, bits)
    for batch in batches:
        for part in slices(batch):
            score = pa.array(scores(part.column("text"), weights, bias, bits))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), score], names=["doc_id", "held_out", "score"])


def _clean(batches, model, bits: int, text_col: str):
    weights, bias = _dense(model, bits)
    for batch in batches:
        for part in slices(batch):
            yield part.filter(pa.array(scores(part.column(text_col), weights, bias, bits) < 0.5))


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5. Null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4096, bits: int = 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **settings) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Learns from labelled documents that are not held out; scores depend on the text alone. Null and empty
    texts get the score of the bias. Labels other than 0 and 1, null ids and ids without a document are not
    learnt from; without any label every score is 0.5. Repeated rows are scored each. An empty table gives
    an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = _model(docs, labels, per_class, bits, id_col, label_col, settings)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(lambda batches: _score(batches, model, bits), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _model(docs: DataFrame, labels: DataFrame, per_class: int, bits: int, id_col: str, label_col: str, settings: dict):
    small_batches(docs.sparkSession)
    labelled = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(~held_out(F.col("doc_id")))
    return docs.sparkSession.sparkContext.broadcast(fit(docs, labelled, per_class, bits, **settings))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 4096, bits: int = 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **settings) -> DataFrame:
    """The rows of docs, with all their columns, that toxicity() doesn't predict as toxic; what it says of labels holds here.

    Null and empty texts are judged by the bias alone; repeated rows and null ids are judged each; columns pass through, whatever their
    names. An empty table stays empty. No row of docs is shuffled.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = _model(texts, labels, per_class, bits, id_col, label_col, settings)
    return docs.mapInArrow(lambda batches: _clean(batches, model, bits, text_col), docs.schema)

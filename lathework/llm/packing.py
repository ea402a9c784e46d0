"""Lexical retrieval packing: sequences filled with neighbours that a sharded BM25 index returns."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffle_partitions, small_batches
from .tokens import drop_encoder, encoder
from .words import BETWEEN, STEP, U64, bytes_of, find_words, mix, slices

K1, B = 1.2, 0.75
#: In the table of frequencies these stand for the number of texts, of words and of bytes.
TEXTS, WORDS, BYTES = -1, -2, -3
#: A shard of documents at the size bound has that times shard_bytes at most, not counting the long ones that are dealt evenly.
LONG = 4
#: Bytes of a batch that are encoded at once; a task's arrays are some fifty times as large.
STEP_BYTES = 1 << 20


def _terms(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed terms (words without punctuation) of each text, texts in order: text, term, count."""
    words = find_words(texts, outside=BETWEEN)
    both = np.sort((words.text_of << bits) | (words.hash >> U64(64 - bits)).astype(np.int64))
    new = np.flatnonzero(np.diff(both, prepend=-1))
    keys = both[new]
    return keys >> bits, keys & ((1 << bits) - 1), np.diff(new, append=len(both))


def _frequencies(batches, bits: int):
    """Of a partition: in how many texts each term is, and the number of texts, words and bytes."""
    total, sums = np.zeros(1 << bits, np.int64), np.zeros(3, np.int64)
    for batch in batches:
        for part in slices(batch):
            _, term, count = _terms(part.column("text"), bits)
            total += np.bincount(term, minlength=1 << bits)
            sums += [len(part), count.sum(), part.nbytes]
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [TEXTS, WORDS, BYTES])), pa.array(np.append(total[some], sums))], names=["term", "n"])


class Statistics:
    """What the whole corpus says of each hashed term: its idf, and how documents are dealt by it.

    A document's key is the first of its shared terms in a random order in which a term comes the earlier the
    higher its idf, as in weighted MinHash: alike documents mostly have one key. At most df documents have a
    key; those of a frequent one are dealt over so many shards that each gets about shard_docs of them. Documents of over
    LONG times a shard's mean size are dealt evenly whatever they say, so that no key gathers many: they fill sequences by themselves, but for their ends.
    """

    def __init__(self, df: np.ndarray, texts: int, words: int, shards: int, shard_docs: int, long_bytes: int):
        self.long_bytes = long_bytes
        self.idf = np.log(1 + (texts - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean_words, self.shards = words / max(1, texts), shards
        u = ((mix(np.arange(len(df), dtype=U64) * U64(STEP)) >> U64(11)) + U64(1)).astype(float) * 2.0**-53
        order = np.argsort(np.where(df > 1, -np.log(u) / self.idf, np.inf), kind="stable")
        self.place = np.empty(len(df), np.int32)
        self.place[order] = np.arange(len(df), dtype=np.int32)
        self.parts = np.maximum(1, -(-df[order] // shard_docs)).astype(np.int32)

    def shard(self, owner: np.ndarray, term: np.ndarray, deal: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The shard of each text from its terms (owners in order), a hash of it and its bytes."""
        key = np.full(len(deal), -1, np.int64)
        some, first = np.unique(owner, return_index=True)
        if len(some):
            key[some] = np.minimum.reduceat(self.place[term], first)
        key[size > self.long_bytes] = -1
        part = np.where(key >= 0, deal % self.parts[key].astype(U64), deal)
        return (mix(key.astype(U64) * U64(STEP) + part) % U64(self.shards)).astype(np.int64)


def _encoded(batches, vocabulary, statistics, bits: int, end_id: int):
    encode, most = encoder(vocabulary.value), (1 << (32 - bits)) - 1
    end = np.array([end_id], encode.dtype).tobytes()
    for batch in batches:
        for part in slices(batch, STEP_BYTES):
            pa.default_memory_pool().release_unused()
            ids, bounds, _ = encode(part.column("text"))
            owner, term, count = _terms(part.column("text"), bits)
            packed = ((term << (32 - bits)) | np.minimum(count, most)).astype(np.uint32)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            deal = part.column("deal").to_numpy().view(U64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(statistics.value.shard(owner, term, deal, np.diff(bytes_of(part.column("text"))[1]))),
                    pa.array([ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "shard", "ids", "terms"],
            )


class Index:
    """BM25 over the documents of one shard; frequencies are those of the whole corpus."""

    def __init__(self, terms: list[np.ndarray], bits: int, idf: np.ndarray, mean_words: float, query_terms: int):
        counts = np.array([len(t) for t in terms])
        packed = np.concatenate(terms) if terms else np.zeros(0, np.uint32)
        doc, term, tf = np.repeat(np.arange(len(terms)), counts), (packed >> (32 - bits)).astype(np.int64), (packed & ((1 << (32 - bits)) - 1)).astype(np.float64)
        words = np.bincount(doc, tf, len(terms))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[doc] / max(mean_words, 1e-9)))
        order = np.sort((term << 32) | np.arange(len(term))) & 0xFFFFFFFF  # numbers sort faster than their places
        term = term[order]
        new = np.flatnonzero(np.diff(term, prepend=-1))
        # Terms of one document alone find no neighbour.
        sizes = np.diff(np.append(new, len(term)))
        shared = sizes > 1
        self.docs, self.weights = doc[order], weight[order]
        self.begin, self.sizes = new[shared], sizes[shared]
        # Query terms of each document: the rarest of those it shares.
        n_shared = max(1, len(self.begin))
        by_idf = np.argsort(-idf[term[self.begin]], kind="stable")
        place = np.empty(len(by_idf), np.int64)
        place[by_idf] = np.arange(len(by_idf))
        has = np.repeat(shared, sizes)
        asker, rank = np.divmod(np.sort(self.docs[has] * n_shared + np.repeat(place, self.sizes)), n_shared)
        asked = by_idf[rank]
        self.first = np.searchsorted(asker, np.arange(len(terms) + 1))
        self.asked, self.query_terms, self.n = asked, query_terms, len(terms)

    def scores(self, doc: int) -> np.ndarray:
        query = self.asked[self.first[doc] : min(self.first[doc + 1], self.first[doc] + self.query_terms)]
        sizes = self.sizes[query]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[query] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.docs[at], self.weights[at], self.n)


def fill(lengths: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of one shard.

    A seed document opens a sequence; a long one fills whole sequences alone. The rest of the window goes to
    its best unused neighbours, those that share no term in order of number. What the last neighbour has over
    is the next seed, so that only the shard's last sequence may stay unfilled.
    """
    out: list[tuple[int, int, int, int, int]] = []
    unused = np.ones(len(lengths), bool)
    sequence, offset, next_seed = 0, 0, 0
    seed, start = -1, 0

    def put(doc: int, start: int) -> int:
        """Places what fits and returns where the document goes on."""
        nonlocal sequence, offset
        length = min(window - offset, int(lengths[doc]) - start)
        out.append((doc, start, length, sequence, offset))
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0
        return start + length

    while True:
        if seed < 0:
            while next_seed < len(lengths) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(lengths):
                return out
            seed, start = next_seed, 0
            unused[seed] = False
        asker = seed
        while start < lengths[seed]:
            start = put(seed, start)
        seed = -1
        if offset:
            scores = np.where(unused, index.scores(asker), -1.0)
            for neighbour in best_first(scores):
                if not offset or scores[neighbour] < 0:
                    break
                unused[neighbour] = False
                goes_on = put(neighbour, 0)
                if goes_on < lengths[neighbour]:
                    seed, start = neighbour, goes_on
                    break


def best_first(scores: np.ndarray, few: int = 16):
    """Places in descending order of score, equal ones by number; all but the first few are only ordered if asked for."""
    if few < len(scores):
        least = np.partition(scores, len(scores) - few)[-few]
        top = np.flatnonzero(scores > least)
        top = top[np.argsort(-scores[top], kind="stable")]
        yield from top.tolist()
        yield from np.argsort(-scores, kind="stable")[len(top) :].tolist()
    else:
        yield from np.argsort(-scores, kind="stable").tolist()


def _pack(key: tuple, table: pa.Table, statistics, window: int, query_terms: int, bits: int, dtype: str) -> pa.Table:
    drop_encoder()  # all is encoded, and the worker lives on for other steps
    table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    ids = [np.frombuffer(x, dtype) for x in table.column("ids").to_pylist()]
    terms = [np.frombuffer(x, np.uint32) for x in table.column("terms").to_pylist()]
    lengths = np.array([len(x) for x in ids])
    pieces = fill(lengths, Index(terms, bits, statistics.value.idf, statistics.value.mean_words, query_terms), window)
    doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
    return pa.table(
        {
            "doc_id": table.column("doc_id").take(pa.array(doc)),
            "start": start,
            "length": length,
            "ids_crc32": np.array(crc, np.int64),
            "doc_tokens": lengths[doc],
            "sequence_id": sequence + (key[0].as_py() << 32),
            "offset": offset,
        }
    )


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, shard_docs: int = 1024, shard_bytes: int = 16 << 20, query_terms: int = 24, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document into sequences of at most `window` tokens.

    vocabulary: path of a byte-level BPE tokenizer's JSON file, read on the driver. Each document is its
    tokens (strings of added tokens in a text become those tokens) and then end_id. Documents are dealt by content into shards of about
    shard_docs documents and a few times shard_bytes of text at most (see Statistics); a shard's BM25 index is asked with a seed's query_terms
    rarest shared terms. Term frequencies and lengths cover all documents, as a table of 2**bits hashed terms
    of fixed size; a count beyond 2**(32 - bits) - 1 weighs like that.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is
    empty (one token). Repeated rows and rows with one id are packed each. Null ids stay null. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = docs.select("text").mapInArrow(lambda batches: _frequencies(batches, bits), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most 2**bits + 3 rows
    sums = found[found.term < 0].set_index("term").n
    texts, words, size = (int(sums.get(x, 0)) for x in (TEXTS, WORDS, BYTES))
    df = np.zeros(1 << bits, np.int64)
    df[found.term[found.term >= 0]] = found.n[found.term >= 0]
    shards = max(1, math.ceil(texts / shard_docs), math.ceil(size / shard_bytes))
    statistics = spark.sparkContext.broadcast(Statistics(df, texts, words, shards, shard_docs, LONG * shard_bytes // shard_docs))
    with open(vocabulary, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())
    encoded = docs.withColumn("deal", F.xxhash64("doc_id", "text")).mapInArrow(lambda batches: _encoded(batches, tokenizer, statistics, bits, end_id), "doc_id long, shard long, ids binary, terms binary")
    # A number of partitions that grows with the input, so that no task does.
    encoded = encoded.repartition(max(shuffle_partitions(spark), math.ceil(size / (4 * shard_bytes))), "shard")
    dtype = np.dtype(encoder(tokenizer.value).dtype).name
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return encoded.groupBy("shard").applyInArrow(lambda key, table: _pack(key, table, statistics, window, query_terms, bits, dtype), fields)

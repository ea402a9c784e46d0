"""Parts of the operators against plain versions that share no code with them."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from lathework.llm import sharding, toxicity
from lathework.llm.near_dedup import near_duplicates
from lathework.llm.packing import Index

SF = "/root/testdata/sf0.01"


def test_fill_of_the_published_example():
    """Seven slots, three shards with offsets 3, 0, 3 and skips 4, 2, 1."""
    assert sharding.claim([3, 0, 3], [4, 2, 1], 7) == [1, 0, 1, 0, 2, 2, 0]


def plain_fill(names, slots):
    """Whole preference lists; in each round every shard takes the first slot of its list that is free."""
    lists = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        offset, skip = int.from_bytes(digest[:4], "big") % slots, int.from_bytes(digest[4:8], "big") % (slots - 1) + 1
        lists.append(iter([(offset + j * skip) % slots for j in range(slots)]))
    owner = {}
    for shard in itertools.cycle(range(len(names))):
        owner[next(s for s in lists[shard] if s not in owner)] = shard
        if len(owner) == slots:
            return [owner[s] for s in range(slots)]


def test_fill_table():
    from lathework.llm import queries

    for names, slots in ((["a"], 5), ([f"n{i}" for i in range(9)], 101), (queries.SHARDS, 4099)):
        assert sharding.fill_table(names, slots) == plain_fill(names, slots)
    # The production table, which the SQL holds as a list.
    listed = re.search(r"string_split\('([0-9,]+)'", queries.ORACLE_SQL["op2_sharding"]).group(1)
    assert list(map(int, listed.split(","))) == plain_fill(queries.SHARDS, queries.SLOTS)


def plain_features(text):
    words = [w.encode() for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text.lower())]
    return [(d, words[i], words[i + d] if d else b"") for d in range(4) for i in range(len(words) - d)]


def test_toxicity_features():
    rng = np.random.default_rng(3)
    texts = ["", "One", "one, TWO; one-two é x", "a" * 3000] + [" ".join(rng.choice(["bad", "Good", "ugly!", "x1", "é"], 12)) for _ in range(30)]
    found, owner = toxicity.features(pa.array(texts), 20)
    seen, names = {}, {}
    for i, text in enumerate(texts):
        mine, plain = found[owner == i].tolist(), plain_features(text)
        assert len(mine) == len(plain)
        for x, feature in zip(mine, plain, strict=True):
            assert seen.setdefault(feature, x) == x and names.setdefault(x, feature) == feature


def plain_ftrl(examples, epochs, alpha, beta, l1, l2):
    """One coordinate after the other, as in the paper; the bias is a coordinate without penalties."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for label, features in examples:
            w = {i: weight(i) for i in ["bias", *features]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, x in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * x
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl():
    rng = np.random.default_rng(4)
    examples = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 40, 8))) for _ in range(300)]
    examples = [(label, np.unique(np.append(x, 40 + label))) for label, x in examples]
    share = sum(label for label, _ in examples) / 300
    l1 = max(1.0, 0.25 * math.sqrt(300 * share * (1 - share)))
    weights, bias = toxicity.ftrl(examples, 50, epochs=3, alpha=0.3, beta=0.7, noise=0.25, l2=0.5)
    want = plain_ftrl([(label, x.tolist()) for label, x in examples], 3, 0.3, 0.7, l1, 0.5)
    assert math.isclose(bias, want.pop("bias"), abs_tol=1e-9)
    assert all(math.isclose(weights[i], w, abs_tol=1e-9) for i, w in want.items())
    assert (weights == 0).sum() > 10 and weights[41] > 0 > weights[40]


def test_toxicity_scores():
    texts = ["bad bad words here", "good words", "", "bad"]
    bits = 16
    found, owner = toxicity.features(pa.array(texts), bits)
    weights = np.zeros(1 << bits)
    weights[np.unique(found)] = np.random.default_rng(1).normal(size=len(np.unique(found)))
    got = toxicity.scores(pa.array(texts), weights, -0.3, bits)
    for i in range(len(texts)):
        total = -0.3 + sum(weights[x] for x in set(found[owner == i].tolist()))
        assert math.isclose(got[i], 1 / (1 + math.exp(-total)), rel_tol=1e-12)


def test_bm25_of_a_shard():
    rng = np.random.default_rng(6)
    bits, k1, b, mean = 10, 1.2, 0.75, 30.0
    docs = [collections.Counter(rng.zipf(1.4, rng.integers(5, 60)).clip(1, 900).tolist()) for _ in range(40)] + [collections.Counter()]
    idf = rng.uniform(0.1, 5, 1 << bits)
    packed = [np.array([(t << (32 - bits)) | n for t, n in d.items()], np.uint32) for d in docs]
    few = 6
    index = Index(packed, bits, idf, mean, few)
    frequency = collections.Counter(t for d in docs for t in d)
    for i, doc in enumerate(docs):
        asked = sorted((t for t in doc if frequency[t] > 1), key=lambda t: (-idf[t], t))[:few]
        want = [sum(idf[t] * d[t] * (k1 + 1) / (d[t] + k1 * (1 - b + b * sum(d.values()) / mean)) for t in asked if t in d) for d in docs]
        assert np.allclose(index.scores(i), want)


def test_near_duplicates_lose_no_link_of_any_queried_row(spark):
    """Every document of a whole table whose id is divisible by 50, against all: recall of links at 0.8."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}
    links = [(q, i) for q in sets if q % 50 == 0 for i in sets if i != q and sets[q] and len(sets[q] & sets[i]) >= 0.8 * len(sets[q] | sets[i])]
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    kept = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 0 and kept == len(links)

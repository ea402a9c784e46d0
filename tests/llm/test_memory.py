"""What the steps hold in an executor's Python workers, and leave there for the next step."""

import numpy as np
import pyarrow as pa
import pytest
from test_operators import VOCABULARY

from lathework.llm import near_dedup, packing, tokens, toxicity, words

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbound(spark):
    was = spark.conf.get(BOUND, None)
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND) if was is None else spark.conf.set(BOUND, was)


def batch_sizes(spark):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    rows = spark.range(0, 1200, 1, 1).selectExpr("repeat('word ', 2000) text")
    return [r.n for r in rows.mapInArrow(sizes, "n long").collect()]


@pytest.mark.parametrize("step", ["near_duplicates", "pack", "toxicity"])
def test_batches_sent_to_python_are_small(unbound, empty, step):
    labels = unbound.createDataFrame([], "doc_id long, toxic int")
    assert max(batch_sizes(unbound)) > 8 << 20
    {"near_duplicates": near_dedup.near_duplicates, "pack": lambda d: packing.pack(d, VOCABULARY), "toxicity": lambda d: toxicity.toxicity(d, labels)}[step](empty)
    assert max(batch_sizes(unbound)) < 5 << 20


def test_a_bound_of_the_session_stays(unbound, empty):
    unbound.conf.set(BOUND, "123456")
    near_dedup.near_duplicates(empty)
    assert unbound.conf.get(BOUND) == "123456"


def test_near_duplicates_makes_no_table_in_python(docs, monkeypatch):
    """Such a table starts a second Python daemon, with workers, in each executor."""
    want = sorted(map(str, near_dedup.near_duplicates(docs).collect()))
    monkeypatch.delattr(type(docs.sparkSession), "createDataFrame")
    assert sorted(map(str, near_dedup.near_duplicates(docs).collect())) == want


def test_packing_frees_the_encoder():
    with open(VOCABULARY, encoding="utf-8") as file:
        encode = tokens.encoder(file.read())
    texts = pa.array(["some text", "another text"])
    ids, bounds, _ = encode(texts)
    owner, term, count = packing._terms(texts, 18)
    terms = [((term[owner == i] << 14) | count[owner == i]).astype(np.uint32).tobytes() for i in range(2)]
    table = pa.table({"doc_id": [1, 2], "ids": [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], "terms": terms})
    statistics = type("Broadcast", (), {"value": packing.Statistics(np.bincount(term, minlength=1 << 18), 2, 4, 1, 1024, 1 << 20)})
    packed = packing._pack((pa.scalar(0),), table, statistics, 2048, 24, 18, np.dtype(encode.dtype).name)
    assert packed.column("length").to_pylist() == np.diff(bounds).tolist()
    assert "encoder" not in words.process_cache()


def test_learning_does_not_copy_the_features():
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 1 << 16, 40_000)).astype(np.int32) for _ in range(40)]
    table = pa.table({"place": rng.permutation(40), "label": pa.array([i % 2 for i in range(40)], pa.int32()), "features": pa.array(lists, pa.list_(pa.int32()))})
    want = toxicity._learn(table.sort_by("place"), 16, {"epochs": 1})
    pool, usual = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        got = toxicity._learn(table, 16, {"epochs": 1})
    finally:
        pa.set_memory_pool(usual)
    assert got.equals(want)
    assert pool.max_memory() < table.nbytes / 2


def test_slices_are_about_a_megabyte():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 4000})
    parts = list(words.slices(batch))
    assert sum(map(len, parts)) == 4000
    assert max(p.nbytes for p in parts) <= 1 << 20

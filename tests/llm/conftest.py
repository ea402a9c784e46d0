import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda the of and to".split()) + str(rng.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Null and empty texts, a very long one, ties, copies, near copies, a shared passage, repeated rows, null ids."""
    passage = " ".join(prose(1, 60))
    base = prose(2, 200)
    near = base[:100] + ["changed"] + base[101:]
    texts = [
        None, "", " \n\t ", "one", "one two three four", " ".join(base), " ".join(base), " ".join(near),
        " ".join(prose(3, 50)) + " " + passage, passage + "\n" + " ".join(prose(4, 70)), " ".join(prose(5, 6000)),
        "héllo wörld ünï " * 20, "x" * 5000, " ".join(prose(6, 300)), "same line\nsame line\nother line here", "日本 語の 文章 です " * 8,
    ]
    out = [(i, t, "en", "a" if i % 3 else None, 0) for i, t in enumerate(texts)]
    return [*out, out[5], (None, " ".join(prose(7, 40)), None, "b", None), (None, None, None, "b", None)]


@pytest.fixture
def docs(spark, rows):
    """With columns whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("extra") for c in ("slot", "block", "bands", "size", "copies", "label", "score", "found", "rank", "shard", "h")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


@pytest.fixture
def empty(docs):
    return docs.limit(0)

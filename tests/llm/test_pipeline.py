"""Each stage of the corpus pipeline on what the one before it kept, against a plain version of its decisions."""

import collections
import hashlib
import math

import corpus_pipeline
import numpy as np
import pytest
from test_operators import VOCABULARY, plain_classes, plain_spans, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """240 clean documents, 60 toxic ones, exact and near copies, secrets, a null and an empty text; labels for all but the last."""
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(900)]
    rows, toxic = [], {}
    for i in range(300):
        text = list(rng.choice(vocabulary, rng.integers(40, 90)))
        toxic[i] = int(i % 5 == 4)
        if toxic[i]:
            text = [*text, "Nasty,", "vile"]
            rng.shuffle(text)
        if i % 7 == 0:
            text.insert(3, f"password=hunter{i}abc")
        rows.append((i, " ".join(text), "en", ["a", "b", None][i % 3], 0))
    by_id = {r[0]: r for r in rows}
    clean = [i for i in by_id if not toxic[i]]
    for n, i in enumerate(clean[:40]):
        copy = by_id[i][1].split(" ")
        if n % 2:
            copy[len(copy) // 2] = "changed"
        rows.append((1000 + n, " ".join(copy), "en", "b", 0))
        toxic[1000 + n] = 0
    rows += [(2000, None, "en", "a", 0), (2001, "", None, "b", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder, [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], toxic


def plain_mix(rows):
    """How often each row is taken."""
    size = [len(words(r[1])) for r in rows]
    of = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        of[r[3]] += n
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full = set()
    while True:
        level = (sum(of.values()) - sum(3 * of[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and 3 * of[s] < level * weight[s]}
        if not more:
            break
        full |= more
    copies = [0] * len(rows)
    for s in order:
        target = 3.0 * of[s] if s in full else level * weight[s]
        rate = min(3.0, target / of[s])
        whole, part, mine = math.floor(rate), rate - math.floor(rate), []
        for i, r in enumerate(rows):
            if r[3] == s:
                copies[i] = whole
                name = f"{r[0] if r[0] is not None else ''}:{hashlib.md5((r[1] or '').encode()).hexdigest()}"
                u = (int(hashlib.md5(f"0:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mine.append((u, i))
        done, rest = 0, target - whole * of[s]
        for _, i in sorted(mine) if part else ():
            copies[i] += 2 * done + size[i] <= 2 * rest
            done += size[i]
    return copies


def test_stages(spark, made):
    from tokenizers import Tokenizer

    folder, rows, toxic = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None

    def after(name, docs):
        out = stages[name](spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        # Written and read again, as the pipeline does.
        return spark.createDataFrame(out.collect(), out.schema)

    docs = after("toxicity", docs)
    want = [r for r in rows if not toxic.get(r[0], 0)]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)

    docs = after("near_duplicates", docs)
    classes = plain_classes(want)
    want = [r for r in want if classes[r[0]] == r[0]]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str) and len(want) < 250

    docs = after("secrets", docs)

    def masked(text):
        for start, _, end in sorted(plain_spans(text), reverse=True):
            text = text[:start] + "[REDACTED]" + text[end:]
        return text

    want = [(i, masked(t), lang, s, len(masked(t))) if t is not None else (i, None, lang, s, None) for i, t, lang, s, _ in want]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str) and any("[REDACTED]" in (r[1] or "") for r in want)

    docs = after("mixing", docs)
    want = [r for r, n in zip(want, plain_mix(want), strict=True) for _ in range(n)]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)

    packed = after("packing", docs).toPandas()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokens = collections.Counter()
    for i, t, *_ in want:
        tokens[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert packed.groupby("doc_id").length.sum().to_dict() == dict(tokens)
    filled = packed.groupby("sequence_id").length.sum()
    assert (filled <= 2048).all() and (filled < 2048).sum() <= 1

    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = sorted(packed.columns)
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, packed[key].values.tolist()))

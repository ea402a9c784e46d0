"""SimHash components, spelling variants and the filter audit against plain versions that share no code with them."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from lathework.llm import filter_audit, simhash, spelling
from pyspark.sql import functions as F


def plain_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """print -> the least print that links lead to, by looking at all pairs."""
    prints, root = sorted(set(prints)), {}
    for p in prints:
        root[p] = p
    find = lambda p: p if root[p] == p else find(root[p])
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {p: find(p) for p in prints}


def plain_simhash(rows):
    prints = [(r[0], plain_print(r[1])) for r in rows]
    group, least = plain_components(p for _, p in prints), {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    return sorted(((i, f"{p:016x}", least.get(group[p])) for i, p in prints), key=str)


def test_simhash(docs, rows):
    assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str) == plain_simhash(rows)


def test_simhash_of_near_texts(spark):
    rng = random.Random(5)
    rows, word = [], lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    for _ in range(60):
        base = [word() for _ in range(rng.choice([2, 5, 40, 300]))]
        for _ in range(rng.randrange(1, 5)):
            rows.append((len(rows), " ".join(base).upper() if rng.random() < 0.3 else " ".join(base)))
            base[rng.randrange(len(base))] = word()
    rows += [(len(rows) + i, t) for i, t in enumerate([" ".join("x" * (1 + i % 7) for i in range(3000)), "z\x0by\x1cz", "É é", ""])]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_simhash(rows)


def test_simhash_empty(empty):
    assert simhash.simhash_components(empty).count() == 0


def test_bit_counts_do_not_depend_on_pieces(monkeypatch):
    text = ("Alpha beta  gamma\n\tdelta " * 50 + "x" * 90 + " end").encode()
    whole = simhash.bit_counts(text, 3)
    monkeypatch.setattr(simhash, "PIECE", 16)
    monkeypatch.setattr(simhash, "_pieces", lambda text, step=16, pieces=simhash._pieces: pieces(text, step))
    cut = simhash.bit_counts(text, 3)
    assert whole[1] == cut[1] and (whole[0] == cut[0]).all()


@pytest.mark.parametrize("blocks", [3, 4, 6])
def test_ball_hashing_links_what_all_pairs_link(spark, blocks):
    """Chains and clouds of every distance, at bits on both sides of the blocks' bounds, against all pairs."""
    rng = random.Random(blocks)
    flip = lambda p, bits: p ^ sum(1 << b for b in bits)
    prints = {0, (1 << 64) - 1, 1, 7, 15}
    for _ in range(40):
        p = rng.getrandbits(64)
        prints.add(p)
        for d in (1, 2, 3, 4, 5):
            prints.add(flip(p, rng.sample(range(64), d)))
            prints.add(flip(p, rng.sample([0, 15, 16, 20, 21, 31, 32, 42, 43, 47, 48, 63], d)))
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain = flip(chain, rng.sample(range(64), 3))
        prints.add(chain)
    for a, b, c in itertools.combinations(range(0, 64, 9), 3):
        prints.add(flip(12345, (a, b, c)))
    signed = [np.uint64(p).view(np.int64).item() for p in prints]
    links = simhash.print_links(spark.createDataFrame([(p,) for p in signed], "print long"), blocks).collect()
    unsigned = lambda p: p % (1 << 64)
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 3 for r in links)
    root = {p: p for p in prints}
    find = lambda p: p if root[p] == p else find(root[p])
    for r in links:
        low, high = sorted((find(unsigned(r.a)), find(unsigned(r.b))))
        root[high] = low
    assert {p: find(p) for p in prints} == plain_components(prints)


def plain_words(rows, shortest=6, fewest=5, rate=199):
    count = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if rate and h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= fewest}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counted, ratio=5):
    out = {}
    for w, n in counted.items():
        near = sorted((-m, v) for v, m in counted.items() if plain_near(w, v))
        form = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = (form, n, len(near), counted[form] if form else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=str)


@pytest.mark.parametrize("rate", [0, 2, 199])
def test_counted_words(docs, rows, rate):
    for shortest, fewest in ((6, 5), (1, 1)):
        got = spelling.counted_words(docs, shortest, fewest, rate).collect()
        want = plain_words(rows, shortest, fewest, rate)
        assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if w} and len(got) == len([w for w in want if w])


def test_spelling_variants(spark):
    """Runs of equal letters, insertions at both ends, ties, chains of forms and letters beyond ASCII."""
    rng, counted = random.Random(9), {}
    for _ in range(60):
        base = "".join(rng.choice("aabé") for _ in range(rng.randrange(1, 9)))
        n = rng.choice([1, 5, 5, 25, 130, 700])
        for _ in range(6):
            counted.setdefault(base, n)
            i = rng.randrange(len(base) + 1)
            base = rng.choice([base[:i] + rng.choice("abcé") + base[i:], base[:i] + base[i + 1 :], base[:i] + rng.choice("abcÿ") + base[i + 1 :]]) or "a"
            n = rng.choice([n, max(1, n // 5), n * 5])
    counted |= {"x" * 3000: 50, "x" * 3001: 10, "letter": 100, "leter": 20, "lletter": 20, "letteré": 4}
    got = spelling.spelling_variants(spark.createDataFrame(list(counted.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_variants(counted)


def test_spelling_query_on_awkward_rows(docs, rows, empty):
    got = spelling.spelling_variants(spelling.counted_words(docs, 4, 2, 3)).collect()
    assert sorted(map(tuple, got), key=str) == plain_variants({w: n for w, n in plain_words(rows, 4, 2, 3).items() if w})
    assert spelling.spelling_variants(spelling.counted_words(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spelling.counted_words(docs), ratio=1)


def plain_audit(rows, labels):
    failed = []
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    for i, text, lang, *_ in rows:
        t, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = ""
        fails += "A" if len(w) < 200 else ""
        fails += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
        fails += "D" if re.search(r"[#$%&*|]", t) else ""
        fails += "E" if i is not None and t in least and least[t] < i else ""
        mine = [x for x in labels if i is not None and x[0] == i]
        failed.append((lang or "", set(fails), any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {f[0] for f in failed}:
        shapley, steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [f for f in left if name in f[1]]
                redundant = sum(name in f[1] for f in gone)
                left = [f for f in left if name not in f[1]]
                gone += here
                shapley[name] += len(here)
                alone = sum(f[0] == part and f[1] == {name} for f in failed)
                steps.append((name, (part, "".join(order), step, len(left), len(here), redundant, alone, sum(f[2] for f in here), sum(f[3] for f in here))))
        out += [(*row, shapley[name]) for name, row in steps]
    return sorted(out)


LABELS = "doc_id long, quality int, toxic int"


def test_filter_audit(spark, docs, rows):
    rng = random.Random(3)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in (*range(12), 5, 5, 99, None)]
    made = [(100 + i, rng.choice(["AB cd ", "w%d " % i, "same ", "X# "]) * rng.choice([3, 150, 250]), rng.choice(["en", None, "", "fr"]), None, 0) for i in range(60)]
    made += [(i + 500, *r[1:]) for i, r in enumerate(rng.sample(made, 20))]
    more = spark.createDataFrame(made, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    both = docs.unionByName(more, allowMissingColumns=True)
    got = filter_audit.text_filter_interaction(both, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit([*rows, *made], labels)


def test_filter_audit_empty(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.text_filter_interaction(empty, none).count() == 0
    assert filter_audit.text_filter_interaction(docs, none).filter("good_lost + toxic_lost > 0").count() == 0


def test_path_counts():
    """Against walking all orders, for one to six filters."""
    for k in range(1, 7):
        walked = collections.Counter()
        for order in itertools.permutations(range(k)):
            state = 0
            for f in order:
                walked[state, f] += 1
                state |= 1 << f
        assert filter_audit.path_counts(k) == dict(walked)


def test_filter_interaction_of_two(spark):
    rows = spark.createDataFrame([("p", True, True), ("p", True, False), ("p", None, False), (None, False, True)], "g string, x boolean, y boolean")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.filter_interaction(rows, ["x", "y"], "g", {"x_seen": "x"}).collect()}
    assert got["p", "xy", 1] == (1, 2, 0, 1, 2, 3) and got["p", "yx", 2] == (1, 1, 1, 1, 1, 3)
    assert got["", "yx", 1] == (0, 1, 0, 1, 0, 2) and len(got) == 8
    for bad in ([], ["x", "x"], list("abcdefgh")):
        with pytest.raises(ValueError):
            filter_audit.filter_interaction(rows.withColumns({c: F.lit(True) for c in "abcdefgh"}), bad, "g")

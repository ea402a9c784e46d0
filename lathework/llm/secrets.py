"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import bound

#: Fixed values. Letters of the keywords stand in either case; group 2 of the first is the secret.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of AKIA[A-Z0-9]+ of under 20 characters holds none of 20 or more, nor does a run of under 24 hex digits
#: one of 24 or more: so their least lengths can be part of the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge, and what they learn ordinary identifiers from.
#: Characters of spans that a pattern found stand as HIDDEN.
HIDDEN = "\x01"
CANDIDATE = r"[A-Za-z0-9+/_=\x01-]{16,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{4,}"
KINDS = ("assign", "access", "hex", "model")
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Characters are counted from the blank to the tilde.
LOWEST, SYMBOLS = 32, 95


def before(values, combine, block: int = 256) -> F.Column:
    """For each of an array of numbers what combine makes of 0 and all those before it (a running sum or maximum).

    Whole blocks are combined first, then each block's members, so that no long array is copied once a member.
    """

    def running(part, at):
        step = lambda state, x: F.struct(combine(state["at"], x).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda state: state["out"])

    def all_blocks(whole):
        firsts = F.sequence(F.lit(1), F.size(whole), F.lit(block))
        totals = F.transform(firsts, lambda i: F.aggregate(F.slice(whole, i, block), F.lit(0), combine))
        blocks = F.arrays_zip(firsts.alias("first"), running(totals, F.lit(0)).alias("at"))
        inside = F.flatten(F.transform(blocks, lambda x: running(F.slice(whole, x["first"], block), x["at"])))
        return F.when(F.size(whole) > 0, inside).otherwise(F.array().cast("array<int>"))

    return bound(values, all_blocks)


def parts(text, pattern: str, group: int = 0) -> F.Column:
    """What lies between the leftmost non-overlapping matches, the matches and their group; after the last match comes one gap alone."""
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), every(0).alias("match"), every(group).alias("inner"))


def placed(text, pattern: str, group: int = 0) -> F.Column:
    """array<struct(start, end, inner)> of all matches, in code points; inner is the text of the group."""
    some = F.filter(parts(text, pattern, group), lambda x: x["match"].isNotNull())
    some = F.transform(some, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("n"), x["inner"].alias("inner")))

    def spans(all_):
        at = before(F.transform(all_, lambda x: x["gap"] + x["n"]), lambda a, x: a + x)
        return F.zip_with(at, all_, lambda a, x: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["n"]).alias("end"), x["inner"].alias("inner")))

    return bound(some, spans)


def found(text, pattern: str, kind: int, least: int = 0, group: int = 0) -> F.Column:
    """Spans of the matches whose group has at least `least` characters."""
    long = F.filter(placed(text, pattern, group), lambda x: F.length(x["inner"]) >= least)
    spans = F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def hidden(text, pattern: str, least: int = 0, group: int = 0) -> F.Column:
    """The text with HIDDEN for each character of found() spans."""
    piece = lambda x: F.concat(x["gap"], F.when(x["match"].isNull(), F.lit("")).when(F.length(x["inner"]) >= least, F.repeat(F.lit(HIDDEN), F.length(x["match"]))).otherwise(x["match"]))
    return F.when(text.rlike(pattern), F.array_join(F.transform(parts(text, pattern, group), piece), "")).otherwise(text)


#: The patterns with the least length of their group.
BASE = ((ASSIGN, 6, 2), (ACCESS, 0, 0), (HEX, 0, 0))


def with_base_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.withColumns({KINDS[kind]: found(F.col(text_col), pattern, kind, least, group) for kind, (pattern, least, group) in enumerate(BASE)})


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n) of samples(value, label): pairs of adjacent characters, at most 2 * 95 * 95 rows."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    return samples.filter(F.length("value") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def likelihood_ratios(counts: list[tuple[int, str, int]], smooth: float = 0.5, back_off: float = 5.0) -> list[int]:
    """For each pair of characters, a thousand times log P(second | first, random) - log P(second | first, identifier).

    Rare first characters fall back on how frequent the second is in all pairs of the label.
    """
    pair, first, second = Counter(), Counter(), Counter()
    for label, (a, b), n in counts:
        pair[label, a, b] += n
        first[label, a] += n
        second[label, b] += n
    signs = [chr(LOWEST + i) for i in range(SYMBOLS)]
    total = {label: sum(second[label, b] for b in signs) for label in (0, 1)}

    def log(label: int, a: str, b: str) -> float:
        alone = (second[label, b] + smooth) / (total[label] + smooth * SYMBOLS)
        return math.log((pair[label, a, b] + back_off * alone) / (first[label, a] + back_off))

    # A character again and again is no sign of chance, however rare it is in words.
    return [round(1000 * (log(1, a, b) - log(0, a, b))) * (a != b or log(1, a, b) < log(0, a, b)) for a in signs for b in signs]


def ratio(value, table: list[int]) -> F.Column:
    """The summed log-likelihood ratio of a string of printable ASCII characters, in thousandths."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<int>")
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c) - LOWEST)
    return bound(codes, lambda at: F.aggregate(F.sequence(F.lit(1), F.size(at)), F.lit(0).cast("long"), lambda sum_, i: sum_ + F.coalesce(F.get(ratios, F.get(at, i - 1) * SYMBOLS + F.get(at, i)), F.lit(0))))


#: Longest part of what counts as an ordinary identifier; random strings are longer.
LONGEST_PART = 15
#: The mean log-likelihood ratio a pair, in thousandths, from which a string is random. Measured on planted strings (README): all random ones are found
#: from 300 to 2,100, ordinary ones are taken for random in 1.1 % of the worst kind from 1,800 on.
LEAST_MEAN = 1800
#: Random strings of each alphabet that are learnt from.
DRAWN = 1024


def random_samples(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """(value, label 1): n random strings of 24 to 40 characters of each alphabet that keys are written in: base 64, letters and digits, and those of one case, hex digits.

    Drawn from SHA-512 of numbers, so the same each time.
    """
    digest = F.sha2(F.col("id").cast("string"), 512)
    wide = F.base64(F.unhex(digest))
    plain = F.translate(wide, "+/=", "")
    alphabets = F.array(wide, plain, F.lower(plain), F.upper(plain), digest)
    rows = spark.range(n).select("id", F.explode(alphabets).alias("value"))
    return rows.select(F.substring(F.col("value"), F.lit(1), (24 + F.col("id") % 17).cast("int")).alias("value"), F.lit(1).alias("label"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(value, label): what the patterns find in the documents and drawn random strings are 1, ordinary identifiers 0.

    An identifier outside of the patterns' matches is ordinary if its parts, between separators, have at most LONGEST_PART characters: a secret that no
    pattern knows is mostly longer, and must not teach what is ordinary. Words written together, with capitals for gaps, are
    ordinary, too: of each word the place where it would meet itself is learnt from.
    """
    text, other = F.col("text"), F.col("text")
    secrets = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))))
    for pattern in (ASSIGN, ACCESS, HEX):
        other = F.regexp_replace(other, pattern, " ")
    found_ = docs.select(F.explode(F.filter(secrets, lambda x: F.length(x) >= 6)).alias("value"), F.lit(1).alias("label"))
    ordinary = docs.select(F.explode(F.regexp_extract_all(other, F.lit(IDENTIFIER), F.lit(0))).alias("value"), F.lit(0).alias("label")).filter(~F.col("value").rlike(f"[A-Za-z0-9]{{{LONGEST_PART + 1}}}"))
    word = F.col("value").rlike("^[a-z]+$")
    joined = F.concat(F.right("value", F.lit(1)), F.upper(F.left("value", F.lit(1))), F.substring("value", 2, 1))
    seams = ordinary.filter(word).select(joined.alias("value"), "label")
    return found_.unionAll(ordinary).unionAll(seams).unionAll(random_samples(docs.sparkSession))


def train(samples: DataFrame) -> list[int]:
    """The table of log-likelihood ratios from samples(value, label)."""
    return likelihood_ratios([(r.label, r.pair, r.n) for r in pair_counts(samples).collect()])  # at most 2 * 95 * 95 rows


def scan(docs: DataFrame, table: list[int] | None = None, least_mean: int = LEAST_MEAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text and found, an array of (start, kind, end) in code points by start, then kind.

    Kinds: assign, access, hex (patterns) and model: strings of 16 characters or more that no pattern's span
    touches and whose mean log-likelihood ratio a pair is at least least_mean thousandths, random against
    identifier. table: from train(); by default learnt from these documents. A null text is empty. Repeated
    rows are scanned each; null ids stay. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = train(labelled_samples(docs)) if table is None else table
    return with_found(docs, table, least_mean)


def with_found(rows: DataFrame, table: list[int], least_mean: int) -> DataFrame:
    """Adds base (the patterns' spans), model and found (all of them) to rows with a text.

    A base span that touches a candidate lies in it or begins in it (what follows a base span never goes on as
    a candidate), so a candidate is touched if it holds a HIDDEN character. Hiding one pattern's spans before
    the next is looked for changes no untouched candidate: the parts lost belong to touched ones.
    """
    rows = with_base_spans(rows).withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    text = F.translate(F.col("text"), HIDDEN, "\x02")
    for name, (pattern, least, group) in zip(KINDS, BASE, strict=False):
        text = F.when(F.size(name) > 0, hidden(text, pattern, least, group)).otherwise(text)
        rows = rows.withColumn("_hidden", text)
        text = F.col("_hidden")
    random = lambda x: ~F.contains(x["inner"], F.lit(HIDDEN)) & (ratio(x["inner"], table) >= F.lit(least_mean).cast("long") * (F.length(x["inner"]) - 1))
    model = F.transform(F.filter(placed(text, CANDIDATE), random), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    rows = rows.withColumn("model", F.when(text.rlike(CANDIDATE), model).otherwise(F.array().cast(SPANS))).drop("_hidden")
    return rows.withColumn("found", F.array_sort(F.concat("base", "model")))


def written_out(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and spans of scan() as text."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts[:3], F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("found")).alias("spans"), counts[3])


def redacted(docs: DataFrame, table: list[int] | None = None, mask: str = "[REDACTED]", least_mean: int = LEAST_MEAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by mask; spans that overlap become one mask. All rows stay.

    Null texts stay null. Other columns pass through, whatever their names. An empty table gives an empty result.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = train(labelled_samples(ids)) if table is None else table
    # The other columns travel as one struct, so that none of their names clash.
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_found(rows, table, least_mean)
    letters = F.filter(F.split(F.col("text"), ""), lambda c: c != "")
    cut = lambda chars, start, end: F.array_join(F.slice(chars, start + 1, end - start), "")

    def masked(chars):
        reach = before(F.transform("found", lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        pieces = F.zip_with(F.col("found"), reach, lambda x, at: F.when(x["start"] >= at, F.concat(cut(chars, at, x["start"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), cut(chars, F.array_max(F.transform("found", lambda x: x["end"])), F.size(chars)))

    kept = F.when(F.size("found") > 0, bound(letters, masked)).otherwise(F.col(f"row.{text_col}"))
    return rows.withColumn("_clean", kept).select(*(F.col("_clean").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns))

"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was that for on as with at by be this are or an it from he not have you but they which we all there one had were has been will would if "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es er hat aus bei nach wie einer um am sind noch einem einen zum war wird "
    "le la les de et un une du en à que qui dans pour par sur est pas au avec plus ce il se son sont ou mais aux "
    "el los las y del con no lo al su como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; measure is a SQL expression over the measured columns."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=50),
    Rule("repeats", "n_repeat_words / n_words", high=0.5),
    Rule("word_length", "word_chars / n_words", low=2, high=12),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("stop_words", "n_stop_words / n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.4),
)


def measured(docs: DataFrame, text_col: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words to each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns({"_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_lines": lines, "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long")})
    words = F.col("_words")
    # A hash of each 3-word window, and where it starts.
    threes = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    docs = docs.withColumn("_threes", threes)
    # Sorted by hash, repeats stand side by side; texts without a repeat aren't sorted.
    pairs = F.sort_array(F.transform("_threes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_sorted", F.when(F.size(F.array_distinct("_threes")) < F.size("_threes"), pairs))
    same = lambda x, i: (x["h"] == F.get(F.col("_sorted"), i - 1)["h"]) | (x["h"] == F.get(F.col("_sorted"), i + 1)["h"])
    docs = docs.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"])))
    covered = F.transform("_starts", lambda at, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_starts"), j + 1) - at, F.lit(3))))
    return docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(list(stop_words)))).cast("long"),
        }
    ).drop("_words", "_lines", "_threes", "_sorted", "_starts")


def verdict(rules=RULES) -> F.Column:
    """The names of the rules that a measured row fails, as an array."""
    checks = []
    for rule in rules:
        value = F.expr(rule.measure)
        bad = F.lit(False)
        if rule.low is not None:
            bad |= value < rule.low
        if rule.high is not None:
            bad |= value > rule.high
        checks.append(F.when(F.col("n_words") == 0, F.lit(rule.name == "length")).otherwise(bad))
    return F.array_compact(F.array(*(F.when(bad, F.lit(rule.name)) for rule, bad in zip(rules, checks, strict=True))))


def quality(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, its measures, base_failed, failed (names of rules) and kept.

    base_failed: under 50 words, or more than half of the words in 3-word windows that occur twice or more.
    A null text counts as empty and fails by length. Repeated rows are judged each; null ids stay. An empty
    table gives an empty result. No row is shuffled. Other columns are not read.
    """
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumns({"base_failed": base, "failed": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))

"""Column functions on text: tokens, metric labels and values, search scores, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search ignores.
STOP_WORDS = (
    "the", "a", "an", "this", "that", "these", "those", "it", "its", "on", "in", "at", "of", "for", "to", "with", "by", "my", "our", "your",
    "and", "or", "but", "is", "are", "was", "were", "be", "been",
)

# Other names of a metric.
METRIC_ALIASES = {
    "annual recurring revenue": "arr",
    "annual recurring rev": "arr",
    "monthly recurring revenue": "mrr",
    "net revenue retention": "nrr",
    "net retention": "nrr",
    "customer acquisition cost": "cac",
    "lifetime value": "ltv",
    "gross margin": "gm",
}

# Fixed values: "Revenue: $4.2M" and "$4.2M Revenue"; \w and \s are ASCII here.
VALUE = r"[$€£]?\s*[-+]?[\d,]+(?:\.\d+)?\s*[MmKkBb%]?"
LABEL_FIRST = rf"([A-Z][\w\s&/]{{2,40}}?)\s*[:=]?\s*({VALUE})"
VALUE_FIRST = rf"({VALUE})\s+([A-Z][\w\s&/]{{2,40}})"

IDENTIFIER = "[A-Za-z][A-Za-z0-9_]*"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def search_tokens(text: Column) -> Column:
    """Distinct lower-case words of at least two characters that are no stop words; none for null."""
    # Identifiers hold no blanks, so that all are lowered as one string; shorter ones never match.
    words = F.split(F.lower(F.array_join(_all(text, "[A-Za-z][A-Za-z0-9_]+"), " ")), " ")
    return F.array_except(words, F.array(F.lit(""), *map(F.lit, STOP_WORDS)))


def identifier_tokens(text: Column) -> Column:
    """Distinct lower-case identifiers and their parts by underscore and capital, each of three characters or more."""
    whole = _all(text, IDENTIFIER)
    by_underscore = F.flatten(F.transform(whole, lambda w: F.split(w, "_")))
    by_capital = F.flatten(F.transform(whole, lambda w: F.split(F.regexp_replace(w, "(?<!^)([A-Z])", " $1"), r"\s+")))
    parts = F.transform(F.concat(whole, by_underscore, by_capital), F.lower)
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 3))


def metric_pairs(text: Column) -> Column:
    """Every (label, value) that stands in a text, in either order of the two; pairs found both ways stand twice."""
    first = F.arrays_zip(_all(text, LABEL_FIRST, 1).alias("label"), _all(text, LABEL_FIRST, 2).alias("value"))
    last = F.arrays_zip(_all(text, VALUE_FIRST, 2).alias("label"), _all(text, VALUE_FIRST, 1).alias("value"))
    return F.transform(F.concat(first, last), lambda p: F.struct(F.trim(p["label"]).alias("label"), F.trim(p["value"]).alias("value")))


def metric_label(label: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(label), r"\s+", " "), r"^[: .;,\-]+|[: .;,\-]+$", "")
    out = plain
    for name, short in METRIC_ALIASES.items():
        out = F.when(plain == name, short).otherwise(out)
    return out


def metric_value(value: Column) -> Column:
    """The number that a value stands for: $4.2M is 4200000, 23% is 0.23; null if it is none."""
    bare = F.regexp_replace(value, r"[,\s]", "")
    number = F.regexp_extract(bare, r"^[$€£]?([-+]?[0-9]+(?:\.[0-9]+)?)[MmKkBb]?%?$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(bare, r"([MmKkBb])%?$", 1))
    times = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(bare.endswith("%"), number * times / 100).otherwise(number * times)


def metric_format(value: Column) -> Column:
    plain = F.trim(value)
    unit = F.upper(F.right(plain, F.lit(1)))
    money = plain.rlike("^[$€£]")
    return (
        F.when(unit == "%", "percentage")
        .when(money & (unit == "M"), "currency_million")
        .when(money & (unit == "K"), "currency_thousand")
        .when(money & (unit == "B"), "currency_billion")
        .when(money, "currency")
        .when(unit.isin("M", "K", "B"), F.concat(F.lit("number_"), unit))
        .otherwise("number")
    )


def search_score(name: Column, query: str) -> Column:
    """100 for an equal name, 50 for one that begins so, 20 for one that contains it, 10 for a word that begins so, else 0."""
    lowered, wanted = F.lower(name), query.lower()
    word = F.exists(F.split(lowered, r"\s+"), lambda w: w.startswith(wanted))
    return F.when(lowered == wanted, 100).when(lowered.startswith(wanted), 50).when(lowered.contains(wanted), 20).when(word, 10).otherwise(0)


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where something is cut off."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def line_of(text: Column, at: Column) -> Column:
    """The number, from 1, of the line that holds character `at` (from 1)."""
    return F.regexp_count(F.substring(text, F.lit(1), at - 1), F.lit("\n")) + 1


def snake_case(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(spaced, "^_+|_+$", ""))


def field_caption(name: Column) -> Column:
    """A field's name without brackets, a long numeric suffix or "(copy n)"."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[\[\]]", ""), r"_\d{10,}$", ""), r"\s*\(copy(?: \d+)?\)$", ""))


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} replaced by the named values; names without one, and null values, by nothing."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(out, r"\{\{\s*\w+\s*\}\}", "")


def typed_template(template: Column, inputs: Column) -> Column:
    """A template's text filled from inputs (a map of JSON values), as JSON.

    A template that is one {{name}} alone is that input as it is: a list stays a list, a number a number. Any other is a text, in which each {{name}} is
    replaced by its input, a text without its quotes. A name without an input gives an empty text. Null for a null template.
    """
    lone = F.regexp_extract(template, r"^\s*\{\{\s*([A-Za-z_]\w*)\s*\}\}\s*$", 1)
    holes, names = F.split(template, r"\{\{[^}]+\}\}", -1), F.regexp_extract_all(template, F.lit(r"\{\{([^}]+)\}\}"), F.lit(1))
    plain = lambda value: F.coalesce(F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"], F.lit(""))
    text = F.array_join(F.zip_with(holes, names, lambda gap, name: F.concat(gap, F.coalesce(plain(F.element_at(inputs, F.trim(name))), F.lit("")))), "")
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when((lone != "") & F.map_contains_key(inputs, lone), F.element_at(inputs, lone)).otherwise(quoted)

"""What words of a request stand for: element types, places on a page, kinds of files, actions of a log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What people call the types of elements, and places on a page; words that stand for what is selected.
TYPE_WORDS = {
    "chart": ["chart", "graph", "plot"],
    "table": ["table", "grid", "matrix"],
    "image": ["image", "picture", "photo", "logo", "screenshot"],
    "shape": ["shape", "rectangle", "rect", "circle", "oval", "ellipse", "triangle", "arrow", "callout", "badge", "button", "card", "box"],
    "text": ["text", "title", "subtitle", "heading", "header", "label", "caption", "paragraph", "bullet", "quote", "footer"],
    "connector": ["connector", "line"],
    "freeform": ["freeform"],
    "group": ["group"],
}
PLACE_WORDS = {
    "top-left": ["top left", "upper left"],
    "top-right": ["top right", "upper right"],
    "top-center": ["top center", "top middle", "top"],
    "bottom-left": ["bottom left", "lower left"],
    "bottom-right": ["bottom right", "lower right"],
    "bottom-center": ["bottom center", "bottom middle", "bottom"],
    "middle-left": ["left"],
    "middle-right": ["right"],
    "center": ["center", "middle"],
}
PRONOUNS = ("this", "it", "that", "selected", "current")
# Kinds of files by suffix, and words that pad the names of wants.
FILE_KINDS = {"python": ["py"], "csv": ["csv"], "json": ["json"], "text": ["txt", "md"]}
NOISE = ("placeholder", "element", "text", "block", "box", "group", "the ", "a ", "small ", "tiny ")


def _where(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())))


def named_types(text: Column) -> Column:
    """Types of elements that a request names as whole words."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return _where({t: lowered.rlike(rf"\b(?:{'|'.join(words)})\b") for t, words in TYPE_WORDS.items()})


def named_places(text: Column) -> Column:
    """Places on a page that a request names, wherever the phrase stands."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return _where({p: lowered.rlike("|".join(phrases)) for p, phrases in PLACE_WORDS.items()})


def is_pronoun(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*PRONOUNS), F.lit(False))


def file_kind(name: Column) -> Column:
    suffix, out = F.regexp_extract(F.lower(name), r"\.([^.]*)$", 1), F.lit("other")
    for kind, suffixes in FILE_KINDS.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._\-]", "_")


def want_name(name: Column) -> Column:
    """A name without the words that pad it, in lower case and single spaces."""
    out = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    for word in NOISE:
        out = F.replace(out, F.lit(word), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def action_kind(method: Column, path: Column) -> Column:
    """What kind of change a request of the activity log makes."""
    placed = F.contains(path, F.lit("/elements/")) & (method == "POST") & ~path.rlike("/(duplicate|copy-to-slide)$")
    return (
        F.when(path.endswith("/apply"), "apply_template")
        .when(path.endswith("/regenerate"), "regenerate")
        .when(path.endswith("/script/run"), "code")
        .when(placed, "create")
        .when(method == "DELETE", "delete")
        .otherwise("edit")
    )


def path_part(path: Column, after: str) -> Column:
    """The part of a path that follows a named one, null without it."""
    return F.nullif(F.regexp_extract(path, f"/{after}/([^/?]+)", 1), F.lit(""))


def replaced(text: Column, find: str, put: str, regex: bool = False, case: bool = True) -> tuple[Column, Column]:
    """The text after a replacement and how many places it changed; null texts count as empty."""
    import re

    pattern = ("" if case else "(?i)") + (find if regex else re.escape(find))
    whole = F.coalesce(text, F.lit(""))
    plain = put if regex else put.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(whole, pattern, plain), F.regexp_count(whole, F.lit(pattern))


def json_within(text: Column) -> Column:
    """The JSON object in a text: the whole of it without code fences, else from the first brace to the last; null if neither is JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    widest = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    is_json = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    return F.when(is_json(bare), bare).when(is_json(widest), widest)

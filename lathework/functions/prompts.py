"""Which way of working a request asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals of each mode.
SIGNALS = {
    "scripted_plan": [
        r"\bfor each\b",
        r"\bfor every\b",
        r"\bone (?:per|for each|for every|for|bar|column|shape|row)\b",
        r"\bone\s+\w+\s+per\b",
        r"\bbased on (?:the\s+)?data\b",
        r"\bdepending on\b",
        r"\bdepends on\b",
        r"\bvarying\b",
        r"\bhowever many\b",
        r"\bautomatically generate(?:s|d)?\b",
        r"\bdata[- ]driven\b",
        r"\bdynamic(?:ally)?\b",
        r"\bquery\b.*\b(?:warehouse|database|api|snowflake|bigquery|redshift|postgres|sql)\b",
        r"\b(?:pull|fetch|load)\b.*\b(?:from|via)\b.*\b(?:warehouse|database|api|csv|sheet|spreadsheet|sql|snowflake|bigquery)\b",
        r"\b(?:script|python|pandas|sql)\b.*\b(?:that|to|which)\b",
        r"\bevery (?:day|week|month|quarter|year|hour)\b.*\b(?:bar|shape|element|tile|card)\b",
    ],
    "iterative_plan": [
        r"\bmatch\b",
        r"\bsame as\b",
        r"\bsame (?:color|style|font|size) as\b",
        r"\bbased on (?:the\s+)?(?:other|first|second|previous)\b",
        r"\b(?:make|set)\s+\w+\s+(?:to\s+)?match\b",
        r"\bfollow the (?:same|other)\b",
        r"\bcopy (?:the\s+)?(?:style|color|font|formatting) (?:from|of)\b",
        r"\bif (?:it|the|.*?)\b",
        r"\bonly if\b",
        r"\bunless\b",
        r"\bwherever\b",
        r"\bevery (?:slide|chart|table|element) (?:that|where|with)\b",
    ],
    "static_plan": [
        r"\bmake\s+(?:the|this)\s+\w+\s+(?:bold|italic|red|blue|green|larger|smaller|bigger)\b",
        r"\bchange\s+(?:the|this)\s+\w+\s+(?:to|color|font)\b",
        r"\bdelete (?:this|that|the)\b",
        r"\bremove (?:this|that|the)\b",
        r"\bduplicate (?:this|that|the)\b",
        r"\binsert (?:a|an|one)\b",
        r"\badd (?:a|an|one) \w+\b",
    ],
}
# Confidence without a hit, and at most.
CONFIDENCE = {"scripted_plan": (0.6, 0.9), "iterative_plan": (0.5, 0.85), "static_plan": (0.5, 0.8)}


def routed(prompt: Column) -> Column:
    """(mode, confidence): scripted signals win; iterative and static ones only without the other; else iterative at 0.4."""
    lower = F.lower(F.coalesce(prompt, F.lit("")))
    hits = {mode: reduce(lambda a, b: a + b, (lower.rlike(p).cast("int") for p in patterns)) for mode, patterns in SIGNALS.items()}

    def decided(mode: str) -> Column:
        low, most = CONFIDENCE[mode]
        return F.struct(F.lit(mode).alias("mode"), F.round(F.least(F.lit(most), low + 0.1 * hits[mode]), 2).alias("confidence"))

    default = F.struct(F.lit("iterative_plan").alias("mode"), F.lit(0.4).alias("confidence"))
    alone = lambda mode, other: (hits[mode] > 0) & (hits[other] == 0)
    return (
        F.when(hits["scripted_plan"] > 0, decided("scripted_plan"))
        .when(alone("iterative_plan", "static_plan"), decided("iterative_plan"))
        .when(alone("static_plan", "iterative_plan"), decided("static_plan"))
        .otherwise(default)
    )

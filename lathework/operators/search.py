"""Ranked search over tokens that rows carry, and retrieval by shared keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions.text import STOP_WORDS, identifier_tokens, search_tokens
from .graphs import settled

K1, B = 1.5, 0.75


def query_tokens(query: str) -> list[str]:
    import re

    found = dict.fromkeys(w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9_]*", query))
    return [w for w in found if len(w) >= 2 and w not in STOP_WORDS]


def text_scored(rows: DataFrame, query: str, text_col: str) -> DataFrame:
    """rows with text_score instead of text_col: BM25 of the query's words, each of which counts once a row; 0 for none.

    Texts are read and cut into words once: the counts of each row, a few numbers, are written beside its other columns and serve both the
    totals over all rows (one row) and the scores. Runs a job when it is called.
    """
    wanted = query_tokens(query)
    own = [F.col(c) for c in rows.columns if c != text_col]
    if not wanted:
        return rows.select(*own, F.lit(0.0).alias("text_score"))
    tokens = rows.select(*own, search_tokens(F.col(text_col)).alias("_tokens"))
    slim = settled(tokens.select(*own, F.size("_tokens").alias("_len"), F.array_intersect("_tokens", F.array(*map(F.lit, wanted))).alias("_found")))
    found = [F.array_contains("_found", w) for w in wanted]
    total = slim.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *(F.count_if(hit).alias(f"_df{i}") for i, hit in enumerate(found)))  # one row
    norm = 1 + K1 * (1 - B + B * F.greatest("_len", F.lit(1)) / F.col("_mean"))
    idf = lambda i: F.ln(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
    score = sum((F.when(hit, idf(i) * (K1 + 1) / norm).otherwise(0.0) for i, hit in enumerate(found)), F.lit(0.0))
    return slim.join(F.broadcast(total)).select(*own, score.alias("text_score"))


def bm25(docs: DataFrame, query: str, top: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of the rows that share a word with the query, best first; see text_scored(). Rows of equal score stand in order of id."""
    scored = text_scored(docs.select(id_col, text_col), query, text_col).filter("text_score > 0")
    ranked = scored.select(id_col, F.col("text_score").alias("score")).orderBy(F.desc("score"), id_col)
    return ranked.limit(top) if top else ranked


def with_confidence(ranked: DataFrame, ties: list, least: float = 1.5, gap: float = 0.1) -> DataFrame:
    """Scores of a bounded top-k over the best (or `least`), and whether the best two are too close to tell apart.

    ties order equal scores. The windows run in one task, so rank and limit first.
    """
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.desc("score"), *ties)
    out = ranked.withColumn("confidence", F.col("score") / F.greatest(F.max("score").over(whole), F.lit(least)))
    close = F.coalesce(F.col("confidence") - F.lead("confidence").over(order) < gap, F.lit(False))
    return out.withColumn("ambiguous", (F.row_number().over(order) == 1) & close)


def scoped(elements: DataFrame, pages: tuple[int, int] | list[int] | None = None, kinds: list[str] | None = None, page: str = "page", kind: str = "kind") -> DataFrame:
    """Elements of a list of pages or a range (a pair, both ends included) and of some kinds."""
    out = elements
    if pages is not None:
        out = out.filter(F.col(page).between(*pages) if isinstance(pages, tuple) else F.col(page).isin(*pages))
    return out if kinds is None else out.filter(F.col(kind).isin(*kinds))


def ranked_elements(
    elements: DataFrame, request: str, viewing: int | None = None, selected: int | None = None, pages=None, kinds: list[str] | None = None, least: float = 0.0, top: int = 5, id_col: str = "element_id", text_col: str | None = None
) -> DataFrame:
    """Elements(id, page, kind, place, z) that a request means: id, page, score, confidence, ambiguous.

    A request that is a pronoun means the selected element. Else the request's words count by BM25 over all elements if text_col names
    their text, a named kind counts 1, a named place 0.5, the viewed page 1, one next to it 0.3, and the viewed page once more 0.2 beside a selected element. Best first,
    then by z from the top, page and id; those below the least confidence go before the limit.
    """
    asked = elements.sparkSession.range(1).select(phrases.named_types(F.lit(request)), phrases.named_places(F.lit(request)), phrases.is_pronoun(F.lit(request))).first()
    here = scoped(elements, pages, kinds)
    page = F.col("page")
    said = F.lit(0.0)
    if asked[2] and selected is not None and viewing is not None:
        return with_confidence(here.filter((F.col(id_col) == selected) & (page == viewing)).select(id_col, "page", F.lit(1.0).alias("score")), ["page"], least=1.0)
    if text_col is not None:
        scored = text_scored(elements.select(id_col, "page", "kind", "place", "z", text_col), request, text_col)
        here, said = scoped(scored, pages, kinds), F.col("text_score")
    near = F.lit(0.0) if viewing is None else F.when(page == viewing, 1.2 if selected is not None else 1.0).when(F.abs(page - viewing) == 1, 0.3).otherwise(0.0)
    if viewing is not None and selected is not None:
        near = near - F.when((page == viewing) & (F.col(id_col) == selected), 0.2).otherwise(0.0)
    raw = said + F.when(F.col("kind").isin(*asked[0]), 1.0).otherwise(0.0) + near + F.when(F.col("place").isin(*asked[1]), 0.5).otherwise(0.0)
    scored = here.select(id_col, "page", "z", raw.alias("score")).filter("score > 0")
    best = scored.agg(F.max("score").alias("_best"))  # one row
    kept = scored.join(F.broadcast(best)).filter(F.col("score") / F.greatest("_best", F.lit(1.5)) >= least).drop("_best")
    # Rounded, so that equal sums of parts added in another order are equal.
    shown = kept.orderBy(F.desc(F.round("score", 9)), F.desc("z"), "page", id_col).limit(top)
    return with_confidence(shown, ["page", id_col])


def retrieve(chunks: DataFrame, query_text: str, top: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks that share most identifiers with the query: id, shared, score (the share of the query's)."""
    import re

    whole = re.findall("[A-Za-z][A-Za-z0-9_]*", query_text)
    parts = [p for w in whole for p in (w, *w.split("_"), *re.sub("(?<!^)([A-Z])", r" \1", w).split())]
    wanted = sorted({p.lower() for p in parts if len(p) >= 3})
    shared = F.size(F.array_intersect(identifier_tokens(F.col(text_col)), F.array(*map(F.lit, wanted)).cast("array<string>")))
    scored = chunks.select(F.col(id_col), shared.alias("shared")).filter("shared > 0")
    return scored.withColumn("score", F.round(F.col("shared") / max(1, len(wanted)), 4)).orderBy(F.desc("shared"), id_col).limit(top)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks between blank lines: id, chunk (from 0), text."""
    parts = F.filter(F.split(F.col(text_col), r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 0)
    return docs.select(F.col(id_col), F.posexplode(parts).alias("chunk", "text"))


def recent_or_scored(rows: DataFrame, query: str, score, changed: str, ties: list, recent: int = 8, top: int = 30) -> DataFrame:
    """Rows with score: for a query without text the last changed ones, each with 1, else those with a score above 0, the best first."""
    if not query.strip():
        return rows.withColumn("score", F.lit(1)).orderBy(F.desc(changed), *ties).limit(recent)
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), *ties).limit(top)

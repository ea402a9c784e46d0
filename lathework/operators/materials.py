"""Intake of uploaded material: scanned for secrets, refused or cut into chunks with their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import findings
from ..functions.text import identifier_tokens
from .grids import sheet_chunks
from .search import paragraphs

#: Kinds of files by suffix; others are text.
KINDS = {"csv": "csv", "tsv": "csv", "md": "text", "txt": "text"}


def file_kind(filename: Column) -> Column:
    """By what stands behind the last dot."""
    suffix = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), suffix), F.lit("text"))


def scanned(materials: DataFrame, id_col: str = "material_id", text_col: str = "text") -> DataFrame:
    """id, refused, n_findings, findings (kind and line, by line then kind): a text with any secret is refused."""
    found = findings.findings(materials, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("line", "kind"))).alias("findings"))
    none = F.array().cast("array<struct<line:int,kind:string>>")
    all_ = materials.select(id_col).join(found, id_col, "left").withColumn("findings", F.coalesce("findings", none))
    return all_.select(id_col, (F.size("findings") > 0).alias("refused"), F.size("findings").alias("n_findings"), "findings")


def chunks(materials: DataFrame, id_col: str = "material_id", text_col: str = "text", name_col: str = "filename", size: int = 20) -> DataFrame:
    """id, kind, nth (from 0), text, tokens of the chunks of materials: sheets by rows under their header, texts by paragraphs."""
    kinds = materials.withColumn("_kind", file_kind(F.col(name_col)))
    sheets = sheet_chunks(kinds.filter("_kind = 'csv'"), id_col, text_col, size)
    header_first = (F.col("line_start") - 1).alias("nth")
    texts = paragraphs(kinds.filter("_kind = 'text'"), id_col, text_col).select(id_col, F.lit("paragraph").alias("kind"), F.col("chunk").alias("nth"), "text")
    both = sheets.select(id_col, "kind", header_first, "text").unionByName(texts)
    return both.withColumn("tokens", F.sort_array(identifier_tokens(F.col("text"))))


def taken_in(materials: DataFrame, id_col: str = "material_id", text_col: str = "text", name_col: str = "filename", size: int = 20) -> tuple[DataFrame, DataFrame]:
    """What scanned() says with the number of chunks, and the chunks of the materials that are not refused.

    Nothing of a refused text goes further. Ids must be distinct; null and empty texts have no chunk and no finding.
    """
    verdict = scanned(materials, id_col, text_col)
    kept = materials.join(verdict.filter("refused").select(id_col), id_col, "left_anti")
    made = chunks(kept, id_col, text_col, name_col, size)
    counted = made.groupBy(id_col).agg(F.count("*").alias("chunks"))
    return verdict.join(counted, id_col, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))), made

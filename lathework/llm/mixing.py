"""Mixing sources to target weights: whole copies first, then Pareto order sampling of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, row: tuple = ()) -> DataFrame:
    """(doc_id, source, size, name, weight) and row: the number of words of each text (0 for a null one), and as name
    what tells rows apart: id and text."""
    text = F.col(text_col).cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    doc_id = F.col(id_col).cast("long")
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.greatest(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select(doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), name.alias("name"), weight.alias("weight"), *row)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes by weight. A
    target stops at `most` times its source's size; what is over is shared again until none is above. In
    order of size by weight that is one pass: a source is full if its bound lies below the level that
    the sources not yet passed share. The windows here run over one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place).cast("long")).withColumn("bound", most * F.col("source_size"))
    sources = sources.withColumn("ratio", F.col("bound") / F.col("weight"))
    everywhere = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("total", F.sum("source_size").over(everywhere)).withColumn("all_weight", F.sum("weight").over(everywhere))
    level = (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sources = sources.withColumn("full", F.col("ratio") < level)
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0)).over(everywhere)
    free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everywhere)
    shared = F.col("weight") * (left / F.nullif(free, F.lit(0)))
    return sources.select("source", "source_size", F.when(F.col("full"), F.col("bound").cast("double")).otherwise(shared).alias("target"))


def pareto_rank(name, odds, seed: int) -> F.Column:
    """Random odds by inclusion odds: u / (1 - u) over odds, with u from the md5 of seed and name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return (u / (1 - u)) / odds


def _ranked(rows: DataFrame, shares: DataFrame, most: int, seed: int, bins: int) -> DataFrame:
    """Adds each row's whole copies, the fraction of a further one, and its place (bin, rank) in its source's order."""
    shares = shares.withColumnRenamed("source", "_source")
    rows = rows.join(shares, rows["source"].eqNullSafe(shares["_source"])).drop("_source")
    expected = F.least(F.coalesce(F.col("rate") * F.col("weight"), F.lit(0.0)), F.lit(float(most)))
    rows = rows.withColumn("whole", F.floor(expected).cast("long")).withColumn("fraction", expected - F.floor(expected))
    rows = rows.withColumn("rank", F.when(F.col("fraction") > 0, pareto_rank(F.col("name"), F.col("fraction") / (1 - F.col("fraction")), seed)))
    return rows.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), F.lit(bins - 1)).cast("int"))


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, bins: int, columns: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes of all documents, the shares of the sources, and where each source's order is cut.

    The cut is found by summing words in `bins` ranges of the rank and ordering only the documents of the
    range that holds the cut; so no task orders a whole source.
    """
    sizes = written(sized(docs, **columns), "sizes")
    found = targets(sizes, weights, most)
    total = sizes.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("weight") * F.col("size")).alias("weighted"))
    found = found.join(total, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shares = written(found.withColumn("rate", F.col("target") / F.nullif(F.col("weighted"), F.lit(0.0))).drop("weighted"), "shares")

    ranked = _ranked(sizes, shares, most, seed, bins)
    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    rest = written(certain.select(F.col("source").alias("_source"), (F.col("target") - F.col("certain")).alias("rest")), "rest")
    by_bin = ranked.filter("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words")).join(rest, F.col("source").eqNullSafe(F.col("_source")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = by_bin.withColumn("before", before).filter("before < rest and before + words >= rest").groupBy("_source").agg(F.min(F.struct("bin", "before", "rest")).alias("cut"))
    cut = written(cut.select(F.col("_source").alias("cut_source"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"), F.col("cut.rest").alias("cut_rest")), "cuts")
    # Of the range that holds the cut, the last key that is taken and how many rows of that key are.
    around = ranked.join(cut, ranked["source"].eqNullSafe(cut["cut_source"]) & (ranked["bin"] == cut["cut_bin"]))
    running = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("rank", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = around.withColumn("running", running).filter("2 * running + size <= 2 * cut_rest").groupBy("source", "rank", "name").agg(F.count("*").alias("n"))
    last = taken.groupBy(F.col("source").alias("last_source")).agg(F.max(F.struct("rank", "name", "n")).alias("last"))
    cuts = rest.join(cut, rest["_source"].eqNullSafe(cut["cut_source"]), "left").join(last, F.col("_source").eqNullSafe(F.col("last_source")), "left")
    return sizes, shares, written(cuts.select("_source", "rest", "cut_bin", "last"), "cuts")


def _with_copies(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds how often each ranked row is taken. Rows of the cut's own key are alike; as many of them as are due are taken."""
    rows = ranked.join(cuts, ranked["source"].eqNullSafe(cuts["_source"]))
    key, last = F.struct("rank", "name"), F.struct(F.col("last.rank").alias("rank"), F.col("last.name").alias("name"))
    in_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    tied = in_cut & F.coalesce(key == last, F.lit(False))
    chosen = F.when(F.col("rank").isNull(), False).when(F.col("cut_bin").isNull(), F.col("rest") > 0).when(in_cut, F.coalesce(key < last, F.lit(False))).otherwise(F.col("bin") < F.col("cut_bin"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("rank"))
    sure = rows.filter(~tied).withColumn("chosen", chosen)
    return sure.unionByName(rows.filter(tied).withColumn("chosen", nth <= F.col("last.n"))).withColumn("copies", F.col("whole") + F.col("chosen").cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, bins: int = 4096, **columns) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies and taken (copies times size).

    A document's expected copies are proportional to its weight (1, or weight_col), so that a source's expected
    words are its target, and at most `most`: the whole part is certain, and of the fraction a sample of fixed
    size in words is drawn, in order of the Pareto rank, so that the words taken differ from the target by at
    most half of one document's words. With equal weights, the inclusion odds are equal within a source. If
    weights press documents against `most`, their source stays below its target.

    columns: id_col, text_col, source_col, weight_col. Ties go by id, then the text's digest; rows alike in both
    are taken one by one. Reruns agree. Null texts have size 0, a null source is a source of its own, null ids
    are told apart by their texts, null and negative weights are 0. An empty table gives an empty result. Other
    columns are not read.
    """
    sizes, shares, cuts = _plan(docs, weights, most, seed, bins, columns)
    rows = _with_copies(_ranked(sizes, shares, most, seed, bins), cuts)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, bins: int = 4096, **columns) -> DataFrame:
    """The rows of docs as often as mix() takes them; settings and the cases of nulls, ties and repeated rows are those of mix().

    Rows are judged where they stand, by the few numbers of their source; none is shuffled but those of the cut's
    own key. Other columns pass through, whatever their names. An empty table gives an empty result.
    """
    _, shares, cuts = _plan(docs, weights, most, seed, bins, columns)
    # The row travels as one struct, so that none of its names clash.
    rows = sized(docs, **columns, row=(F.struct(*docs.columns).alias("row"),))
    taken = _with_copies(_ranked(rows, shares, most, seed, bins), cuts).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select(*(F.col(f"row.{c}").alias(c) for c in docs.columns))

"""Brands: violations of a profile, palettes of pixels and elements, shares of what is used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import colour_distance
from .relate import nearest


@dataclass(frozen=True)
class Profile:
    palette: tuple[str, ...] = ()
    fonts: tuple[str, ...] = ()
    forbidden_colours: tuple[str, ...] = ()
    forbidden_fonts: tuple[str, ...] = ()
    tolerance: float = 0.05


def violations(elements: DataFrame, profile: Profile, id_col: str, colour: str = "colour", font: str = "font") -> DataFrame:
    """id, kind (forbidden, off_palette, off_font), severity, found and the expected colour: what breaks a brand's rules.

    A palette is small and broadcast; each distinct colour is compared with it once.
    """
    colours = elements.select(id_col, F.upper(F.col(colour)).alias("found")).filter("found is not null")
    fonts = elements.select(id_col, F.col(font).alias("found")).filter("found is not null")
    row = lambda df, kind, severity, expected: df.select(id_col, F.lit(kind).alias("kind"), severity.alias("severity"), "found", expected.cast("string").alias("expected"))
    nothing, high = F.lit(None), F.lit("high")
    bad_colour, bad_font = F.col("found").isin(*profile.forbidden_colours), F.col("found").isin(*profile.forbidden_fonts)
    out = row(colours.filter(bad_colour), "forbidden", high, nothing).unionByName(row(fonts.filter(bad_font), "forbidden", high, nothing))
    if profile.palette:
        palette = elements.sparkSession.createDataFrame([(c.upper(),) for c in profile.palette], "entry string")
        close = nearest(colours.filter(~bad_colour), "found", palette, "entry", colour_distance(F.col("found"), F.col("entry")))
        off = colours.filter(~bad_colour).join(close.filter(F.col("distance") > profile.tolerance), "found")
        out = out.unionByName(row(off, "off_palette", F.when(F.col("distance") < 0.3, "medium").otherwise("high"), F.col("entry")))
    if profile.fonts:
        out = out.unionByName(row(fonts.filter(~bad_font & ~F.col("found").isin(*profile.fonts)), "off_font", F.lit("low"), nothing))
    return out


def everything(*order: str | Column) -> WindowSpec:
    """A window over all rows of a table that is a bounded top-k."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def raster_palette(pixels: DataFrame, top: int = 8) -> DataFrame:
    """hex, count, rank, role of the most frequent colours of pixels(r, g, b, n) on steps of 8.

    Near-white, near-black and grey pixels don't count, nor does a leader with over three times the next one's.
    """
    r, g, b = (F.col(c) for c in "rgb")
    light, range_ = (r + g + b) / 3, F.greatest(r, g, b) - F.least(r, g, b)
    hexed = F.printf(F.lit("#%02X%02X%02X"), *(F.floor(c / 8).cast("int") * 8 for c in (r, g, b)))
    common = pixels.filter(light.between(25, 220) & (range_ >= 35)).groupBy(hexed.alias("hex")).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "hex").limit(top + 4)
    order = everything(F.desc("count"), "hex")
    led = common.select("*", F.row_number().over(order).alias("_nth"), F.lead("count").over(order).alias("_after"))
    kept = led.filter(~((F.col("_nth") == 1) & F.coalesce(F.col("count") > 3 * F.col("_after"), F.lit(False)))).drop("_nth", "_after")
    role = F.when(F.col("rank") == 1, "primary").when(F.col("rank") <= 4, "accent").otherwise("neutral")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("role", role)


def counted(rows: DataFrame, value: str, top: int) -> DataFrame:
    """hex, i: the most frequent values in order."""
    best = rows.groupBy(F.col(value).alias("hex")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hex").limit(top)
    return best.select("hex", F.row_number().over(everything(F.desc("n"), "hex")).alias("i"))


def topped_up(own: DataFrame, others: DataFrame, enough: int = 4, top: int = 8) -> DataFrame:
    """hex, rank: a palette's own colours in order; others(hex, i) unlike them follow only if it has fewer than `enough`."""
    few = own.limit(enough).agg((F.count("*") < enough).alias("_few"))  # one row
    more = others.join(F.broadcast(few)).filter("_few").select("hex", F.lit(1).alias("_from"), "i")
    first = own.select("hex", F.lit(0).alias("_from"), "i").unionByName(more).groupBy("hex").agg(F.min(F.struct("_from", "i")).alias("_at"))
    best = first.orderBy("_at").limit(top)
    return best.select("hex", F.row_number().over(everything("_at")).alias("rank"))


def shares(rows: DataFrame, value: str, top: int) -> DataFrame:
    """value, uses, share (per cent of all rows), rank of the most frequent values."""
    total = rows.agg(F.count("*").alias("_all"))  # one row
    best = rows.groupBy(value).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), value).limit(top)
    ranked = best.withColumn("rank", F.row_number().over(everything(F.desc("uses"), value)))
    return ranked.join(F.broadcast(total)).select(value, "uses", (100 * F.col("uses") / F.col("_all")).alias("share"), "rank")

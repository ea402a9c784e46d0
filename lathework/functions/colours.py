"""Colours with modifiers, as themes of documents state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "#888888"
WHOLE = 100000


def named(value: Column, theme: dict[str, str]) -> Column:
    """Replaces scheme:NAME by the theme's colour (null for an unknown name)."""
    entries = F.create_map(*(F.lit(x) for pair in theme.items() for x in pair)) if theme else F.create_map().cast("map<string,string>")
    return F.when(value.startswith("scheme:"), F.try_element_at(entries, F.substring(value, 8, 1000))).otherwise(value)


def modified(colour: Column, lum_mod: Column | None = None, lum_off: Column | None = None, shade: Column | None = None, tint: Column | None = None, alpha: Column | None = None) -> Column:
    """#RRGGBB of a colour after its modifiers, each in parts of 100,000; null modifiers change nothing.

    Lightness is scaled and shifted at the same hue and saturation, then come shade, tint, and a blend with
    white by alpha. Of #AARRGGBB the first byte is ignored; what is no colour is #888888.
    """
    part = lambda c, default: F.lit(default) if c is None else F.coalesce(c / WHOLE, F.lit(default))
    bare = F.regexp_replace(colour, "^#+", "")
    red, green, blue = (F.conv(F.substring(bare, at, 2), 16, 10).cast("int") / 255 for at in (-6, -4, -2))
    rgb = F.struct(F.array(red, green, blue).alias("all"), F.greatest(red, green, blue).alias("high"), F.least(red, green, blue).alias("low"))
    opacity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part(alpha, 1.0)))

    def lightened(x: Column) -> Column:
        """Adds the new lightness and the greatest channel that goes with it."""
        high, low = x["high"], x["low"]
        light = (high + low) / 2
        saturation = F.when(high == low, 0.0).when(light <= 0.5, (high - low) / (high + low)).otherwise((high - low) / (2 - high - low))
        after = F.greatest(F.lit(0.0), F.least(F.lit(1.0), light * part(lum_mod, 1.0) + part(lum_off, 0.0)))
        return _let(F.struct(after.alias("light"), saturation.alias("s")), lambda y: F.struct(x.alias("rgb"), y["light"].alias("light"), F.when(y["light"] <= 0.5, y["light"] * (1 + y["s"])).otherwise(y["light"] + y["s"] - y["light"] * y["s"]).alias("top")))

    def channel(x: Column, c: Column) -> Column:
        # At one hue a channel keeps its place between the least and the greatest channel.
        high, low = x["rgb"]["high"], x["rgb"]["low"]
        placed = F.when(high == low, x["light"]).otherwise(2 * x["light"] - x["top"] + (c - low) / (high - low) * 2 * (x["top"] - x["light"]))
        blended = (1 - (1 - placed * part(shade, 1.0)) * part(tint, 1.0)) * opacity + (1 - opacity)
        return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.round(blended * 255, 9)).cast("int"))).cast("long")), 2, "0")

    channels = _let(_let(rgb, lightened), lambda x: F.array_join(F.transform(x["rgb"]["all"], lambda c: channel(x, c)), ""))
    return F.when(bare.rlike("^([0-9A-Fa-f]{2})?[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), channels)).otherwise(UNKNOWN)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)

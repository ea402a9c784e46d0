"""Column functions on pages, positions, sizes of text, schedules and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aspects of pages with their ratios, lengths in EMU, seconds between runs.
ASPECTS = {"square": (1, 1), "landscape_16_9": (16, 9), "landscape_4_3": (4, 3), "portrait_9_16": (9, 16), "portrait_4_5": (4, 5)}
EMU = {"inches": 914400, "cm": 360000, "mm": 36000, "pt": 12700, "centipoints": 127}
INTERVALS = {"hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000}


def aspect(width: Column, height: Column, tolerance: float = 0.05) -> Column:
    """The named aspect within the tolerance, else by orientation; a page without extent is 16:9."""
    ratio = F.try_divide(width, height)
    out = F.when((width <= 0) | (height <= 0), "landscape_16_9")
    for name, (across, down) in ASPECTS.items():
        out = out.when(F.abs(ratio - across / down) < tolerance, name)
    return out.when(ratio > 1, "landscape_16_9").otherwise("portrait_9_16")


def moved(box: list[Column], source: tuple[Column, Column], target: tuple[float, float], strategy: str = "proportional_scale") -> list[Column]:
    """left, top, width, height on a page of another size: stretched, fitted with its aspect kept and centred, or as they are."""
    if strategy == "manual_only":
        return box
    across, down = F.lit(float(target[0])) / source[0], F.lit(float(target[1])) / source[1]
    if strategy == "preserve_aspect_fit":
        across = down = F.least(across, down)
    offset = [(F.lit(float(t)) - s * x) / 2 if strategy == "preserve_aspect_fit" else F.lit(0.0) for t, s, x in zip(target, source, (across, down), strict=True)]
    left, top, width, height = box
    return [F.round(x, 4) for x in (left * across + offset[0], top * down + offset[1], width * across, height * down)]


def percent_of(value: Column, whole: Column) -> Column:
    """To 3 places; 0 of a page without extent."""
    return F.when(whole > 0, F.round(100 * value / whole, 3)).otherwise(0.0)


def fitted_font(size: Column, length: Column, width: Column, height: Column) -> Column:
    """The font size at which a text of `length` characters fits its box in inches: never larger, at least 8, and
    only where the text takes over 1.1 times the room and the change is 5% or more."""
    per_line = F.greatest(F.lit(1), F.floor(width * 144 / size))
    lines = F.greatest(F.lit(1), F.floor(height * 72 / (size * 1.15)))
    fitting = F.sqrt(width * height * (144 * 72 / 1.15) / F.greatest(F.lit(1), length))
    shrunk = F.greatest(F.lit(8.0), F.least(size, fitting))
    known = (size > 0) & (width > 0) & (height > 0) & (length > 0)
    return F.when(known & (length > per_line * lines * 1.1) & (shrunk < size * 0.95), F.round(shrunk, 1)).otherwise(size)


def emu(value: Column, unit: str) -> Column:
    """A length as whole English Metric Units."""
    return (value * EMU[unit]).cast("long")


def from_emu(value: Column, unit: str) -> Column:
    return value / EMU[unit]


def estimated_tokens(*texts: Column) -> Column:
    """A quarter of the characters."""
    return sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0)) / 4


def next_run(after: Column, schedule: Column) -> Column:
    """When a schedule runs again; null on demand or for an unknown schedule."""
    out = F.lit(None).cast("timestamp")
    for name, seconds in INTERVALS.items():
        out = F.when(schedule == name, F.timestamp_seconds(F.unix_timestamp(after) + seconds)).otherwise(out)
    return out


def shown_number(value: Column, form: Column) -> Column:
    """A number as chart labels show it, by what its format holds: %, $, 0.00 or 0.0, else as it is."""
    fixed = lambda x, n: F.printf(F.lit(f"%.{n}f"), x.cast("double"))
    has = lambda mark: F.contains(form, F.lit(mark))
    return (
        F.when(has("%"), F.concat(fixed(value * 100, 0), F.lit("%")))
        .when(has("$"), F.concat(F.lit("$"), fixed(value, 0)))
        .when(has("0.00"), fixed(value, 2))
        .when(has("0.0"), fixed(value, 1))
        .otherwise(value.cast("string"))
    )

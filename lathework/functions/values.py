"""Column functions on dates, numbers, positions and colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of date levels in worksheets.
DATE_LEVELS = {"tdy": "day", "day": "day", "wk": "week", "mnth": "month", "qr": "quarter", "yr": "year", "hr": "hour", "mn": "minute", "sc": "second"}


def date_level(ts: Column, code: str) -> Column:
    if code not in DATE_LEVELS:
        raise ValueError(f"unknown date level {code}")
    return F.date_trunc(DATE_LEVELS[code], ts)


def spreadsheet_serial(date: Column, epoch_1904: bool = False) -> Column:
    """Days since the epoch of a spreadsheet; the 1900 one counts a 29 February that never was."""
    if epoch_1904:
        return F.datediff(date, F.lit("1904-01-01").cast("date"))
    days = F.datediff(date, F.lit("1899-12-31").cast("date"))
    return days + F.when(days > 59, 1).otherwise(0)


def column_letters(n: Column) -> Column:
    """1 is A, 27 is AA, 16384 is XFD; null outside of 1 to 16384."""
    letter = lambda x: F.char((F.pmod(x, F.lit(26)) + 65).cast("int"))
    a, b = n - 1, F.floor((n - 1) / 26) - 1
    c = F.floor(b / 26) - 1
    text = F.concat(F.when(b >= 26, letter(c)).otherwise(""), F.when(a >= 26, letter(b)).otherwise(""), letter(a))
    return F.when(n.between(1, 16384), text)


def column_number(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda total, x: F.when(x == "", total).otherwise(total * 26 + F.ascii(x) - 64))


def third(value: Column, whole: Column | float, names: tuple[str, str, str]) -> Column:
    return F.when(value < F.lit(whole) / 3, names[0]).when(value > F.lit(whole) * 2 / 3, names[2]).otherwise(names[1])


def quadrant(left: Column, top: Column, width: Column, height: Column, page_width: float = 13.333, page_height: float = 7.5) -> Column:
    """Which of nine fields of the page holds the middle: top-left ... center ... bottom-right."""
    row = third(top + height / 2, page_height, ("top", "middle", "bottom"))
    col = third(left + width / 2, page_width, ("left", "center", "right"))
    return F.when((row == "middle") & (col == "center"), "center").otherwise(F.concat_ws("-", row, col))


def band(value: Column, limits: list[float], names: list[str]) -> Column:
    """names[i] below limits[i], else the last name."""
    return reduce(lambda out, x: F.when(value < x[0], x[1]).otherwise(out), reversed(list(zip(limits, names[:-1], strict=True))), F.lit(names[-1]))


def rgb(hexed: Column) -> list[Column]:
    """Red, green and blue of #RRGGBB, 0 to 255."""
    return [F.conv(F.substring(hexed, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def hex_colour(value: Column) -> Column:
    """#RGB and #AARRGGBB as #RRGGBB in capitals; null if it is no colour."""
    bare = F.upper(F.regexp_replace(F.trim(value), "^#", ""))
    six = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).when(F.length(bare) == 8, F.substring(bare, 3, 6)).otherwise(bare)
    return F.when(six.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), six))


def colour_distance(a: Column, b: Column) -> Column:
    """0 for equal colours, 1 for black and white."""
    return F.sqrt(sum((((x - y) / 255) * ((x - y) / 255) for x, y in zip(rgb(a), rgb(b), strict=True)), F.lit(0.0)) / 3)


def is_pale(hexed: Column, least: int = 220) -> Column:
    """Whether a colour's brightness, 0 to 255, is above `least`."""
    red, green, blue = rgb(hexed)
    return (299 * red + 587 * green + 114 * blue) / 1000 > least


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


RULES = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def by_rule(text: Column, rule: str, limit: float, then: str | None, otherwise: str | None) -> Column:
    """The format of a cell by its number: `then` where the rule against the limit holds, else `otherwise`; null for a cell without a number.

    A cell's number is what its text begins with: "12 %" is 12.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}; known are {' '.join(RULES)}")
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.when(number.isNotNull(), F.when(RULES[rule](number, F.lit(float(limit))), F.lit(then)).otherwise(F.lit(otherwise)))

"""Functions of calculated fields on columns, and parameters whose values are bound before a query runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of date functions in calculated fields.
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
#: Labels of aggregations in names that are shown; fixed values. One that is missing is shown in capitals.
LABELS = {"sum": "SUM", "avg": "AVG", "min": "MIN", "max": "MAX", "tmn": "MIN", "tmx": "MAX", "tdy": "DATE", "cnt": "COUNT", "ctd": "COUNTD", "med": "MED", "usr": "", "pcto": "%", "mdy": "DATE", "wk": "WEEK", "mnth": "MONTH", "yr": "YEAR", "none": ""}


def _unit(name: str) -> str:
    if name.lower() not in UNITS:
        raise ValueError(f"unknown date unit {name}; known are {', '.join(UNITS)}")
    return name.lower()


def iif(condition: Column, then, otherwise, unknown=None) -> Column:
    """then where the condition holds, otherwise where it doesn't, unknown where it is null."""
    return F.when(condition, then).when(~condition, otherwise).otherwise(unknown)


def length(text: Column) -> Column:
    return F.length(text)


def as_text(value: Column) -> Column:
    return value.cast("string")


def date_add(unit: str, n: Column | int, date: Column) -> Column:
    """n units later; a month's end that isn't there becomes the last day. The time of day stays."""
    unit = _unit(unit)
    n = (F.lit(n) if isinstance(n, int) else n).cast("int")
    if unit in ("year", "quarter", "month"):
        return date.cast("timestamp") + F.make_ym_interval(F.lit(0), n * {"year": 12, "quarter": 3, "month": 1}[unit])
    seconds = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + n.cast("long") * seconds * 1_000_000)


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """How many borders between units lie between two times: from 31 December to 1 January is a year. Weeks begin on Monday."""
    unit = _unit(unit)
    cut = lambda c: F.date_trunc(unit, c.cast("timestamp"))
    if unit in ("year", "quarter", "month"):
        months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
        if unit == "month":
            return months.cast("long")
        return ((F.year(end) - F.year(start)) * (4 if unit == "quarter" else 1) + (F.quarter(end) - F.quarter(start) if unit == "quarter" else 0)).cast("long")
    seconds = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return F.floor((F.unix_timestamp(cut(end)) - F.unix_timestamp(cut(start))) / seconds).cast("long")


def date_part(unit: str, date: Column) -> Column:
    return F.date_part(F.lit(_unit(unit)), date).cast("int")


def date_trunc(unit: str, date: Column) -> Column:
    return F.date_trunc(_unit(unit), date)


def shown_name(aggregation: Column, field: Column) -> Column:
    """SUM(Sales) for an aggregated field; the field's own name if it names the aggregation, or has none."""
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    label = F.coalesce(F.element_at(known, F.lower(aggregation)), F.upper(aggregation), F.lit(""))
    named = (label == "") | F.contains(F.lower(field), F.lower(label))
    return F.when(named, field).otherwise(F.concat(label, F.lit("("), field, F.lit(")")))


class Parameters:
    """Values of a workbook's parameters. A field that asks for one without a value is refused, never filled in with another."""

    def __init__(self, **values):
        self.values: Mapping = dict(values)

    def __getitem__(self, name: str) -> Column:
        if name not in self.values:
            raise KeyError(f"parameter {name} has no value; bound are {', '.join(sorted(self.values)) or 'none'}")
        return F.lit(self.values[name])

    def bound(self, **values) -> Parameters:
        """With further or other values."""
        return Parameters(**{**self.values, **values})

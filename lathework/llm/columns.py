"""Column helpers of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F


def bound(value, use) -> F.Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

"""Metered spend: prices by longest match, budgets, crossed bands and thresholds."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
MOST_PRICES = 10_000


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(provider, model, input_tokens, output_tokens, ...) with cost, a decimal of 12 places.

    prices(nth, provider, part, in_per_1k, out_per_1k): the longest part that the model's name contains holds, of equally long ones the first by nth.
    Without one, or for a model without a name, the cost is 0. Prices hold to 9 places, and costs are whole multiples of a
    millionth of a millionth, so that their sums don't depend on their order. Distinct model names are matched, not calls, and a
    sheet of over MOST_PRICES rows is refused, so that it can be broadcast.
    """
    if prices.limit(MOST_PRICES + 1).count() > MOST_PRICES:
        raise ValueError(f"a price sheet has at most {MOST_PRICES} rows")
    sheet = F.broadcast(prices.select(F.lower("provider").alias("_p"), F.lower("part").alias("_part"), "nth", *(F.round(F.col(c) * 1_000_000_000).cast("long").alias(c) for c in ("in_per_1k", "out_per_1k"))))
    models = calls.select("provider", "model").distinct()
    fits = (F.lower(models["provider"]) == F.col("_p")) & (models["model"] != "") & F.contains(F.lower(models["model"]), F.col("_part"))
    rates = models.join(sheet, fits).groupBy("provider", "model").agg(F.max_by(F.struct("in_per_1k", "out_per_1k"), F.struct(F.length("_part"), -F.col("nth"))).alias("_rate"))
    units = F.coalesce(F.col("input_tokens") * F.col("_rate.in_per_1k") + F.col("output_tokens") * F.col("_rate.out_per_1k"), F.lit(0))
    cost = (units.cast("decimal(19,0)") * F.lit(Decimal("0.000000000001"))).cast("decimal(24,12)")
    return calls.join(rates, ["provider", "model"], "left").withColumn("cost", cost).drop("_rate")


def crossed_bands(calls: DataFrame, key: str, ts: str, cents: str, band_cents: int, days: int = 7) -> DataFrame:
    """Calls after which the spend of the last days is in a higher band than before: *, before, after, band.

    Whole cents, so that sums don't depend on their order. Calls at one instant don't see each other.
    The window runs within a key (an account).
    """
    window = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-days * DAY_US, -1)
    out = calls.withColumn("before", F.coalesce(F.sum(cents).over(window), F.lit(0))).withColumn("after", F.col("before") + F.col(cents))
    level = lambda c: F.floor(F.col(c) / band_cents)
    return out.filter(level("after") > level("before")).withColumn("band", level("after") * band_cents)


def budget_check(usage: DataFrame, limits: DataFrame, key: str, tokens: int, cost: float, defaults: dict[str, float]) -> DataFrame:
    """usage(key, day_tokens, month_tokens, day_usd, month_usd) against limits(key, same names), defaults where null.

    allowed, and reason: the first rule in order that the estimated call would break.
    """
    names = ["day_tokens", "month_tokens", "day_usd", "month_usd"]
    asked = {n: tokens if n.endswith("tokens") else cost for n in names}
    caps = limits.select(key, *(F.col(n).alias(f"cap_{n}") for n in names))
    joined = usage.join(caps, key, "left").withColumns({f"cap_{n}": F.coalesce(F.col(f"cap_{n}"), F.lit(defaults[n])) for n in names})
    reason = F.lit(None).cast("string")
    for n in reversed(names):
        reason = F.when(F.col(n) + asked[n] > F.col(f"cap_{n}"), n).otherwise(reason)
    room = {f"left_{n}": F.greatest(F.lit(0), F.col(f"cap_{n}") - F.col(n)) for n in names}
    return joined.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).withColumns(room)


def thresholds(totals: DataFrame, key: str, month: str, spent: str, step: float) -> DataFrame:
    """A row for each multiple of step that a month's spend has reached: *, threshold."""
    reached = F.floor(F.col(spent) / step).cast("int")
    return totals.filter(reached >= 1).select("*", F.explode(F.sequence(F.lit(1), reached)).alias("_k")).withColumn("threshold", F.col("_k") * step).drop("_k")


def projected(month_to_date: DataFrame, spent: str, today: str) -> DataFrame:
    """Spend at the month's end if each day goes on as the days so far did on average."""
    days = F.dayofmonth(F.last_day(today))
    return month_to_date.withColumn("projected", F.col(spent) / F.dayofmonth(today) * days)


def alert_ladder(readings: DataFrame, key: str, at: str, spent: str, step: float, kill: float) -> DataFrame:
    """Of readings(key, at, spent so far in at's month) those that alert: key, at, boundary (a row for each multiple of step newly reached), kill.

    What was alerted before holds within a month: the next month begins at 0, and a reading lower than one before alerts nothing. kill marks the first
    alerting reading of a month with at least that much spent, on its highest boundary.
    """
    month = Window.partitionBy(key, F.date_trunc("month", at)).orderBy(at)
    before = month.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.floor(F.col(spent) / step).cast("long")
    rows = readings.select(key, at, F.col(spent).alias("_spent"), reached.alias("_to"))
    rows = rows.withColumn("_from", F.greatest(F.coalesce(F.max("_to").over(before), F.lit(0)), F.lit(0)))
    alerting = rows.withColumn("_over", ((F.col("_to") > F.col("_from")) & (F.col("_spent") >= kill)).cast("int"))
    alerting = alerting.withColumn("_kill", (F.col("_over") == 1) & (F.coalesce(F.sum("_over").over(before), F.lit(0)) == 0)).filter("_to > _from")
    each = alerting.select(key, at, "_to", "_kill", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_k"))
    return each.select(key, at, (F.col("_k") * step).alias("boundary"), (F.col("_kill") & (F.col("_k") == F.col("_to"))).alias("kill"))


def statement(charges: DataFrame, by: list[str], kind: str, amount: str, day: str) -> DataFrame:
    """by, gross, credits, net, days, daily_burn: usage and credits (negative amounts) of charges; days from the first to the last, both included."""
    of = lambda name: F.sum(F.when(F.lower(kind) == name, F.col(amount)).otherwise(0))
    span = F.datediff(F.max(day), F.min(day)) + 1
    out = charges.groupBy(*by).agg(of("usage").alias("gross"), of("credit").alias("credits"), F.greatest(span, F.lit(1)).alias("days"))
    return out.select(*by, "gross", "credits", (F.col("gross") + F.col("credits")).alias("net"), "days", (F.col("gross") / F.col("days")).alias("daily_burn"))


def top_services(charges: DataFrame, by: list[str], service: str, kind: str, amount: str, least: float = 0.01, top: int = 8) -> DataFrame:
    """by, service, gross, nth: each group's services by usage, the dearest first, equal ones by name, `top` of those with more than `least`."""
    grouped = charges.filter(F.lower(kind) == "usage").groupBy(*by, service).agg(F.sum(amount).alias("gross")).filter(F.col("gross") > least)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gross"), service))
    return grouped.withColumn("nth", nth).filter(F.col("nth") <= top)


def utilisation(usage: DataFrame, limits: DataFrame, key: str, defaults: dict[str, float]) -> DataFrame:
    """usage(key, day_tokens, month_tokens, day_usd, month_usd) with left_ and pct_ of each against limits(key, same names), defaults where null.

    Per cent to one place; a limit of 0 counts as 1 token or a thousandth of a dollar.
    """
    names = ["day_tokens", "month_tokens", "day_usd", "month_usd"]
    joined = usage.join(limits.select(key, *(F.col(n).alias(f"_{n}") for n in names)), key, "left")
    cap = {n: F.coalesce(F.col(f"_{n}"), F.lit(defaults[n])) for n in names}
    least = {n: F.lit(1.0 if n.endswith("tokens") else 0.001) for n in names}
    left = {f"left_{n}": F.greatest(F.lit(0.0), cap[n] - F.col(n)) for n in names}
    share = {f"pct_{n}": F.round(100 * F.col(n) / F.greatest(least[n], cap[n]), 1) for n in names}
    return joined.withColumns({**left, **share}).drop(*(f"_{n}" for n in names))

"""Prices out of feeds, and what they read as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(values: Column) -> Column:
    """struct<price_min, price_max>; the maximum only where it is above the minimum."""
    low, high = F.array_min(values), F.array_max(values)
    return F.struct(low.alias("price_min"), F.when(high > low, high).alias("price_max"))


def _numbers(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double"))


def from_text(cost: Column, values: Column | None = None) -> Column:
    """Listed values first, then "free", then the numbers in the text."""
    none = F.struct(F.lit(None).cast("double").alias("price_min"), F.lit(None).cast("double").alias("price_max"))
    free = F.struct(F.lit(0.0).alias("price_min"), F.lit(None).cast("double").alias("price_max"))
    listed = F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull()) if values is not None else F.array().cast("array<double>")
    return (
        F.when(F.size(listed) > 0, _range(listed))
        .when(F.contains(F.lower(cost), F.lit("free")), free)
        .when(F.size(_numbers(cost)) > 0, _range(_numbers(cost)))
        .otherwise(none)
    )


def from_ticket_classes(classes: Column, is_free: Column) -> Column:
    """Of classes struct<free, value>: least and largest paid price; a free event costs 0."""
    paid = F.filter(F.transform(F.filter(classes, lambda c: ~F.coalesce(c["free"], F.lit(False))), lambda c: c["value"].try_cast("double")), lambda v: v > 0)
    zero = F.struct(F.lit(0.0).alias("price_min"), F.lit(0.0).alias("price_max"))
    return F.when(is_free, zero).otherwise(_range(paid))


def from_ranges(ranges: Column) -> Column:
    """Of struct<min, max>: the least minimum and the largest maximum."""
    return F.struct(F.array_min(F.transform(ranges, lambda r: r["min"])).alias("price_min"), F.array_max(F.transform(ranges, lambda r: r["max"])).alias("price_max"))


def from_fees(groups: Column) -> Column:
    """Of nested lists of fee texts: the range of what is left without currency signs."""
    fees = F.filter(F.transform(F.flatten(groups), lambda f: F.regexp_replace(f, r"[^0-9.]", "").try_cast("double")), lambda f: f.isNotNull())
    return _range(fees)


def is_free(low: Column, high: Column) -> Column:
    return F.coalesce((low == 0) & (high.isNull() | (high == 0)), F.lit(False))


def bucket(low: Column, high: Column, name: str) -> Column:
    """Filters free, under10 and under25; an unknown price is in none."""
    tests = {"free": is_free(low, high), "under10": low <= 10, "under25": low <= 25}
    return tests[name] if name in tests else F.lit(True)


def label(low: Column, high: Column) -> Column:
    """See tickets, Free, a range or one price; whole amounts have no decimals."""
    money = lambda c: F.concat(F.lit("$"), F.regexp_replace(F.format_string("%.2f", c.cast("double")), r"\.00$|(?<=\.\d)0$", ""))
    amount = lambda c: F.when(c == 0, "$0").otherwise(money(c))
    return (
        F.when(low.isNull() & high.isNull(), "See tickets")
        .when((low == 0) & (F.coalesce(high, F.lit(0)) == 0), "Free")
        .when(high > F.coalesce(low, F.lit(0)), F.concat(amount(F.coalesce(low, F.lit(0))), F.lit("–"), amount(high)))
        .otherwise(amount(low))
    )


def metered(components: Column, base: Column) -> Column:
    """Monthly cost: base plus for each struct<usage, included, unit, rate> what is above the included amount, rounded up."""
    over = F.aggregate(components, F.lit(0.0), lambda s, c: s + F.greatest(c["usage"] - c["included"], F.lit(0.0)) / c["unit"] * c["rate"])
    return F.ceil(base + over)


def step(steps: Column, driver: Column) -> Column:
    """Cost of the first struct<bound, cost> whose bound is not exceeded, else of the last."""
    return F.coalesce(F.get(F.filter(steps, lambda s: driver <= s["bound"]), F.lit(0)), F.try_element_at(steps, F.lit(-1)))["cost"]


def impact(users: Column, outings: float, spend: float) -> Column:
    """users x outings x spend, rounded once at the end."""
    return F.round(users * outings * spend).cast("long")


def adoption(population: Column, low_rate: Column, high_rate: Column, share: Column) -> Column:
    """Visits by a rate between two, in proportion to the share."""
    return population * (low_rate + (high_rate - low_rate) * share)


def cents_per_head(cost: Column, people: Column) -> Column:
    """Cents per person, rounded up to a tenth."""
    return F.ceil(cost / people * 1000) / 10

"""Ordered analytics: sessions, gaps, caps, ranks and samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.times import day_key, minutes_between


def _runs(rows: DataFrame, key: str, hours: float, *more: Column) -> DataFrame:
    """(key, bin, session, and ``more`` aggregates) of the time bins that hold rows: bins are as wide as the gap allowed.

    Rows of one bin are never a gap apart, so a bin needs no order inside: its first and last start say all.  Only bins are put
    in order, and a key has as many as gaps fit into its time, however many rows it has.
    """
    gap = int(hours * 3.6e9)
    bins = rows.filter(F.col("start_at").isNotNull()).groupBy(key, _bin(gap).alias("bin")).agg(F.min(F.unix_micros("start_at")).alias("lo"), F.max(F.unix_micros("start_at")).alias("hi"), *more)
    w = Window.partitionBy(key).orderBy("bin")
    apart = F.col("lo") - F.lag("hi").over(w)
    new = F.when(apart.isNull() | (apart > gap), 1).otherwise(0)
    return bins.withColumn("new", new).withColumn("session", F.sum("new").over(w)).drop("lo", "hi", "new")


def _bin(gap: int) -> Column:
    us = F.unix_micros("start_at")
    return us - F.pmod(us, F.lit(max(gap, 1)))


def sessions(events: DataFrame, key: str, hours: float) -> DataFrame:
    """Events with the number of their session: a new one begins where the gap to the one before exceeds ``hours``.

    Null keys are one key; events without a start have a null session.  Sessions are found among time bins and joined back by
    key and bin, so one key's events lie in many tasks.
    """
    gap = int(hours * 3.6e9)
    runs = _runs(events, key, hours).select(F.col(key).alias("_key"), F.col("bin").alias("_bin"), "session")
    return events.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (_bin(gap) == F.col("_bin")), "left").drop("_key", "_bin")


def clusters(events: DataFrame, key: str, hours: float, least_sources: int = 2) -> DataFrame:
    """Sessions of two or more events from enough sources, put together from their time bins; events without key or start go."""
    parts = _runs(events.filter(F.col(key) != ""), key, hours, F.count("*").alias("n"), F.collect_set("source").alias("of"), F.min("id").alias("first_id"))
    found = parts.groupBy(key, "session").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("of")))).alias("of"), F.min("first_id").alias("first_id"))
    return found.select(key, "session", "n", F.size("of").cast("long").alias("sources"), F.array_join("of", "+").alias("pair"), "first_id").filter((F.col("n") >= 2) & (F.col("sources") >= least_sources))


def source_pairs(found: DataFrame) -> DataFrame:
    return found.groupBy("pair").agg(F.count("*").alias("n"))


def gaps(items: DataFrame, group: str, line: str = "line") -> DataFrame:
    """Items with the minutes from the end (or start) of the one before to their start."""
    w = Window.partitionBy(group).orderBy("start_at", line)
    before = F.lag(F.coalesce("end_at", "start_at")).over(w)
    return items.withColumn("gap_minutes", minutes_between(before, F.col("start_at")))


def capped(events: DataFrame, capped_sources: tuple[str, ...], cap: int = 3) -> DataFrame:
    """Events by day with shown and hidden_count: of a capped source the first ``cap`` a day are shown."""
    day = day_key(F.col("start_at"))
    w = Window.partitionBy("day", "source")
    ranked = events.withColumn("day", day).withColumn("rn", F.row_number().over(w.orderBy("start_at", "id"))).withColumn("of", F.count("*").over(w))
    limited = F.col("source").isin(*capped_sources)
    hidden = F.when(limited, F.greatest(F.col("of") - cap, F.lit(0))).otherwise(0)
    return ranked.withColumn("shown", ~limited | (F.col("rn") <= cap)).withColumn("hidden_count", hidden).drop("of")


def featured_first(events: DataFrame) -> DataFrame:
    """Place of each event in its day: featured ones first, then by time."""
    w = Window.partitionBy("day").orderBy(F.desc("featured"), "start_at", "id")
    return events.withColumn("day", day_key(F.col("start_at"))).withColumn("place", F.row_number().over(w))


def numbered(items: DataFrame, group: str) -> DataFrame:
    """1..n over a group in the order of days and times."""
    return items.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy("start_at", "line")))


def rank_by(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The best row of each group by several keys."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def up_next(slots: DataFrame, as_of: datetime) -> DataFrame:
    """One row: the first start after now, and how many slots with a known end contain now."""
    now = F.lit(as_of)
    return slots.agg(F.min(F.when(F.col("start_at") > now, F.col("start_at"))).alias("next_at"), F.count_if((F.col("start_at") <= now) & (F.col("end_at") > now)).alias("happening"))


def schedule(events: DataFrame) -> DataFrame:
    """Slots of equal start, each with its events in column order: numbered porches, known stages, others by name."""
    entry = F.struct("kind_rank", "number", "stage_rank", "name", "id")
    return events.groupBy("start_at").agg(F.array_sort(F.collect_list(entry)).alias("columns"), F.count("*").alias("n"))


def column_rank(kind: Column, number: Column, name: Column, stages: tuple[str, ...]) -> dict[str, Column]:
    order = F.array_position(F.array(*map(F.lit, stages)), name) if stages else F.lit(0)
    return {"kind_rank": F.when(kind == "porch", 0).when(order > 0, 1).otherwise(2), "number": F.coalesce(number, F.lit(0)), "stage_rank": order, "name": F.coalesce(name, F.lit(""))}


def map_pins(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Venues with coordinates: number of events, first and last start."""
    own = events.groupBy(F.col("venue_id").alias("p_id")).agg(F.count("*").alias("n"), F.min("start_at").alias("first_at"), F.max("start_at").alias("last_at"))
    return venues.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).join(own, F.col("id") == F.col("p_id")).drop("p_id")


def bounding_box(points: DataFrame) -> DataFrame:
    """One row, all null for no points."""
    return points.agg(F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east"))


def even_positions(n: Column, k: int) -> Column:
    """Places 0..n-1 of k evenly spread elements, ends included, collisions dropped; all if there are no more than k."""
    if k <= 0:
        return F.array().cast("array<int>")
    if k == 1:
        spread = F.array(F.floor((n - 1) / 2).cast("int"))
    else:
        spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1) + 0.5).cast("int")))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(spread)

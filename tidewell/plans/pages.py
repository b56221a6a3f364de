"""Baked first pages and festivals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text, times
from tidewell.operators import browse
from tidewell.sources.sinks import recover, swap


def bake(events: DataFrame, bridge: DataFrame, venues: DataFrame, as_of: datetime, path: str, hidden: tuple[str, ...] = ()) -> None:
    """Writes the unfiltered first page, which readers take while it is fresh; the write is swapped in."""
    spec = browse.QuerySpec(as_of, hidden_tags=hidden, limit=browse.FIRST_PAGE)
    swap(browse.page(events, bridge, venues, spec), path)


def cached(spark: SparkSession, key: str, path: str, make: Callable[[], DataFrame], now: datetime, fresh: timedelta = timedelta(minutes=5), most: int = 10_000) -> DataFrame:
    """The result kept under ``path`` for ``key`` if it is fresh, else ``make``'s, which is kept if it has at most ``most`` rows.

    A larger result is answered but not kept, so what is stored for a key is bounded.
    """
    place = f"{path.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}"
    if recover(spark, place):
        kept = spark.read.parquet(place)
        if not kept.filter(F.col("kept_at") > F.lit(now - fresh)).isEmpty():
            return kept.drop("kept_at")
    made = make()
    if made.limit(most + 1).count() > most:
        return made
    swap(made.withColumn("kept_at", F.lit(now)), place)
    return spark.read.parquet(place).drop("kept_at")


def resolve_festivals(asked: DataFrame, registry: DataFrame, today: date) -> DataFrame:
    """Asked names (ask_id, name) with the festival (slug, name, day) they mean: one of its candidate keys, the nearest
    upcoming day where several agree, else the latest past one.

    Keys have no blanks, so "lantern-1-2022" and "Lantern 12022" share one: festivals with the words that were asked for come first.
    """
    named = F.explode(text.festival_names(F.col("slug"), F.col("name")))
    keys = registry.select("slug", "day", named.alias("n")).select("slug", "day", text.query_key(F.col("n")).alias("k"), text.spelled(F.col("n")).alias("words")).filter(F.length("k") >= 4).distinct()
    ahead = F.datediff("day", F.lit(today))
    order = F.struct((F.col("words") != F.col("said")).alias("squashed"), (ahead < 0).alias("past"), F.abs(ahead).alias("far"), "slug")
    met = asked.select("ask_id", text.query_key(F.col("name")).alias("k"), text.spelled(F.col("name")).alias("said")).join(keys, "k")
    return met.groupBy("ask_id").agg(F.min_by("slug", order).alias("slug"))


def upcoming_festival(registry: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """The earliest festival from today to ``days`` ahead, in one row, null if there is none."""
    today = F.to_date(times.local(F.lit(as_of).cast("timestamp")))
    ahead = F.datediff("day", today)
    return registry.agg(F.min_by(F.when(ahead.between(0, days), F.col("slug")), F.when(ahead.between(0, days), F.struct("day", "slug"))).alias("slug"))

"""Keyed merges on Parquet: upserts with locked fields, bridges, ledgers and logs, all safe to run again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import override_locked


def newest(rows: DataFrame, keys: list[str], order: str, *dealt: str) -> DataFrame:
    """One row a key: the last by an order column; ties go to the largest row.

    ``dealt`` are columns that keys tell, by which the rows are dealt out already: they stay, and rows are not dealt out again.
    """
    names = [c for c in rows.columns if c not in dealt]
    last = F.max_by(F.struct(*names), F.struct(order, F.xxhash64(*names)))
    return rows.groupBy(*dealt, *keys).agg(last.alias("r")).select("r.*", *dealt)


def upsert(base: DataFrame, staged: DataFrame, keys: list[str], locks: str | None = None, protected: tuple[str, ...] = ()) -> DataFrame:
    """Base with staged rows merged by key: one full outer join.

    A staged value replaces the base's, but not null over a value, nor a field named in the base row's JSON of manual
    overrides (column ``locks``), nor a ``protected`` field.  Running it again changes nothing.
    """
    other = staged.select(*(F.col(c).alias(f"s_{c}") for c in staged.columns))
    on = [F.col(k) == F.col(f"s_{k}") for k in keys]
    joined = base.withColumn("b_in", F.lit(True)).join(other, on, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(c, f"s_{c}")
        if c not in staged.columns or c in protected:
            return F.when(F.col("b_in"), F.col(c)).otherwise(F.col(f"s_{c}")) if c in staged.columns else F.col(c)
        merged = F.coalesce(f"s_{c}", c)
        return F.when(F.col("b_in") & override_locked(F.col(locks), c), F.col(c)).otherwise(merged) if locks and c != locks else merged

    return joined.select(*(value(c).alias(c) for c in base.columns))


def counts(base: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many staged rows are new and how many update."""
    known = base.select(*keys).withColumn("known", F.lit(True))
    return staged.join(known, keys, "left").agg(F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if(F.col("known")).alias("updated"))


def not_aliased(staged: DataFrame, aliases: DataFrame, events: DataFrame) -> DataFrame:
    """Staged rows without those whose key is an alias of an event that still exists."""
    live = aliases.join(events.select(F.col("id").alias("e_id")), F.col("canonical_id") == F.col("e_id"), "left_semi")
    return staged.join(live.select("source", "source_id"), ["source", "source_id"], "left_anti")


def replaced(bridge: DataFrame, new: DataFrame, parent: str, locked: DataFrame | None = None) -> DataFrame:
    """A bridge with the links of the new rows' parents replaced, unless a parent is locked."""
    fresh = new if locked is None else new.join(locked, parent, "left_anti")
    return bridge.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh.distinct())


def linked(bridge: DataFrame, new: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """A bridge with new links added once; ``blocked`` pairs (same columns) are left out."""
    fresh = new if blocked is None else new.join(blocked, new.columns, "left_anti")
    return bridge.unionByName(fresh).distinct()


def over_limit(bridge: DataFrame, parent: str, most: int) -> DataFrame:
    """Parents with more links than allowed: empty where the rule holds."""
    return bridge.groupBy(parent).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def synced_arrays(parents: DataFrame, bridge: DataFrame, parent: str, value: str, name: str) -> DataFrame:
    """Parents with the sorted distinct values of their links, empty without links."""
    own = bridge.groupBy(F.col(parent).alias("k")).agg(F.array_sort(F.collect_set(value)).alias("v"))
    return parents.join(own, F.col("id") == F.col("k"), "left").withColumn(name, F.coalesce("v", F.array().cast("array<string>"))).drop("k", "v")


def reopened(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (id, title, start_at, reviewed_at) whose review is cleared where title or start changed."""
    before = old.select(F.col("id").alias("o_id"), F.col("title").alias("o_title"), F.col("start_at").alias("o_start"))
    changed = F.col("o_id").isNotNull() & ~(F.col("title").eqNullSafe(F.col("o_title")) & F.col("start_at").eqNullSafe(F.col("o_start")))
    return new.join(before, F.col("id") == F.col("o_id"), "left").withColumn("reviewed_at", F.when(~changed, F.col("reviewed_at"))).select(*new.columns)


def claimed(ledger: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose key is not in the ledger, each once: the set a run may work on, however often it starts."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in wanted.columns if c != key] or [key]))
    return wanted.join(ledger.select(key), key, "left_anti").withColumn("rn", first).filter("rn = 1").drop("rn")


def due(subscribers: DataFrame, weekday: int, month_day: int) -> DataFrame:
    """Active subscribers to write to today: daily ones, weekly ones on their day, monthly ones on the first."""
    f = F.col("frequency")
    return subscribers.filter(F.col("active") & ((f == "daily") | ((f == "weekly") & (F.col("send_day") == weekday)) | ((f == "monthly") & F.lit(month_day == 1))))


def attributed(results: DataFrame, sent: DataFrame, key: str = "id") -> DataFrame:
    """Send results joined to what was sent by id, never by position; without a result a send counts as failed."""
    return sent.join(results, key, "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def stamped(before: DataFrame, after: DataFrame, keys: list[str], now: datetime, column: str = "updated_at") -> DataFrame:
    """Rows after a merge with ``column`` set to ``now`` where a row is new or any other of its fields has changed."""
    fields = [c for c in after.columns if c != column]
    old = before.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.xxhash64(*fields).alias("o_hash"), F.col(column).alias("o_at"))
    joined = after.join(old, [F.col(k) == F.col(f"o_{k}") for k in keys], "left")
    same = F.coalesce(F.xxhash64(*fields) == F.col("o_hash"), F.lit(False))
    return joined.select(*(F.when(same, F.col("o_at")).otherwise(F.lit(now)).alias(c) if c == column else c for c in after.columns))

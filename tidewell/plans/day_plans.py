"""Day plans: changes to them as merges, and a plan as one nested row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.joins import plan_rollup, purgeable, resolve_items
from tidewell.operators.merge import upsert

ITEM_KEYS = ["plan_id", "event_id"]


def created(plans: DataFrame, new: DataFrame) -> DataFrame:
    """Plans with new ones; a plan that exists stays as it is."""
    return plans.unionByName(new.join(plans.select("plan_id"), "plan_id", "left_anti"), allowMissingColumns=True)


def titled(plans: DataFrame, titles: DataFrame) -> DataFrame:
    return upsert(plans, titles, ["plan_id"])


def added(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with new ones (plan_id, event_id, added_at, ...); one that was removed comes back with its first added_at."""
    back = new.withColumn("removed", F.lit(False))
    return upsert(items, back, ITEM_KEYS, protected=("added_at",))


def removed(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Soft deletion: items stay as rows and count no more."""
    return upsert(items, gone.select(*ITEM_KEYS).withColumn("removed", F.lit(True)), ITEM_KEYS)


def as_json(plans: DataFrame, items: DataFrame, events: DataFrame, aliases: DataFrame) -> DataFrame:
    """(plan_id, items): each plan's resolved items as JSON, ordered by the time of the event, or of the snapshot if it is gone."""
    resolved = resolve_items(items, events, aliases)
    live = events.select(F.col("id").alias("e_id"), F.col("title").alias("e_title"), F.col("start_at").alias("e_start"))
    gone = F.col("resolved_id").isNull()  # as keys of the join they would all meet in one task
    shown = resolved.filter(~gone).join(live, F.col("resolved_id") == F.col("e_id"), "left").unionByName(resolved.filter(gone), allowMissingColumns=True)
    at = F.coalesce("e_start", "snap_start_at")
    item = F.struct(at.alias("sort_at"), "event_id", "resolved_id", "status", F.coalesce("e_title", "snap_title").alias("title"))
    packed = shown.groupBy("plan_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda s: s.dropFields("sort_at"))).alias("items"))
    return plans.select("plan_id").join(packed, "plan_id", "left").withColumn("items", F.coalesce("items", F.lit("[]")))


def purged(plans: DataFrame, items: DataFrame, events: DataFrame, as_of: datetime) -> tuple[DataFrame, int]:
    """Plans without expired ones, and how many went."""
    gone = purgeable(plan_rollup(plans, items), items, events, as_of).select("plan_id")
    return plans.join(gone, "plan_id", "left_anti"), gone.count()

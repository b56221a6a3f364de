"""Browsing: a query specification becomes one declarative plan.

Filters, the date window and the column list all reach the scan; categories are semi and anti joins on the bridge; only the
page that is shown is sorted, by a top-k that never sorts the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import prices, text, times

#: Intents stand for sets of categories.
INTENTS = {"night-out": ("music", "comedy"), "learn": ("learning", "civic"), "outside": ("outdoors", "sports"), "eat": ("food", "market"), "see": ("theater", "film", "visual-art")}
PAGE = 24
FIRST_PAGE = 48


@dataclass(frozen=True)
class QuerySpec:
    """What a browser asks for; see ``effective`` for how parts override each other."""

    as_of: datetime
    window: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    intents: tuple[str, ...] = ()
    locked: tuple[str, ...] = ()
    price: str | None = None
    free: bool = False
    daypart: str | None = None
    search: str | None = None
    tag: str | None = None
    venue_ids: tuple[int, ...] = ()
    not_sources: tuple[str, ...] = ()
    hidden_tags: tuple[str, ...] = ()
    umbrella_tag: str = "umbrella"
    sort: str = "soonest"
    offset: int = 0
    limit: int = PAGE
    columns: tuple[str, ...] = field(default=("id", "title", "start_at", "category", "price_min", "price_max", "venue_id"))

    def effective(self) -> QuerySpec:
        """Locked categories beat intents, which widen what is included; included beats excluded; free beats a price bucket;
        a custom range beats a preset."""
        include = self.locked or tuple(dict.fromkeys([*self.include, *(c for i in self.intents for c in INTENTS.get(i, ()))]))
        bounds = (self.since, self.until)
        if self.window and not any(bounds):
            bounds = times.preset_bounds(self.window, self.as_of)
        return replace(
            self, include=include, intents=(), locked=(), exclude=tuple(c for c in self.exclude if c not in include), price="free" if self.free else self.price, since=bounds[0], until=bounds[1], window=None
        )


def visible(tags: Column, hidden: tuple[str, ...], umbrella: str) -> Column:
    """Rows of a registered tag are hidden unless they carry the umbrella tag; without registered tags all are visible."""
    if not hidden:
        return F.lit(True)
    return F.array_contains(tags, umbrella) | ~F.arrays_overlap(tags, F.array(*map(F.lit, hidden)))


def not_true(flag: Column) -> Column:
    """False and null alike."""
    return ~F.coalesce(flag, F.lit(False))


def excluded_sources(source: Column, names: tuple[str, ...]) -> Column:
    """NOT IN with SQL's treatment of null: a null source is in no result."""
    return ~source.isin(*names)


def not_ended(start: Column, end: Column, as_of: datetime) -> Column:
    """Not over yet; without an end, not before today's midnight in the zone."""
    midnight, _ = times.preset_bounds("today", as_of)
    return (end >= F.lit(as_of)) | (end.isNull() & (start >= F.lit(midnight)))


def ingest_window(start: Column, end: Column, as_of: datetime, grace_hours: int = 6, horizon_days: int = 365) -> Column:
    return (F.coalesce(end, start) >= F.lit(as_of) - F.expr(f"INTERVAL {grace_hours} HOURS")) & (start <= F.lit(as_of) + F.expr(f"INTERVAL {horizon_days} DAYS"))


def needs_review(flag: Column, reviewed_at: Column, status: Column) -> Column:
    return (F.coalesce(flag, F.lit(False)) & reviewed_at.isNull()) | (status == "pending")


def review_reason(flag: Column, reviewed_at: Column, status: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)) & reviewed_at.isNull(), "cat").when(status == "pending", "pend")


def banner_eligible(width: Column, height: Column, size: Column) -> Column:
    """Wide enough, and either of unknown size or with enough bytes a pixel."""
    density = size / F.nullif(width * height, F.lit(0))
    return (width >= 600) & (width >= height) & (size.isNull() | (density >= 0.02))


def missing(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def violation(title: Column, source: Column, start: Column, end: Column, as_of: datetime) -> Column:
    """The first broken rule of the event contract, or null."""
    now = F.lit(as_of)
    return (
        F.when(title.isNull() | (F.trim(title) == ""), "missing or blank title")
        .when(F.length(title) > 500, "title exceeds 500 chars")
        .when(source.isNull() | (F.trim(source) == ""), "missing source key")
        .when(start.isNull(), "missing start_at")
        .when(start < now - F.expr("INTERVAL 2 YEARS"), "start_at implausibly old")
        .when(start > now + F.expr("INTERVAL 3 YEARS"), "start_at implausibly far out")
        .when(end < start, "end_at precedes start_at")
    )


def advisories(source_id: Column, start: Column, end: Column) -> Column:
    """Array of storable but suspicious traits."""
    midnight = (F.hour(times.local(start)) == 0) & (F.minute(start) == 0) & (F.second(start) == 0) & end.isNull()
    return F.array_compact(F.array(F.when(source_id.isNull() | (source_id == ""), "no source_id"), F.when(midnight, "midnight start without end")))


def matching(events: DataFrame, bridge: DataFrame, spec: QuerySpec) -> DataFrame:
    """The events that a specification selects, unsorted; ``bridge`` is (event_id, category)."""
    s = spec.effective()
    keep = (F.col("status") == "published") & (F.col("start_at") >= F.lit(s.as_of))
    if s.since:
        keep = keep & (F.col("start_at") >= F.lit(s.since))
    if s.until:
        keep = keep & (F.col("start_at") <= F.lit(s.until))
    if s.price:
        keep = keep & prices.bucket(F.col("price_min"), F.col("price_max"), s.price)
    if s.daypart:
        keep = keep & (times.time_of_day(F.col("start_at")) == s.daypart)
    if s.tag:
        keep = keep & F.array_contains("tags", s.tag)
    if s.venue_ids:
        keep = keep & F.col("venue_id").isin(*s.venue_ids)
    if s.not_sources:
        keep = keep & excluded_sources(F.col("source"), s.not_sources)
    if s.search:  # a search sees hidden rows as well
        keep = keep & text.has_word(text.search_key(F.col("title")), s.search.lower())
    else:
        keep = keep & visible(F.col("tags"), s.hidden_tags, s.umbrella_tag)
    out = events.filter(keep)
    if s.include:
        wanted = bridge.filter(F.col("category").isin(*s.include)).select(F.col("event_id").alias("c_id"))
        out = out.join(wanted, F.col("id") == F.col("c_id"), "left_semi")
    if s.exclude:
        unwanted = bridge.filter(F.col("category").isin(*s.exclude)).select(F.col("event_id").alias("x_id"))
        out = out.join(unwanted, F.col("id") == F.col("x_id"), "left_anti")
    return out


def ordering(sort: str, id_: str = "id") -> list[Column]:
    """soonest, latest or recent, with the id as tie-break."""
    first = {"soonest": F.asc("start_at"), "latest": F.desc("start_at"), "recent": F.desc("created_at")}[sort]
    return [first, F.asc(id_)]


def page(events: DataFrame, bridge: DataFrame, venues: DataFrame, spec: QuerySpec) -> DataFrame:
    """One page: the specification's columns, the event's sorted categories, its venue's name and the exact total.

    The page is cut before categories and names are joined, so those joins see ``limit`` events.
    """
    hits = matching(events, bridge, spec).select(*spec.columns)
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy(*ordering(spec.sort)).offset(spec.offset).limit(spec.limit)
    ids = F.broadcast(top.select(F.col("id").alias("t_id")))  # at most ``limit`` rows
    own = bridge.join(ids, F.col("event_id") == F.col("t_id")).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    named = top.join(own, F.col("id") == F.col("event_id"), "left").drop("event_id").join(venues.select(F.col("id").alias("v_id"), F.col("name").alias("venue")), F.col("venue_id") == F.col("v_id"), "left").drop("v_id")
    return named.crossJoin(total)  # one row


def after(events: DataFrame, cursor: int, n: int) -> DataFrame:
    """Keyset page: n rows after a cursor and one more, which tells whether there are others."""
    return events.filter(F.col("id") > cursor).orderBy("id").limit(n + 1)


def stitched(head: DataFrame, tail: DataFrame) -> DataFrame:
    """A cached head, then of the tail what the head has not."""
    return head.unionByName(tail.join(head.select(F.col("id").alias("h_id")), F.col("id") == F.col("h_id"), "left_anti"))


def venue_events(events: DataFrame, venue_id: int, as_of: datetime, grace_hours: int = 3) -> DataFrame:
    return events.filter((F.col("venue_id") == venue_id) & (F.col("status") == "published") & (F.col("start_at") > F.lit(as_of) - F.expr(f"INTERVAL {grace_hours} HOURS")))


def related(events: DataFrame, bridge: DataFrame, event_id: int, as_of: datetime, k: int = 6, grace_hours: int = 3) -> DataFrame:
    """The k next events that share a category with one, itself left out."""
    own = bridge.filter(F.col("event_id") == event_id).select(F.col("category").alias("o_category"))
    ids = bridge.join(own, F.col("category") == F.col("o_category"), "left_semi").filter(F.col("event_id") != event_id).select(F.col("event_id").alias("r_id"))
    later = events.filter((F.col("status") == "published") & (F.col("start_at") > F.lit(as_of) - F.expr(f"INTERVAL {grace_hours} HOURS")))
    return later.join(ids, F.col("id") == F.col("r_id"), "left_semi").orderBy("start_at", "id").limit(k)


def embedded(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Parents with an array of their child rows, empty where there are none."""
    fields = [c for c in children.columns if c != child_key]
    packed = children.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(packed, parents[key] == packed[child_key], "left").drop(packed[child_key])
    return joined.withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))


def with_parent_only(events: DataFrame, links: DataFrame) -> DataFrame:
    """Inner embedding: only events that have a link, each once."""
    return events.join(links.select(F.col("event_id").alias("l_id")), F.col("id") == F.col("l_id"), "left_semi")


def readable_categories(bridge: DataFrame, events: DataFrame) -> DataFrame:
    """Row-level visibility: categories of published events only."""
    return bridge.join(events.filter(F.col("status") == "published").select(F.col("id").alias("p_id")), F.col("event_id") == F.col("p_id"), "left_semi")

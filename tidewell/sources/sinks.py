"""Results for readers outside: feeds, sitemaps, structured data, reports and audit files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import slug_path

AUDIT = ("id", "title", "description", "image_url", "start_at", "source", "source_id", "ticket_url", "manual_overrides")


def xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def feed_items(events: DataFrame, as_of: datetime, limit: int = 50) -> DataFrame:
    """The next events since three hours ago with a rendered item."""
    soon = events.filter((F.col("status") == "published") & (F.col("start_at") > F.lit(as_of) - F.expr("INTERVAL 3 HOURS"))).orderBy("start_at", "id").limit(limit)
    item = F.concat(F.lit("<item><title>"), xml(F.col("title")), F.lit("</title><link>"), slug_path(F.col("id"), F.col("title"), F.col("start_at")), F.lit("</link><guid>"), F.col("id").cast("string"), F.lit("</guid></item>"))
    return soon.select("id", "start_at", item.alias("item"))


def last_build(events: DataFrame) -> DataFrame:
    times = [c for c in ("updated_at", "created_at", "start_at") if c in events.columns]
    return events.agg(F.max(F.coalesce(*times)).alias("last_build"))


def sitemap(static: DataFrame, events: DataFrame, venues: DataFrame, organizations: DataFrame, as_of: datetime) -> DataFrame:
    """(path, kind) of static pages, events of the last 90 days and later, listed venues and organizations."""
    recent = events.filter((F.col("status") == "published") & (F.col("start_at") > F.lit(as_of) - F.expr("INTERVAL 90 DAYS")))
    named = lambda df, kind: df.select(F.concat(F.lit(f"/{kind}s/"), F.col("id").cast("string")).alias("path"), F.lit(kind).alias("kind"))
    pages = recent.select(slug_path(F.col("id"), F.col("title"), F.col("start_at")).alias("path"), F.lit("event").alias("kind"))
    return static.select("path", F.lit("static").alias("kind")).unionByName(pages).unionByName(named(venues.filter("listed"), "venue")).unionByName(named(organizations, "organization"))


def structured(events: DataFrame) -> DataFrame:
    """schema.org text of each event (id, title, start_at, end_at, venue, price_min)."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    offer = F.when(F.col("price_min").isNotNull(), F.struct(F.lit("Offer").alias("@type"), F.col("price_min").cast("string").alias("price"), F.lit("USD").alias("priceCurrency")))
    place = F.when(F.col("venue").isNotNull(), F.struct(F.lit("Place").alias("@type"), F.col("venue").alias("name")))
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), iso("start_at").alias("startDate"), iso("end_at").alias("endDate"), place.alias("location"), offer.alias("offers"))
    return events.select("id", F.to_json(body).alias("json"))


def breadcrumbs(paths: DataFrame) -> DataFrame:
    """schema.org breadcrumbs of (id, trail: array of names)."""
    items = F.transform("trail", lambda n, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), n.alias("name")))
    return paths.select("id", F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))).alias("json"))


def audit(rows: DataFrame, path: str) -> None:
    """The pinned fields of rows that are about to be deleted, written before they are."""
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in AUDIT)).write.mode("errorifexists").json(path)


def health_lines(found: DataFrame) -> DataFrame:
    """Issues as lines of JSON and of Markdown."""
    bad = found.filter(F.col("issue").isNotNull())
    return bad.select("scraper", F.to_json(F.struct("scraper", "issue", "last_found", "baseline")).alias("json"), F.concat(F.lit("- **"), F.col("scraper").cast("string"), F.lit("**: "), F.col("issue")).alias("markdown"))


def swap(frame: DataFrame, path: str) -> None:
    """Writes a table under a new name beside ``path`` and renames it in place, so readers see the old table or the new one.

    Where an earlier swap broke off between its renames, ``recover`` first puts the old table back.
    """
    spark = frame.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    fresh, old = f"{path}.new", f"{path}.old"
    frame.write.mode("overwrite").parquet(fresh)
    store = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(jvm.Path(path)):
        store.delete(jvm.Path(old), True)
        if not store.rename(jvm.Path(path), jvm.Path(old)):
            raise OSError(f"cannot set {path} aside")
    if not store.rename(jvm.Path(fresh), jvm.Path(path)):
        raise OSError(f"cannot put {path} in place")
    store.delete(jvm.Path(old), True)


def recover(spark: SparkSession, path: str) -> bool:
    """Whether the table is there, after putting back what a broken swap set aside."""
    jvm = spark._jvm.org.apache.hadoop.fs
    store = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(jvm.Path(path)) and store.exists(jvm.Path(f"{path}.old")):
        store.rename(jvm.Path(f"{path}.old"), jvm.Path(path))
    return store.exists(jvm.Path(path))

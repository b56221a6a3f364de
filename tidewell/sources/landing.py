"""Landing of parsed rows: the contract check, quarantine, counters, run log and source manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import classify, moderation, text
from tidewell.operators.browse import violation


@dataclass(frozen=True)
class Source:
    """An entry of the manifest; hooks build columns from a feed's own ones."""

    key: str
    label: str
    group: str
    parse: Callable[[DataFrame], DataFrame] | None = None
    active: bool = True
    default_category: str | None = None
    tags: Callable[[DataFrame], Column] | None = None
    category: Callable[[DataFrame], Column] | None = None
    review: Callable[[DataFrame], Column] | None = None


def manifest(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The manifest as a table; it has some hundred rows and is broadcast in joins."""
    rows = [(s.key, s.label, s.group, s.active, s.default_category) for s in sources]
    return spark.createDataFrame(rows, "source string, label string, grp string, active boolean, default_category string")


def planned(sources: list[Source], group: str | None = None, keys: tuple[str, ...] = ()) -> list[Source]:
    return [s for s in sources if s.active and (group is None or s.group == group) and (not keys or s.key in keys)]


def checked(rows: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the contract, and the others with the rule that they break."""
    judged = rows.withColumn("violation", violation(F.col("title"), F.col("source"), F.col("start_at"), F.col("end_at"), as_of))
    return judged.filter(F.col("violation").isNull()).drop("violation"), judged.filter(F.col("violation").isNotNull())


def enriched(rows: DataFrame, terms: tuple[tuple[str, str], ...] = (), default_category: str | None = None) -> DataFrame:
    """Rows with cleaned text, categories, facets and a moderation status."""
    clean = rows.withColumns({"title": text.clean_title(F.col("title")), "description": text.clean_description(F.col("description")), "tags": text.clean_tags(F.col("tags"))})
    inferred = classify.ranked(classify.scores(F.col("title"), F.col("description")))
    categories = classify.resolve(F.array().cast("array<string>"), F.col("category"), inferred, F.lit(default_category).cast("string"))
    screened = moderation.screen([F.col("title"), F.col("description"), F.array_join("tags", " ")], terms)
    facets = classify.facets(F.col("title"), F.col("description"))
    return clean.withColumns({"categories": categories, "is_family": facets["family"], "is_fundraiser": facets["fundraiser"], "status": F.coalesce(screened["status"], F.lit("published"))})


def hooked(rows: DataFrame, source: Source) -> DataFrame:
    """Rows with a source's own mapping of tags, category and review applied."""
    changes: dict[str, Column] = {}
    if source.tags:
        changes["tags"] = source.tags(rows)
    if source.category:
        changes["category"] = source.category(rows)
    if source.review:
        changes["needs_review"] = F.coalesce(source.review(rows), F.lit(False))
    return rows.withColumns(changes) if changes else rows


def ingest(raw: dict[str, DataFrame], sources: list[Source], as_of: datetime, **options) -> tuple[DataFrame, DataFrame]:
    """Good and quarantined rows of all sources that have raw data: the adapters' plans, in one union."""
    made = [hooked(s.parse(raw[s.key]), s) for s in planned(sources) if s.parse and s.key in raw]
    if not made:
        raise ValueError("no source has data")
    every = made[0]
    for other in made[1:]:
        every = every.unionByName(other, allowMissingColumns=True)
    good, bad = checked(every, as_of)
    return enriched(good, **options), bad


def run_rows(good: DataFrame, bad: DataFrame, known: DataFrame, at: datetime) -> DataFrame:
    """One log row a source: rows found, inserted, updated and skipped as observed, never as claimed."""
    old = known.select("source", "source_id").withColumn("known", F.lit(True)).distinct()
    seen = good.join(old, ["source", "source_id"], "left")
    kept = seen.groupBy("source").agg(F.count("*").alias("kept"), F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if(F.col("known")).alias("updated"))
    lost = bad.groupBy("source").agg(F.count("*").alias("skipped"))
    both = kept.join(lost, "source", "full_outer").na.fill(0)
    return both.select("source", F.lit(at).alias("ran_at"), (F.col("kept") + F.col("skipped")).alias("found"), "inserted", "updated", "skipped")

"""Health of sources: views over the run log (scraper, ran_at, status, found)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.times import iso_week

STALE_HOURS, REPORT_STALE_HOURS = 26, 36
BASELINE_MIN, BASELINE_MIN_RUNS, DROP = 5, 4, 0.4


def _newest(key: str = "scraper") -> Window:
    return Window.partitionBy(key).orderBy(F.desc("ran_at"), F.desc("run_id"))


def latest(runs: DataFrame) -> DataFrame:
    """Each scraper's last run, by one aggregation with map-side combine instead of a sort."""
    last = F.max_by(F.struct("status", "found"), F.struct("ran_at", "run_id"))
    return runs.groupBy("scraper").agg(F.max("ran_at").alias("last_ran_at"), last.alias("last")).select("scraper", "last_ran_at", F.col("last.status").alias("last_status"), F.col("last.found").alias("last_found"))


def zero_streak(runs: DataFrame) -> DataFrame:
    """Runs without events since the last run that had some; one shuffle on the scraper."""
    last_hit = F.max(F.when(F.col("found") > 0, F.col("ran_at"))).over(Window.partitionBy("scraper"))
    after = (F.col("found") == 0) & (F.col("hit").isNull() | (F.col("ran_at") > F.col("hit")))
    return runs.withColumn("hit", last_hit).groupBy("scraper").agg(F.count_if(after).alias("zeros"))


def recent_average(runs: DataFrame, n: int = 5) -> DataFrame:
    """Mean of the last n runs; ``runs_seen`` counts those, ``total_runs`` all."""
    ranked = runs.withColumn("rn", F.row_number().over(_newest()))
    few = F.col("rn") <= n
    return ranked.groupBy("scraper").agg(F.round(F.avg(F.when(few, F.col("found")))).cast("long").alias("average"), F.count_if(few).alias("runs_seen"), F.count("*").alias("total_runs"))


def health(runs: DataFrame, as_of: datetime) -> DataFrame:
    """One row a scraper with its alert; all parts come from one scan and one shuffle on the scraper."""
    w = Window.partitionBy("scraper")
    marked = runs.filter(F.col("ran_at") <= F.lit(as_of)).withColumn("rn", F.row_number().over(_newest())).withColumn("hit", F.max(F.when(F.col("found") > 0, F.col("ran_at"))).over(w))
    zero = (F.col("found") == 0) & (F.col("hit").isNull() | (F.col("ran_at") > F.col("hit")))
    few, first = F.col("rn") <= 5, F.col("rn") == 1
    rows = marked.groupBy("scraper").agg(
        F.max("ran_at").alias("last_ran_at"),
        F.max(F.when(first, F.col("status"))).alias("last_status"),
        F.max(F.when(first, F.col("found"))).alias("last_found"),
        F.count_if(zero).alias("zeros"),
        F.round(F.avg(F.when(few, F.col("found")))).cast("long").alias("average"),
        F.count_if(few).alias("runs_seen"),
    )
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_ran_at")) / 3.6e9
    alert = F.when(F.col("last_status") == "error", "error").when(hours > STALE_HOURS, "stale").when(F.col("zeros") >= 2, "zero_events")
    return rows.withColumn("hours", F.round(hours, 1)).withColumn("alert", alert)


def by_urgency(rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("alert") == "error", 0).when(F.col("alert") == "stale", 1).when(F.col("alert") == "zero_events", 2).otherwise(3)
    return rows.orderBy(rank, "scraper")


def baselines(runs: DataFrame) -> DataFrame:
    """Median of earlier runs with events, and how many earlier runs there are; the latest run is no history."""
    ranked = runs.withColumn("rn", F.row_number().over(_newest()))
    past = F.col("rn") > 1
    return ranked.groupBy("scraper").agg(F.median(F.when(past & (F.col("found") > 0), F.col("found"))).alias("baseline"), F.count_if(past & (F.col("found") > 0)).alias("history"))


def anomalies(sources: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """The first trouble of each active source (scraper), or null."""
    joined = sources.join(latest(runs), "scraper", "left").join(baselines(runs), "scraper", "left")
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_ran_at")) / 3.6e9
    drop = (F.col("baseline") >= BASELINE_MIN) & (F.col("history") >= BASELINE_MIN_RUNS) & (F.col("last_found") < F.col("baseline") * DROP)
    issue = (
        F.when(F.col("last_ran_at").isNull(), "did_not_run")
        .when(hours > REPORT_STALE_HOURS, "stale")
        .when(F.col("last_status") == "error", "error")
        .when(F.col("last_found") == 0, "zero_events")
        .when(drop, "volume_drop")
    )
    return joined.withColumn("issue", issue)


def issue_counts(found: DataFrame) -> DataFrame:
    return found.filter(F.col("issue").isNotNull()).groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("scraper").alias("sources"))


def run_summary(planned: DataFrame, runs: DataFrame, started: datetime) -> DataFrame:
    """Each planned source with its latest run's counts if that was logged since the start."""
    last = latest(runs).filter(F.col("last_ran_at") >= F.lit(started))
    return planned.join(last, "scraper", "left").withColumn("logged", F.col("last_ran_at").isNotNull())


def failed(failures: int, planned: int, share: float = 0.2, dedupe_failed: bool = False) -> bool:
    """Whether a whole ingest run counts as failed."""
    return dedupe_failed or failures > int(planned * share)


def last_day(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Events found and last status of each scraper within 24 hours."""
    recent = runs.filter((F.col("ran_at") > F.lit(as_of) - F.expr("INTERVAL 24 HOURS")) & (F.col("ran_at") <= F.lit(as_of)))
    return recent.groupBy("scraper").agg(F.sum("found").alias("found"), F.max_by("status", F.struct("ran_at", "run_id")).alias("status"))


def sustained_hosts(views: DataFrame, least_views: int, least_weeks: int, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Hosts (host, day, views) with enough views in enough ISO weeks."""
    kept = views.filter(F.col("host").isNotNull() & ~F.col("host").isin(*ignored)) if ignored else views.filter(F.col("host").isNotNull())
    weeks = F.count_distinct(F.when(F.col("views") > 0, iso_week(F.col("day"))))
    return kept.groupBy("host").agg(F.sum("views").alias("views"), weeks.alias("weeks")).filter((F.col("views") >= least_views) & (F.col("weeks") >= least_weeks))


def counters(events: DataFrame, **tests: Column) -> DataFrame:
    """One row with a count for each named predicate, in one pass."""
    return events.agg(*(F.count_if(test).alias(name) for name, test in tests.items()))


def report(facts: DataFrame, dimensions: list[str], metrics: dict[str, Column], where: Column | None = None, top: str | None = None, limit: int | None = None) -> DataFrame:
    """A metrics report: dimensions, metrics, filter, order by one metric and limit."""
    rows = (facts if where is None else facts.filter(where)).groupBy(*dimensions).agg(*(c.alias(n) for n, c in metrics.items()))
    if top:
        rows = rows.orderBy(F.desc(top), *dimensions)
    return rows.limit(limit) if limit else rows


def clicks_pivot(clicks: DataFrame, kinds: list[str]) -> DataFrame:
    """Clicks of a page by kind of link; the kinds are given, so no extra pass finds them."""
    return clicks.groupBy("page").pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0)


def batches(sends: DataFrame) -> DataFrame:
    """Sends (day, session, status, sent_at) by day and session."""
    return sends.groupBy("day", "session").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("sent_at").alias("last_sent"))


def frequency_counts(subscribers: DataFrame) -> DataFrame:
    f, active = F.col("frequency"), F.coalesce(F.col("active"), F.lit(False))
    return counters(subscribers, total=F.lit(True), active=active, daily=active & (f == "daily"), weekly=active & (f == "weekly"), monthly=active & (f == "monthly"), inactive=~active)


def attribution_violations(links: DataFrame, self_names: DataFrame) -> DataFrame:
    """Links (source, organization key) in which an aggregator credits itself, counted by source."""
    return links.join(self_names, ["source", "org_key"], "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def festival_findings(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Broken rules of registered festivals (tag, day): one umbrella each, on the day, and children on the day."""
    e = events.select("id", F.explode("tags").alias("tag"), F.array_contains("tags", "umbrella").alias("is_umbrella"), F.to_date(F.from_utc_timestamp("start_at", "America/New_York")).alias("on"))
    counted = registry.join(e, "tag", "left").groupBy("tag", "day").agg(
        F.count_if("is_umbrella").alias("umbrellas"),
        F.count_if(F.col("is_umbrella") & (F.col("on") != F.col("day"))).alias("umbrella_off_day"),
        F.count_if(~F.col("is_umbrella") & (F.col("on") != F.col("day"))).alias("children_off_day"),
        F.count_if(~F.col("is_umbrella")).alias("children"),
    )
    findings = F.array_compact(
        F.array(
            F.when(F.col("umbrellas") != 1, "umbrella count"),
            F.when(F.col("umbrella_off_day") > 0, "umbrella off day"),
            F.when(F.col("children_off_day") > 0, "child off day"),
            F.when(F.col("children") == 0, "no children"),
        )
    )
    return counted.select("tag", F.explode(findings).alias("finding"))

"""Browsing, filters, pages and embedding."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.catalog import AS_OF, BRIDGE_SQL, EVENTS_SQL, VENUES_SQL
from tidewell.functions import prices, text, times
from tidewell.operators import browse
from tidewell.operators.browse import QuerySpec
from tidewell.operators.ordering import numbered
from tidewell.queries.base import NOW, Registry, eastern, sql_stamp, stamp

query = Registry()
HIDDEN = ("fest-a", "fest-b")
SHOWN_SQL = "(umbrella OR NOT (fest_a OR fest_b))"


def _page(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    spec = QuerySpec(AS_OF, **({"limit": 48} | options))
    out = browse.page(catalog.events(spark, sf_dir), catalog.event_categories(spark, sf_dir), catalog.venues(spark, sf_dir), spec)
    return out.select("id", "title", stamp("start_at").alias("start_at"), "category", "categories", "price_min", "price_max", "venue", "total")


def _page_sql(where: str, limit: int = 48, offset: int = 0, order: str = "start_at, id") -> str:
    return f"""WITH {EVENTS_SQL}, {BRIDGE_SQL}, {VENUES_SQL},
    hit AS (SELECT * FROM ev WHERE start_at >= {NOW} AND {where}),
    top AS (SELECT * FROM hit ORDER BY {order} LIMIT {limit} OFFSET {offset})
    SELECT t.id, t.title, {sql_stamp("t.start_at")} AS start_at, t.category, (SELECT string_agg(category, ',' ORDER BY category) FROM ec WHERE ec.event_id = t.id) AS categories,
      t.price_min, t.price_max, v.name AS venue, (SELECT count(*) FROM hit) AS total
    FROM top t LEFT JOIN ve v ON v.id = t.venue_id"""


@query(_page_sql(SHOWN_SQL))
def browse_soonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, hidden_tags=HIDDEN)


@query(_page_sql(f"{SHOWN_SQL} AND id NOT IN (SELECT event_id FROM ec WHERE category IN ('error', 'click'))"))
def browse_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, hidden_tags=HIDDEN, exclude=("error", "click"))


@query(_page_sql("id IN (SELECT event_id FROM ec WHERE category = 'view') AND price_min = 0 AND (price_max IS NULL OR price_max = 0)"))
def browse_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, include=("view",), exclude=("view",), free=True, price="under10")


@query(_page_sql("regexp_matches(lower(title), '(^|[^a-z0-9_])club([^a-z0-9_]|$)')", 24, 24, "start_at DESC, id"))
def browse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, hidden_tags=HIDDEN, search="club", sort="latest", offset=24, limit=24)


@query(_page_sql("price_min <= 25 AND start_at >= TIMESTAMP '2024-01-19 21:00:00' AND start_at <= TIMESTAMP '2024-01-22 04:59:59.999'"))
def browse_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, window="this_weekend", price="under25")


@query(_page_sql(f"extract(hour FROM {eastern('start_at')}) BETWEEN 17 AND 23 AND source NOT IN ('src0', 'src1') AND fest_a"))
def browse_evening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, daypart="evening", not_sources=("src0", "src1"), tag="fest-a")


@query(_page_sql("id IN (SELECT event_id FROM ec WHERE category IN ('signup', 'purchase')) AND venue_id IN (1, 2, 3)"))
def browse_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, include=("view",), intents=("eat",), locked=("signup", "purchase"), venue_ids=(1, 2, 3))


@query(f"WITH {EVENTS_SQL} SELECT id, title FROM ev WHERE id > 1000 ORDER BY id LIMIT 26")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.after(catalog.events(spark, sf_dir), 1000, 25).select("id", "title")


@query(f"WITH {EVENTS_SQL} SELECT id, category FROM ev")
def head_tail_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir).select("id", "category")
    return browse.stitched(e.filter("category IN ('view', 'click', 'error')"), e.filter("category IN ('error', 'signup', 'purchase')"))


@query(f"""WITH {EVENTS_SQL}, {BRIDGE_SQL} SELECT id, {sql_stamp("start_at")} AS start_at FROM ev
  WHERE id <> 42 AND start_at > {NOW} - INTERVAL 3 HOUR AND id IN (SELECT event_id FROM ec WHERE category IN (SELECT category FROM ec WHERE event_id = 42)) ORDER BY ev.start_at, id LIMIT 6""")
def related_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.related(catalog.events(spark, sf_dir), catalog.event_categories(spark, sf_dir), 42, AS_OF).select("id", stamp("start_at").alias("start_at"))


@query(f"WITH {EVENTS_SQL} SELECT id, {sql_stamp('start_at')} AS start_at FROM ev WHERE venue_id = 3 AND start_at > {NOW} - INTERVAL 3 HOUR")
def venue_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.venue_events(catalog.events(spark, sf_dir), 3, AS_OF).select("id", stamp("start_at").alias("start_at"))


@query(f"WITH {VENUES_SQL}, {EVENTS_SQL} SELECT v.id, count(e.id) AS n, coalesce(string_agg(e.category, ',' ORDER BY e.category, e.id), '') AS categories FROM ve v LEFT JOIN ev e ON e.venue_id = v.id AND e.featured GROUP BY v.id")
def venue_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = catalog.events(spark, sf_dir).filter("featured").select("venue_id", "category", "id")
    out = browse.embedded(catalog.venues(spark, sf_dir).select("id"), children, "id", "venue_id", "events")
    return out.select("id", F.size("events").cast("long").alias("n"), F.array_join(F.transform("events", lambda e: e["category"]), ",").alias("categories"))


@query(f"WITH {VENUES_SQL}, {EVENTS_SQL} SELECT id FROM ve WHERE id IN (SELECT venue_id FROM ev)")
def inner_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = catalog.events(spark, sf_dir).select(F.col("venue_id").alias("event_id"))
    return browse.with_parent_only(catalog.venues(spark, sf_dir).select("id"), links)


@query(f"WITH {EVENTS_SQL}, {BRIDGE_SQL} SELECT category, count(*) AS n FROM ec WHERE event_id IN (SELECT id FROM ev WHERE status = 'published') GROUP BY category")
def readable_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.readable_categories(catalog.event_categories(spark, sf_dir), catalog.events(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL} SELECT count(*) FILTER (price_min IS NULL OR NOT (price_min = 0 AND (price_max IS NULL OR price_max = 0))) AS not_free, count(*) FILTER (fest_a) AS in_a, count(*) FILTER (NOT fest_a) AS not_a,
  count(*) FILTER (fest_a OR fest_b) AS overlap, count(*) FILTER ({SHOWN_SQL}) AS shown, count(*) FILTER (title ILIKE '%series%') AS has_text, count(*) FILTER (image_url IS NULL OR price_min IS NULL) AS missing FROM ev""")
def predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.health import counters

    free = (F.col("price_min") == 0) & (F.col("price_max").isNull() | (F.col("price_max") == 0))
    both = F.array(F.lit("fest-a"), F.lit("fest-b"))
    return counters(
        catalog.events(spark, sf_dir), not_free=browse.not_true(free), in_a=F.array_contains("tags", "fest-a"), not_a=~F.array_contains("tags", "fest-a"), overlap=F.arrays_overlap(F.col("tags"), both), shown=browse.visible(F.col("tags"), HIDDEN, "umbrella"),
        has_text=text.has_text(F.col("title"), "SERIES"), missing=browse.missing(F.col("image_url"), F.col("price_min")),
    )


@query(f"""WITH {EVENTS_SQL} SELECT count(*) FILTER (price_min = 0 AND (price_max IS NULL OR price_max = 0)) AS free, count(*) FILTER (price_min <= 10) AS under10, count(*) FILTER (price_min <= 25) AS under25 FROM ev""")
def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.events(spark, sf_dir).agg(*(F.count_if(prices.bucket(F.col("price_min"), F.col("price_max"), b)).alias(b) for b in ("free", "under10", "under25")))


@query(f"""WITH {EVENTS_SQL} SELECT count(*) FILTER (end_at >= {NOW} OR (end_at IS NULL AND start_at >= TIMESTAMP '2024-01-15 05:00:00')) AS open,
  count(*) FILTER (coalesce(end_at, start_at) >= {NOW} - INTERVAL 6 HOUR AND start_at <= {NOW} + INTERVAL 10 DAY) AS in_window FROM ev""")
def not_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("start_at"), F.col("end_at")
    return catalog.events(spark, sf_dir).agg(F.count_if(browse.not_ended(s, e, AS_OF)).alias("open"), F.count_if(browse.ingest_window(s, e, AS_OF, 6, 10)).alias("in_window"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT CASE WHEN id % 19 = 0 THEN ' ' WHEN id % 23 = 0 THEN NULL ELSE title END AS title, CASE WHEN id % 29 = 0 THEN '' ELSE source END AS source, CASE WHEN id % 31 = 0 THEN NULL WHEN id % 37 = 0 THEN start_at - INTERVAL 4 YEAR WHEN id % 41 = 0 THEN start_at + INTERVAL 5 YEAR ELSE start_at END AS s,
    CASE WHEN id % 43 = 0 THEN start_at - INTERVAL 1 HOUR ELSE end_at END AS e FROM ev)
  SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing or blank title' WHEN source = '' THEN 'missing source key' WHEN s IS NULL THEN 'missing start_at' WHEN s < {NOW} - INTERVAL 2 YEAR THEN 'start_at implausibly old'
    WHEN s > {NOW} + INTERVAL 3 YEAR THEN 'start_at implausibly far out' WHEN e < s THEN 'end_at precedes start_at' END AS violation, count(*) AS n FROM x GROUP BY 1""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir).selectExpr(
        "CASE WHEN id % 19 = 0 THEN ' ' WHEN id % 23 = 0 THEN NULL ELSE title END AS title", "CASE WHEN id % 29 = 0 THEN '' ELSE source END AS source",
        "CASE WHEN id % 31 = 0 THEN NULL WHEN id % 37 = 0 THEN start_at - INTERVAL 4 YEARS WHEN id % 41 = 0 THEN start_at + INTERVAL 5 YEARS ELSE start_at END AS s", "CASE WHEN id % 43 = 0 THEN start_at - INTERVAL 1 HOUR ELSE end_at END AS e",
    )
    return e.groupBy(browse.violation(F.col("title"), F.col("source"), F.col("s"), F.col("e"), AS_OF).alias("violation")).agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT id % 5 = 0 AS flag, CASE WHEN id % 10 = 0 THEN start_at END AS seen, CASE WHEN id % 7 = 0 THEN 'pending' ELSE status END AS st FROM ev)
  SELECT CASE WHEN flag AND seen IS NULL THEN 'cat' WHEN st = 'pending' THEN 'pend' END AS reason, count(*) AS n FROM x WHERE (flag AND seen IS NULL) OR st = 'pending' GROUP BY 1""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.events(spark, sf_dir).selectExpr("id % 5 = 0 AS flag", "CASE WHEN id % 10 = 0 THEN start_at END AS seen", "CASE WHEN id % 7 = 0 THEN 'pending' ELSE status END AS st")
    c = (F.col("flag"), F.col("seen"), F.col("st"))
    return x.filter(browse.needs_review(*c)).groupBy(browse.review_reason(*c).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_size * 40 AS w, p_partkey % 50 * 30 AS h, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice * 10 END AS b FROM part)
  SELECT count(*) FILTER (w >= 600 AND w >= h AND (b IS NULL OR b / nullif(w * h, 0) >= 0.02)) AS eligible FROM x""")
def banner_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.table(spark, sf_dir, "part").selectExpr("p_size * 40 AS w", "p_partkey % 50 * 30 AS h", "CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice * 10 END AS b")
    return x.agg(F.count_if(browse.banner_eligible(F.col("w"), F.col("h"), F.col("b"))).alias("eligible"))


@query(f"""WITH {EVENTS_SQL} SELECT CASE WHEN h BETWEEN 5 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 23 THEN 'evening' END AS daypart, count(*) AS n FROM (SELECT extract(hour FROM {eastern('start_at')}) AS h FROM ev) GROUP BY 1""")
def time_of_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.events(spark, sf_dir).groupBy(times.time_of_day(F.col("start_at")).alias("daypart")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT strftime({eastern('start_at')}, '%Y-%m-%d') AS day, CAST(extract(hour FROM {eastern('start_at')}) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY 1, 2")
def eastern_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir)
    return e.groupBy(times.day_key(F.col("start_at")).alias("day"), times.start_hour(F.col("start_at")).cast("int").alias("hour")).agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT *, strftime({eastern('start_at')}, '%Y-%m-%d') AS day FROM ev), q AS (SELECT *, row_number() OVER (PARTITION BY day, source ORDER BY start_at, id) AS rn, count(*) OVER (PARTITION BY day, source) AS c FROM r)
  SELECT day, source, count(*) FILTER (source NOT IN ('src1', 'src2') OR rn <= 3) AS shown, max(CASE WHEN source IN ('src1', 'src2') THEN greatest(c - 3, 0) ELSE 0 END) AS hidden FROM q GROUP BY day, source""")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.windows import capped

    return capped(catalog.events(spark, sf_dir), ("src1", "src2")).groupBy("day", "source").agg(F.count_if("shown").alias("shown"), F.max("hidden_count").alias("hidden"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT id, row_number() OVER (PARTITION BY strftime({eastern('start_at')}, '%Y-%m-%d') ORDER BY featured DESC, start_at, id) AS place FROM ev) SELECT id, place FROM r WHERE place <= 5""")
def featured_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.windows import featured_first as first

    return first(catalog.events(spark, sf_dir)).filter("place <= 5").select("id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {EVENTS_SQL} SELECT 'today' AS preset, count(*) FILTER (start_at BETWEEN TIMESTAMP '2024-01-15 05:00:00' AND TIMESTAMP '2024-01-16 04:59:59.999') AS n FROM ev
  UNION ALL SELECT 'tomorrow', count(*) FILTER (start_at BETWEEN TIMESTAMP '2024-01-16 05:00:00' AND TIMESTAMP '2024-01-17 04:59:59.999') FROM ev
  UNION ALL SELECT 'this_weekend', count(*) FILTER (start_at BETWEEN TIMESTAMP '2024-01-19 21:00:00' AND TIMESTAMP '2024-01-22 04:59:59.999') FROM ev
  UNION ALL SELECT 'next_7_days', count(*) FILTER (start_at BETWEEN TIMESTAMP '2024-01-15 05:00:00' AND TIMESTAMP '2024-01-22 04:59:59.999') FROM ev
  UNION ALL SELECT 'this_week', count(*) FILTER (start_at BETWEEN TIMESTAMP '2024-01-15 05:00:00' AND TIMESTAMP '2024-01-22 04:59:59.999') FROM ev
  UNION ALL SELECT 'this_month', count(*) FILTER (start_at BETWEEN TIMESTAMP '2024-01-15 05:00:00' AND TIMESTAMP '2024-02-01 04:59:59.999') FROM ev""")
def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("today", "tomorrow", "this_weekend", "next_7_days", "this_week", "this_month")
    one = catalog.events(spark, sf_dir).agg(*(F.count_if(F.col("start_at").between(*map(F.lit, times.preset_bounds(n, AS_OF)))).alias(n) for n in names))
    return one.select(F.expr(f"stack({len(names)}, {', '.join(f''''{n}', {n}''' for n in names)}) AS (preset, n)"))


@query(f"WITH {EVENTS_SQL} SELECT id, row_number() OVER (ORDER BY start_at, id) AS ord FROM ev")
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place in the order of the greedy passes, without sorting the table in one task."""
    return numbered(catalog.events(spark, sf_dir).select("id", "start_at"), [], ["start_at", "id"]).select("id", "ord")


@query(f"WITH {EVENTS_SQL} SELECT id, title, {sql_stamp('start_at')} AS start_at FROM ev WHERE id = 77")
def single_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.events(spark, sf_dir).filter(F.col("id") == 77).select("id", "title", stamp("start_at").alias("start_at"))


@query("SELECT event_id AS id, max(ts) IS NOT NULL AS has_time, count(*) AS copies FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 2 = 0) GROUP BY event_id HAVING count(*) = 2")
def id_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.raw_events(spark, sf_dir)
    twice = e.unionByName(e.filter("event_id % 2 = 0")).groupBy(F.col("event_id").alias("id")).agg(F.max("ts").isNotNull().alias("has_time"), F.count("*").alias("copies"))
    return twice.filter("copies = 2")


def effective_spec() -> QuerySpec:
    return QuerySpec(datetime(2024, 1, 15, 12), include=("view",), exclude=("view", "click"), free=True, price="under10").effective()


QUERIES, SQL = query.queries, query.sql

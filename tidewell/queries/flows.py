"""Series with every kind of rule and edited dates, the landing's log, edits of plans, festivals asked for, public titles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.catalog import AS_OF, EVENTS_SQL
from tidewell.functions import classify, recur, signals, text
from tidewell.plans import day_plans, pages
from tidewell.queries.base import NOW, Registry, sql_stamp, stamp
from tidewell.sources import landing

query = Registry()

#: Series from each event's day by id % 4: every third day until the 30th after it, two weekdays in every other week, second Fridays and last
#: Mondays, and the day of the month.
RULES = (
    "concat('FREQ=DAILY;INTERVAL=3;UNTIL=', date_format(date_add(day, 30), 'yyyyMMdd'), 'T120000Z')",
    "'FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,TH;COUNT=5'",
    "'FREQ=MONTHLY;BYDAY=2FR,-1MO;COUNT=4'",
    "'FREQ=MONTHLY;COUNT=3'",
)
SERIES_SQL = f"""{EVENTS_SQL}, e AS (SELECT id, id % 4 AS kind, CAST(start_at AS DATE) AS day, date_trunc('month', start_at)::DATE AS month1 FROM ev),
  m AS (SELECT e.*, unnest(range(0, 12)) AS i FROM e), f AS (SELECT *, (month1 + to_months(i::INTEGER))::DATE AS m1 FROM m WHERE kind >= 2),
  monthly AS (SELECT id, kind, day, i * 2 AS turn, m1 + CAST((5 - isodow(m1) + 7) % 7 + 7 AS INTEGER) AS on_day FROM f WHERE kind = 2
    UNION ALL SELECT id, kind, day, i * 2 + 1, last_day(m1) - CAST((isodow(last_day(m1)) - 1) % 7 AS INTEGER) FROM f WHERE kind = 2
    UNION ALL SELECT id, kind, day, i, m1 + CAST(day(day) - 1 AS INTEGER) FROM f WHERE kind = 3 AND day(day) <= day(last_day(m1))),
  daily AS (SELECT id, kind, day, i AS turn, day + CAST(i AS INTEGER) AS on_day FROM (SELECT *, unnest(range(0, 70)) AS i FROM e WHERE kind < 2)
    WHERE CASE kind WHEN 0 THEN i % 3 = 0 AND i <= 30 ELSE isodow(day + CAST(i AS INTEGER)) IN (2, 4) AND (isodow(day) - 1 + i) // 7 % 2 = 0 END),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS n FROM (SELECT * FROM monthly UNION ALL SELECT * FROM daily)),
  series AS (SELECT id, kind, day, on_day, CAST(on_day AS TIMESTAMP) + INTERVAL 12 HOUR AS start_at FROM numbered WHERE n <= CASE kind WHEN 0 THEN 99 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END),
  shown AS (SELECT * FROM series WHERE start_at BETWEEN {NOW} AND {NOW} + to_days({recur.WINDOW_DAYS}))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir).select("id", F.to_date("start_at").alias("day"), "title")
    rule = F.expr("CASE id % 4 " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(RULES)) + " END")
    return e.select(
        F.col("id").cast("string").alias("uid"), F.col("title").alias("summary"), F.concat(F.date_format("day", "yyyyMMdd"), F.lit("T120000Z")).alias("dtstart"), F.lit(None).cast("string").alias("tzid"),
        rule.alias("rrule"), F.array().cast("array<string>").alias("exdates"), F.lit(90).alias("minutes"), "id", "day",
    )


@query(f"WITH {SERIES_SQL} SELECT CAST(id AS VARCHAR) || '_' || strftime(on_day, '%Y%m%d') AS uid, {sql_stamp('start_at')} AS start_at FROM shown")
def recurrence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recur.expand(series(spark, sf_dir), AS_OF).select("uid", stamp("start_at").alias("start_at"))


@query(f"""WITH {SERIES_SQL}, o AS (SELECT id, day + 6 AS named, CAST(day + 6 AS TIMESTAMP) + INTERVAL 20 HOUR AS start_at FROM e WHERE id % 8 IN (0, 3))
  SELECT CAST(id AS VARCHAR) || '_' || strftime(on_day, '%Y%m%d') AS uid, 'as planned' AS kind, {sql_stamp('start_at')} AS start_at FROM shown s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = s.id AND o.named = s.on_day)
  UNION ALL SELECT CAST(id AS VARCHAR) || '_' || strftime(named, '%Y%m%d'), 'moved again', {sql_stamp('start_at')} FROM o""")
def recurrence_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series, where some have an edited date six days on, edited twice; not all of these replace anything."""
    entries = series(spark, sf_dir)
    named = F.date_format(F.date_add("day", 6), "yyyyMMdd")
    edited = entries.filter("id % 8 IN (0, 3)").select("uid", F.concat(named, F.lit("T120000Z")).alias("recurrence_id"), "tzid", F.explode(F.array(F.struct(F.lit(2).alias("ord"), F.lit("moved again").alias("summary"), F.lit("T200000Z").alias("at")), F.struct(F.lit(1).alias("ord"), F.lit("moved").alias("summary"), F.lit("T080000Z").alias("at")))).alias("x"), named.alias("named"), "minutes")
    overrides = edited.select("uid", "recurrence_id", "tzid", "x.ord", "x.summary", F.concat("named", "x.at").alias("dtstart"), "minutes")
    made = recur.with_overrides(recur.expand(entries.withColumn("summary", F.lit("as planned")), AS_OF), overrides)
    return made.select("uid", F.col("summary").alias("kind"), stamp("start_at").alias("start_at"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT *, (id % 19 = 0 OR id % 43 = 0 AND end_at IS NOT NULL) AS bad FROM ev)
  SELECT source, count(*) AS found, count(*) FILTER (NOT bad AND id % 3 <> 0) AS inserted, count(*) FILTER (NOT bad AND id % 3 = 0) AS updated, count(*) FILTER (bad) AS skipped FROM x GROUP BY source""")
def landing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of all sources landed in one run: titles that are blank and ends before starts are kept apart, every third row was known."""
    e = catalog.events(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    feed = e.withColumns({"title": F.when(F.col("id") % 19 == 0, " ").otherwise(F.col("title")), "end_at": F.when((F.col("id") % 43 == 0) & F.col("end_at").isNotNull(), F.col("start_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("end_at"))})
    sources = [landing.Source(f"src{i}", f"Source {i}", "nightly", parse=lambda rows: rows, review=lambda rows: F.col("price_min").isNull()) for i in range(8)]
    good, bad = landing.ingest({s.key: feed.filter(F.col("source") == s.key) for s in sources}, sources, AS_OF)
    known = e.filter("id % 3 = 0").select("source", "source_id")
    return landing.run_rows(good, bad, known, AS_OF).drop("ran_at")


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS plan_id, l_partkey AS event_id FROM lineitem), o AS (SELECT o_orderkey AS plan_id FROM orders WHERE o_orderkey % 2 = 0),
  a AS (SELECT plan_id, -1 AS event_id FROM o), k AS (SELECT plan_id, event_id, event_id % 5 = 0 AS removed FROM i UNION ALL SELECT plan_id, event_id, false FROM a)
  SELECT plan_id, count(*) FILTER (NOT removed) AS shown, count(*) FILTER (removed) AS removed FROM k GROUP BY plan_id""")
def plan_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every plan after some were removed, all were added once more, some removed again, and even plans got one."""
    items = catalog.plan_items(spark, sf_dir).select("plan_id", F.col("event_id").cast("long").alias("event_id")).distinct().withColumns({"removed": F.lit(False), "added_at": F.lit(AS_OF)})
    gone = items.filter("event_id % 5 = 0").select("plan_id", "event_id")
    again = items.drop("removed")
    extra = catalog.plans(spark, sf_dir).filter("plan_id % 2 = 0").select("plan_id", F.lit(-1).cast("long").alias("event_id"), F.lit(AS_OF).alias("added_at"))
    edited = day_plans.added(day_plans.removed(day_plans.added(day_plans.removed(items, gone), again), gone), extra)
    return edited.groupBy("plan_id").agg(F.count_if(~F.col("removed")).alias("shown"), F.count_if("removed").alias("removed"))


@query("""WITH r AS (SELECT c_custkey AS k, 'lantern-' || CAST(c_custkey // 3 AS VARCHAR) || '-' || CAST(2022 + c_custkey % 3 AS VARCHAR) AS slug, DATE '2024-01-15' + CAST(c_custkey % 3 * 200 - 200 + c_custkey % 7 AS INTEGER) AS day, c_custkey // 3 AS grp FROM customer),
  n AS (SELECT grp, slug, row_number() OVER (PARTITION BY grp ORDER BY day < DATE '2024-01-15', abs(day - DATE '2024-01-15'), slug) AS rn FROM r)
  SELECT o_orderkey AS ask_id, slug FROM orders JOIN n ON grp = o_custkey // 3 AND rn = 1""")
def festivals_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Festivals of several years, asked for in three spellings."""
    c = catalog.table(spark, sf_dir, "customer")
    grp = F.floor(F.col("c_custkey") / 3).cast("string")
    registry = c.select(
        F.concat(F.lit("lantern-"), grp, F.lit("-"), (F.col("c_custkey") % 3 + 2022).cast("string")).alias("slug"), F.concat(F.lit("Lantern "), grp, F.lit(" Festival")).alias("name"),
        F.date_add(F.lit(date(2024, 1, 15)), (F.col("c_custkey") % 3 * 200 - 200 + F.col("c_custkey") % 7).cast("int")).alias("day"),
    )
    spelt = F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('Lantern ', floor(o_custkey / 3), ' Festival') WHEN 1 THEN concat('lantern_', floor(o_custkey / 3)) ELSE concat('LANTERN-', floor(o_custkey / 3)) END")
    asked = catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask_id"), spelt.alias("name"))
    return pages.resolve_festivals(asked, registry, date(2024, 1, 15))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS path, url FROM pages)
  SELECT page_id, regexp_replace(path, '^/', '') AS slug, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://img.') || '?w=1200' ELSE url || '?w=80' END AS image FROM p""")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of event pages' paths with a trailing identifier, and images of one source asked for in full width."""
    p = catalog.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/events"), F.regexp_extract("url", r"^https?://[^/]*(/.*)$", 1), F.lit("/0a1b2c3d-0000-4000-8000-00000000000f/"))
    small = F.concat(F.col("url"), F.lit("?w=80"))
    image = text.rewrite_image(small, F.when(F.col("page_id") % 2 == 0, "wide").otherwise("plain"), {"wide": (r"^(https?://)(.*)\?w=80$", r"$1img.$2?w=1200")})
    return p.select("page_id", text.path_slug(path).alias("slug"), image.alias("image"))


ENTRIES = ("Council concert", "Holiday concert", "City hall closed", "Pool closed for the parade", "Labor Day", "Labor Day parade", "Bulb swap - cancelled", "Library closed", "Sunday worship", "Choir rehearsal", "Rummage sale", "10K & pancake breakfast", "Parish council", "", "Trick-or-treat", "Easter")


def _says(t: str, phrases: tuple[str, ...]) -> str:
    return f"regexp_matches({t}, ' (?:{'|'.join(p.replace('.', '[.]').replace('*', '[^ ]*') for raw in phrases for p in signals.expand(raw))}) ')"


@query(f"""WITH x AS (SELECT p_partkey AS id, [{', '.join(f"'{e}'" for e in ENTRIES)}][p_partkey % {len(ENTRIES)} + 1] AS head, p_name FROM part),
  t AS (SELECT id, ' ' || trim(regexp_replace(regexp_replace(replace(lower(head), '10', '#'), '[^a-z#]+', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS t, ' ' || trim(regexp_replace(regexp_replace(replace(lower(head || ' ' || p_name), '10', '#'), '[^a-z#]+', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS said FROM x)
  SELECT id, trim(t) <> '' AND NOT ({_says('t', ('cancelled', 'canceled', 'postponed'))} OR {_says('t', classify.GOVERNANCE)} OR {_says('t', classify.CLOSURES)}) AND (NOT ({_says('t', ('closed',))} OR trim(t) IN ({', '.join(f"'{h}'" for raw in classify.HOLIDAYS for h in signals.expand(raw))})) OR {_says('t', classify.TOWN_EVENTS)}) AS town,
    {_says('said', classify.FAITH_PUBLIC)} AS faith FROM t""")
def public_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of towns and of congregations that are open to the public."""
    title = F.get(F.array(*map(F.lit, ENTRIES)), (F.col("p_partkey") % len(ENTRIES)).cast("int"))
    p = catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"), "p_name")
    return p.select("id", classify.municipal_public(F.col("title")).alias("town"), classify.allowlisted(F.col("title"), F.col("p_name")).alias("faith"))


QUERIES, SQL = query.queries, query.sql

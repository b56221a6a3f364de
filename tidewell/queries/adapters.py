"""Feed adapters: pages rendered from the whole event table in each feed's form and read back, and text rules of ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.catalog import EVENTS_SQL, VENUES_SQL
from tidewell.functions import text
from tidewell.operators import joins, merge
from tidewell.queries.base import NOW, Registry, sql_stamp, stamp
from tidewell.sources import feeds

query = Registry()
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Events on a page of a feed.
PAGE = 50


def paged(events: DataFrame, item: Column, body: Column) -> DataFrame:
    """Pages of PAGE events each; ``body`` is an expression over the list ``items``."""
    return events.select(F.floor(F.col("id") / PAGE).alias("page"), item.alias("item")).groupBy("page").agg(F.collect_list("item").alias("items")).select(body.alias("body"))


def local(c: str, form: str) -> Column:
    return F.date_format(F.from_utc_timestamp(c, "America/New_York"), form)


def compared(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("source_id", "title", stamp("start_at").alias("start_at"), *extra)


@query(f"WITH {EVENTS_SQL} SELECT source_id, title, {sql_stamp('start_at')} AS start_at, {sql_stamp('end_at')} AS end_at, image_url, 'About ' || category AS description FROM ev")
def squarespace_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir)
    ms = lambda c: F.unix_millis(c)
    item = F.struct(F.col("source_id").alias("id"), F.concat(F.lit(" "), "title").alias("title"), F.concat(F.lit("<p>About <b>"), "category", F.lit("</b></p>")).alias("body"), ms("start_at").alias("startDate"), ms("end_at").alias("endDate"), F.col("image_url").alias("assetUrl"))
    pages = paged(e, item, F.to_json(F.struct(F.col("items").alias("upcoming"))))
    return compared(feeds.squarespace(pages, "s"), stamp("end_at").alias("end_at"), "image_url", "description")


@query(f"WITH {EVENTS_SQL} SELECT source_id, title, {sql_stamp('start_at')} AS start_at, CASE WHEN NOT featured THEN {sql_stamp('end_at')} END AS end_at, 'https://a.example/event-details/' || source_id AS ticket_url FROM ev WHERE category <> 'error'")
def wix_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that are still to be decided drop an event; hidden ends are left out."""
    e = catalog.events(spark, sf_dir)
    config = F.struct(F.date_format("start_at", ISO).alias("startDate"), F.date_format("end_at", ISO).alias("endDate"), (F.col("category") == "error").alias("scheduleTbd"), F.col("featured").alias("endDateHidden"))
    item = F.struct(F.col("source_id").alias("id"), F.col("source_id").alias("slug"), "title", F.struct(config.alias("config")).alias("scheduling"))
    page = F.concat(F.lit('<html><script type="application/json" id="wix-warmup-data">{"x":{"events":'), F.to_json("items"), F.lit(',"n":1}}</script></html>'))
    return compared(feeds.wix(paged(e, item, page), "w", site="https://a.example"), stamp("end_at").alias("end_at"), "ticket_url")


@query(f"WITH {EVENTS_SQL} SELECT source_id, title, {sql_stamp('start_at')} AS start_at, CASE WHEN category = 'view' THEN 'all_ages' ELSE 'not_specified' END AS age_restriction, coalesce(image_url, 'https://img.example.org/square.jpg') AS image_url FROM ev")
def dice_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir)
    images = F.struct(F.col("image_url").alias("landscape"), F.lit("https://img.example.org/square.jpg").alias("square"))
    item = F.struct(F.col("source_id").alias("id"), F.col("title").alias("name"), F.date_format("start_at", ISO).alias("date"), F.when(F.col("category") == "view", "All ages").otherwise("18+").alias("age_limit"), images.alias("event_images"))
    return compared(feeds.dice(paged(e, item, F.to_json(F.struct(F.col("items").alias("data")))), "d"), "age_restriction", "image_url")


@query(f"WITH {EVENTS_SQL} SELECT source_id, title, strftime(date_trunc('minute', start_at), '%Y-%m-%d %H:%M:%S') AS start_at, CAST(venue_id + 10 AS DOUBLE) AS price_min, CAST(venue_id + 25.5 AS DOUBLE) AS price_max FROM ev")
def races_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races of two starts, of which the earlier counts, and three fees."""
    e = catalog.events(spark, sf_dir)
    fee = lambda c: F.struct(c.alias("race_fee"))
    first = F.struct(local("start_at", "M/d/yyyy H:mm").alias("start_time"), F.array(fee(F.concat(F.lit("$"), F.col("venue_id") + 10, F.lit(".00"))), fee(F.concat(F.lit("$"), F.col("venue_id") + 12))).alias("registration_periods"))
    later = F.struct(F.date_format(F.from_utc_timestamp(F.expr("start_at + INTERVAL 3 HOURS"), "America/New_York"), "M/d/yyyy H:mm").alias("start_time"), F.array(fee(F.concat(F.lit("USD "), F.col("venue_id") + 25, F.lit(".50")))).alias("registration_periods"))
    race = F.struct(F.struct(F.col("source_id").alias("race_id"), F.col("title").alias("name"), F.array(later, first).alias("events")).alias("race"))
    return compared(feeds.races(paged(e, race, F.to_json(F.struct(F.col("items").alias("races")))), "r"), "price_min", "price_max")


@query(f"""WITH {EVENTS_SQL} SELECT source_id, title, {sql_stamp('start_at')} AS start_at, CAST(5 AS DOUBLE) AS price_min, CASE WHEN venue_id > 5 THEN CAST(venue_id AS DOUBLE) END AS price_max,
  CASE category WHEN 'view' THEN 'comedy' WHEN 'click' THEN 'film' ELSE 'music' END AS category, 'https://img.example.org/wide.jpg' AS image_url FROM ev""")
def ticketing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir)
    price = lambda a, b: F.struct(F.lit(a).cast("double").alias("min"), b.cast("double").alias("max"))
    named = lambda c: F.struct(c.alias("name"))
    kind = F.struct(named(F.lit("Music")).alias("segment"), named(F.when(F.col("category") == "view", "Comedy").otherwise("Undefined")).alias("genre"), named(F.when(F.col("category") == "click", "Film").otherwise("Other")).alias("subGenre"))
    image = lambda u, w: F.struct(F.lit(f"https://img.example.org/{u}.jpg").alias("url"), F.lit(w).alias("width"))
    item = F.struct(
        F.col("source_id").alias("id"), F.col("title").alias("name"), F.struct(F.struct(F.date_format("start_at", ISO).alias("dateTime")).alias("start")).alias("dates"),
        F.array(price(8, F.lit(5)), price(5, F.greatest(F.col("venue_id"), F.lit(5)))).alias("priceRanges"), F.array(kind).alias("classifications"), F.array(image("small", 100), image("wide", 2000), image("middle", 640)).alias("images"),
    )
    pages = paged(e, item, F.to_json(F.struct(F.struct(F.col("items").alias("events")).alias("_embedded"))))
    return compared(feeds.ticketing(pages, "t"), "price_min", "price_max", "category", "image_url")


@query(f"""WITH {EVENTS_SQL} SELECT source_id, title, {sql_stamp('start_at')} AS start_at, CASE WHEN featured THEN CAST(0 AS DOUBLE) ELSE CAST(venue_id + 4.5 AS DOUBLE) END AS price_min, CASE WHEN featured THEN CAST(0 AS DOUBLE) ELSE CAST(venue_id + 20 AS DOUBLE) END AS price_max FROM ev""")
def eventbrite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.events(spark, sf_dir)
    paid = lambda c: F.struct(F.lit(False).alias("free"), F.struct(c.cast("string").alias("major_value")).alias("cost"))
    free = F.struct(F.lit(True).alias("free"), F.struct(F.lit("0.00").alias("major_value")).alias("cost"))
    classes = F.array(free, paid(F.col("venue_id") + 20), paid(F.col("venue_id") + 4.5))
    item = F.struct(F.col("source_id").alias("id"), F.struct(F.col("title").alias("text")).alias("name"), F.struct(F.date_format("start_at", ISO).alias("utc")).alias("start"), F.col("featured").alias("is_free"), classes.alias("ticket_classes"))
    return compared(feeds.eventbrite(paged(e, item, F.to_json(F.struct(F.col("items").alias("events")))), "b"), "price_min", "price_max")


@query(f"WITH {EVENTS_SQL} SELECT title, strftime(date_trunc('minute', start_at), '%Y-%m-%d %H:%M:%S') AS start_at, 'fest,porch-' || CAST(venue_id AS VARCHAR) AS tags FROM ev")
def lineup_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A festival day with one slot for each event, in local clock times."""
    e = catalog.events(spark, sf_dir)
    act = F.struct("title", F.lit("Stage").alias("venue"), F.concat(F.lit("porch-"), F.col("venue_id").cast("string")).alias("column"))
    body = F.to_json(F.struct(F.lit("fest").alias("tag"), local("start_at", "yyyy-MM-dd").alias("day"), F.array(F.struct(local("start_at", "HH:mm").alias("start"), F.array(act).alias("acts"))).alias("slots")))
    return feeds.lineup(e.select(body.alias("body"))).select("title", stamp("start_at").alias("start_at"), F.array_join("tags", ",").alias("tags"))


#: What towns write as a location, around a venue's name (@) and number (%).
LOCATIONS = (
    "@ - % Main Street  Springfield OH 44000", "<p><b>@</b></p><p>Corner of Elm &amp; Oak</p>", "@ — % W. Elm Rd", "@ - North Wing - % Main Street Springfield OH 44000", "@ > Room %", "@ - First Street  Springfield OH 44000", " - % Main Street  Springfield OH 44000",
    "% Main Street", "@ from 10:30 am", "@ &amp; Annex - %B Main St &amp; 5th&nbsp;&nbsp;Springfield OH 44000", "@ - Lawn", "@, where all who want to help are asked to bring a rake, a bucket and much time", "<br/>@ - %", "@ OH 44000", "--", "",
)


def _located(c: str) -> str:
    return f"(regexp_matches({c}, '^[0-9]') OR regexp_matches({c}, '\\b[A-Za-z]{{2}}\\s+[0-9]{{5}}\\b'))"


@query(f"""WITH {VENUES_SQL}, x AS (SELECT id, replace(replace([{', '.join(f"'{x}'" for x in LOCATIONS)}][id % {len(LOCATIONS)} + 1], '@', name), '%', CAST(id AS VARCHAR)) AS raw FROM ve),
  k AS (SELECT id, list_filter(list_transform(regexp_split_to_array(raw, '(?i)</p>|<br */?>'), lambda b: trim(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '))), lambda b: b <> '')[1] AS kept FROM x),
  l AS (SELECT *, regexp_replace(kept, ' +', ' ', 'g') AS line FROM k),
  t AS (SELECT *, regexp_extract(line, ' [-—] (.*)$', 1) AS after, regexp_extract(kept, '^.* [-—] +(.*)$', 1) AS tail FROM l),
  s AS (SELECT *, CASE WHEN {_located('after')} THEN regexp_replace(line, ' [-—] .*$', '') ELSE line END AS bare, trim(regexp_replace(regexp_replace(tail, '  .*$', ''), ' +[A-Za-z][A-Za-z .]* +OH +[0-9]{{5}}.*$', '')) AS street FROM t),
  n AS (SELECT *, trim(regexp_replace(replace(bare, ' > ', ' - '), ' +OH +[0-9]{{5}}.*$', '')) AS n FROM s),
  p AS (SELECT *, regexp_matches(n, '[A-Za-z]') AND NOT regexp_matches(n, '^[-—0-9]') AND length(n) BETWEEN 3 AND 80 AND NOT regexp_matches(n, '[0-9]{{1,2}}(:[0-9]{{2}})? *[ap]m') AS place FROM n)
  SELECT id, CASE WHEN place THEN n END AS name, CASE WHEN place AND {_located('after')} AND {_located('tail')} AND regexp_matches(street, '^[0-9]+[A-Za-z]? +[^ ]') AND length(street) BETWEEN 6 AND 60 AND NOT regexp_matches(street, '[A-Za-z]{{2}} +[0-9]{{5}}') THEN street END AS address FROM p""")
def municipal_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.venues(spark, sf_dir)
    shape = F.get(F.array(*map(F.lit, LOCATIONS)), (F.col("id") % len(LOCATIONS)).cast("int"))
    at = text.municipal_location(F.replace(F.replace(shape, F.lit("@"), F.col("name")), F.lit("%"), F.col("id").cast("string")))
    return v.select("id", at["name"].alias("name"), at["address"].alias("address"))


# Text rules of ingestion --------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN length(p_name) > 25 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE upper(p_name) END AS title FROM part")
def shouted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.clean_title(F.upper("p_name")).alias("title"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, doc_id % 100) || '😀😀' || text ELSE repeat('🎻', doc_id % 60) || text END AS t FROM documents)
  SELECT doc_id, substr(t, 1, list_max(list_filter(range(0, 101), lambda k: k + length(regexp_replace(substr(t, 1, k), '[\\x{0}-\\x{FFFF}]', '', 'g')) <= 100))) AS head FROM x""")
def clamped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of at most 100 units of two bytes, with characters that take two such units, some across the end."""
    n = F.col("doc_id")
    long = F.when(n % 3 == 0, F.col("text")).when(n % 3 == 1, F.concat(F.left("text", (n % 100).cast("int")), F.lit("😀😀"), "text")).otherwise(F.concat(F.repeat(F.lit("🎻"), (n % 60).cast("int")), "text"))
    return catalog.table(spark, sf_dir, "documents").select("doc_id", text.clamp(long, 100).alias("head"))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || '/a/b?c=1' AS rooted, 'https://cdn.example/x.png' AS bare, url AS whole FROM pages")
def absolute_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = lambda s: text.absolute_url(s, F.col("url"))
    return catalog.table(spark, sf_dir, "pages").select("page_id", to(F.lit(" /a/b?c=1 ")).alias("rooted"), to(F.lit("//cdn.example/x.png")).alias("bare"), to(F.col("url")).alias("whole"))


@query("""WITH w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS t, p_type, p_size FROM part) SELECT a.id AS a, b.id AS b, round(2.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)), 6) AS similarity FROM w a JOIN w b ON a.id < b.id AND a.p_type = b.p_type AND a.p_size = b.p_size""")
def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts of a type and size; each two names of a pack are compared once."""
    p = catalog.table(spark, sf_dir, "part").filter("p_type IS NOT NULL AND p_size IS NOT NULL")
    w = p.select(F.struct("p_type", "p_size").alias("g"), F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("t"))
    both = joins.item_pairs(joins.packs(w, "t")).withColumn("similarity", F.round(text.dice(F.col("item_a.t"), F.col("item_b.t")), 6))
    return joins.smaller_first(both, "similarity")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey WHERE levenshtein(a.s_name, b.s_name) <= 1")
def one_edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of suppliers of a nation with equal names or names one edit apart, from pairs of names."""
    s = catalog.table(spark, sf_dir, "supplier").filter("s_name IS NOT NULL AND s_nationkey IS NOT NULL")
    s = s.select(F.struct("s_nationkey", "s_name").alias("g"), F.col("s_suppkey").alias("id"), "s_nationkey", "s_name")
    names = s.select("g", "s_nationkey", "s_name").distinct()
    links = joins.one_edit(names, "g", "s_name", "s_nationkey").unionByName(names.select(F.col("g").alias("a"), F.col("g").alias("b")))
    return joins.smaller_first(joins.item_pairs(joins.packs(s), links))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT DISTINCT category, title, lower(title) AS low FROM ev) SELECT a.title AS a, b.title AS b FROM t a JOIN t b ON a.category = b.category AND a.title < b.title
  WHERE b.low = a.low || ' - hall' OR a.low = b.low || ' - hall'""")
def umbrella_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog.events(spark, sf_dir).select("category", F.col("title").alias("a")).distinct()
    both = t.join(t.select("category", F.col("a").alias("b")), "category").filter("a < b")
    return both.filter(text.umbrella_pair(F.col("a"), F.col("b"))).select("a", "b")


@query(f"""WITH {EVENTS_SQL} SELECT id, title || CASE WHEN category = 'view' THEN '!' ELSE '' END AS title, {sql_stamp(f"CASE WHEN category IN ('view', 'signup') THEN {NOW} ELSE start_at END")} AS updated_at FROM ev""")
def updated_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views get another title, signups a price; what is merged with equal values keeps its stamp."""
    old = catalog.events(spark, sf_dir).select("id", "title", "price_min", "category", F.col("start_at").alias("updated_at"))
    staged = old.select("id", F.when(F.col("category") == "view", F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), F.when(F.col("category") == "signup", F.coalesce("price_min", F.lit(0)) + 1).alias("price_min"))
    new = merge.stamped(old, merge.upsert(old, staged, ["id"]), ["id"], catalog.AS_OF)
    return new.select("id", "title", stamp("updated_at").alias("updated_at"))


QUERIES, SQL = query.queries, query.sql

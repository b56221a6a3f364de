"""Text, prices, categories, moderation and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.catalog import AS_OF, EVENTS_SQL, VENUES_SQL
from tidewell.functions import classify, moderation, prices, signals, text, times
from tidewell.queries.base import NOW, Registry, sql_stamp, stamp
from tidewell.scratch import scratch
from tidewell.sources import search
from tidewell.sources import calendars, feeds, sinks

query = Registry()
TERMS = (("idiot", "contextual"), ("moron", "high"), ("worthless", "extreme"), ("the and", "contextual"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "documents").select("doc_id", text.title_key(F.col("text")).alias("key"))


@query("SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS tokens FROM part")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.title_tokens(F.concat_ws(" ", "p_name", F.lit("the 2nd annual"), "p_type", F.lit("show")))
    return catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(t, " ").alias("tokens"))


@query(f"WITH {VENUES_SQL} SELECT id, CAST(id % 40 + 100 AS VARCHAR) || ' e main st' AS key, true AS is_address, false AS junk FROM ve")
def address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("address")
    return catalog.venues(spark, sf_dir).select("id", text.address_key(a).alias("key"), text.is_address(a).alias("is_address"), text.is_junk_venue(a).alias("junk"))


@query(f"WITH {EVENTS_SQL} SELECT id, trim(regexp_replace(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9\\s-]', ' ', 'g'), '[\\s-]+', '-', 'g'), '-') || '-' || lower(strftime(start_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%b-%-d')) AS slug FROM ev")
def event_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.events(spark, sf_dir).select("id", text.slug(F.col("title"), F.col("start_at")).alias("slug"))


@query(f"""WITH {EVENTS_SQL} SELECT id, CASE WHEN price_min IS NULL AND price_max IS NULL THEN 'See tickets' WHEN price_min = 0 AND coalesce(price_max, 0) = 0 THEN 'Free' WHEN price_max > coalesce(price_min, 0) THEN '$' || CAST(coalesce(price_min, 0) AS VARCHAR) || '–$' || CAST(price_max AS VARCHAR) ELSE '$' || CAST(price_min AS VARCHAR) END AS label FROM ev""")
def price_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.events(spark, sf_dir).select("id", prices.label(F.col("price_min"), F.col("price_max")).alias("label"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS low, CASE p_partkey % 4 WHEN 1 THEN CAST(p_size + 7.5 AS DOUBLE) END AS high FROM part""")
def price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.table(spark, sf_dir, "part")
    cost = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Free entry' WHEN 1 THEN concat('$', p_size, ' to $', p_size + 7, '.50') WHEN 2 THEN 'ask us' ELSE concat('$', p_size) END")
    r = prices.from_text(cost)
    return p.select(F.col("p_partkey").alias("id"), r["price_min"].alias("low"), r["price_max"].alias("high"))


STRIP_SQL = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>|<script\\b[^>]*>.*?</script>', '', 'g')"


DECODED_SQL = f"regexp_replace({STRIP_SQL}, '<[^>]*>', ' ', 'g')"
for name, char in text.COMMON_ENTITIES.items():
    DECODED_SQL = f"replace({DECODED_SQL}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, length(trim(regexp_replace({DECODED_SQL}, '\\s+', ' ', 'g'))) AS n FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "pages").select("page_id", F.length(text.strip_html(F.col("html"), text.decode_common)).cast("long").alias("n"))


@query("SELECT c_custkey AS id, lower(c_name) AS key FROM customer")
def organization_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.organizations(spark, sf_dir).select("id", text.organization_key(F.col("name")).alias("key"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://example.org' WHEN 2 THEN NULL ELSE NULL END AS website FROM pages""")
def website_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' example.org ' WHEN 2 THEN 'not a site' ELSE 'https://nodot' END")
    return catalog.table(spark, sf_dir, "pages").select("page_id", text.website(raw).alias("website"))


@query("SELECT page_id, url AS first, CAST(2 AS BIGINT) AS n FROM pages")
def text_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.urls_in(F.concat(F.lit("See ("), F.col("url"), F.lit(") and https://a.example/x_(y), ok.")))
    return catalog.table(spark, sf_dir, "pages").select("page_id", F.get(found, F.lit(0)).alias("first"), F.size(found).cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_À-ɏ])the([^a-z0-9_À-ɏ]|$)')")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "documents").filter(text.has_word(F.lower("text"), "the")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(strip_accents(lower(text)), '(^|[^a-z0-9_])in the([^a-z0-9_]|$)')")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase looked up in an index that two batches with common rows have made."""
    path = scratch(spark, "words")
    d = catalog.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text")
    for left_out in (0, 1):
        search.index(d.filter(F.col("id") % 3 != left_out), path, count=8, spread=2, keep=1)
    return search.find(spark, path, "in the").select(F.col("id").alias("doc_id"))


#: Titles and openings that call every kind of rule; the rest of an event's text comes from the tables.
TITLES = (
    "Jazz brunch", "Trivia night", "Yoga class in the gallery", "Quarterly report", "Film festival", "Town hall concert", "Movie marathon", "Canal marathon and 10.5K", "Odile's autumn tour", "Walking tour of the mill",
    "Open mic at the mill", "Comedy show", "Otters vs. Herons", "Farmers' market", "Teen chess club", "Art camp", "Fundraising dinner", "Book swap & story time", "Learn weaving", "Drag brunch",
)
OPENINGS = (
    "Poets, plus a stand-up comedian", "We cannot admit kids or toddlers", "Supports our local youth", "Bring the kids", "Our fundraising campaign goes on", "Learn more at the desk", "A comedian will open for the band on a nature walk", "Lover of soup and stand-up comedy",
    "Ages 5 to 12 at the two-day workshop", "His three young children sing", "Volunteers needed for the coat drive", "Open mic, then comedy", "Karaoke", "After-party with a drag show", "Adults at summer camp", "Board game day", "A 3-day workshop",
)
GAP = 1_000


def _pick(names: tuple[str, ...], key: str) -> str:
    """One of some strings by a key, as SQL of both engines."""
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n.replace(chr(39), chr(39) * 2)}'" for i, n in enumerate(names)) + " END"


def _any(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(p.replace("*", "[a-zÀ-ɏ#]*") for raw in phrases for p in signals.expand(raw)) + ")"


def _plain(t: str) -> str:
    for pattern, put in (("#", " "), (r"[0-9]+(\.[0-9]+)?", "#"), ("[.!?]+", " . "), ("[^a-z#.À-ɏ]+", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{put}', 'g')"
    return f"regexp_replace(' ' || {t} || ' ', ' +', ' ', 'g')"


def _without(t: str, group: str) -> str:
    """A text without the asides of a group."""
    for run in (r for g, r in classify.ASIDES if g == group):
        between = f"(?: {_any(run.fillers)}){{0,{run.most}}} " if run.fillers else f" (?:[^.]{{0,{min(run.gap, GAP) - 2}}}? )?" if run.gap else " (?:[^.]*? )?"
        rest = "" if not run.to_end else "[^.]*" if run.to_end > GAP else f"[^.]{{0,{run.to_end}}}"
        t = f"regexp_replace({t}, ' {_any(run.opens)}{between + _any(run.closes) if run.closes else ''} {rest}', ' ', 'g')"
    return t


def _counts(s: signals.Signal) -> str:
    """Whether a signal counts in ``title``, ``text`` or ``comedy``."""
    t = s.outside or s.scope
    words = lambda names: ", ".join(f"'{n}'" for n in names)
    if s.before:
        hit = f"len(list_filter(regexp_extract_all({t}, '([^ ]*) {_any(s.phrases)} ', 1), lambda w: w NOT IN ({words(s.before)}))) > 0"
    elif s.ahead_of:
        hit = f"len(list_filter(regexp_extract_all({t}, ' {_any(s.phrases)} ([^ ]*)', 1), lambda w: w IN ({words(('', '.', *s.ahead_of))}))) > 0"
    elif s.after or s.followed:
        hit = f"len(list_filter(regexp_extract_all({t}, ' {_any(s.phrases)} ([^ ]*)', 1), lambda w: w NOT IN ({words(('', '.', *s.after))}))) > 0"
    else:
        hit = f"regexp_matches({t}, ' {_any(s.phrases)} ')"
    needs = f" AND regexp_matches({t}, ' {_any(s.needs)} ')" if s.needs else ""
    return f"({hit}{needs}" + (f" AND NOT regexp_matches(text, ' {_any(s.unless)} ')" if s.unless else "") + ")"


def _classified(rows: str) -> str:
    """Common tables that make ``read`` with the scores of rows (id, head, body) in the order of categories."""
    made = ", ".join(
        f"struct_pack(lost := -({' + '.join(f'CASE WHEN {_counts(s)} THEN {s.weight} ELSE 0 END' for s in classify.SIGNALS if s.category == c)}), at := {classify.PRIORITY.index(c)}, category := '{c}')"
        for c in dict.fromkeys(s.category for s in classify.SIGNALS)
    )
    return f"""x AS ({rows}), l AS (SELECT id, {_plain("lower(coalesce(head, ''))")} AS title, {_plain("lower(coalesce(head, '') || ' ' || coalesce(body, ''))")} AS text FROM x),
      y AS (SELECT *, {_without('text', 'comedy')} AS comedy, {_without('text', 'family')} AS family_text, {_without('title', 'family')} AS family_title FROM l),
      read AS (SELECT *, list_sort(list_filter([{made}], lambda s: s.lost < 0)) AS k FROM y)"""


RANKED = f"CASE WHEN len(k) = 0 THEN 'other' WHEN len(k) > 1 AND -k[2].lost >= {classify.SECOND_SCORE} AND -k[2].lost >= {classify.SECOND_SHARE} * -k[1].lost THEN k[1].category || ',' || k[2].category ELSE k[1].category END"


@query(f"WITH {_classified(f'SELECT p_partkey AS id, {_pick(TITLES, "p_partkey")} AS head, p_name AS body FROM part')} SELECT id, {RANKED} AS categories FROM read")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a few MB of short rows are one split or two, so the rows are dealt out before they are read
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = catalog.table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(tasks)
    p = p.select(F.col("p_partkey").alias("id"), F.expr(_pick(TITLES, "p_partkey")).alias("title"), "p_name")
    return p.select("id", F.array_join(classify.ranked(classify.scores(F.col("title"), F.col("p_name"))), ",").alias("categories"))


BODY = f"concat({_pick(OPENINGS, 'doc_id')}, '. ', text)"


@query(f"""WITH {_classified(f'SELECT doc_id AS id, {_pick(TITLES, "doc_id")} AS head, {BODY} AS body FROM documents')}
  SELECT id, {RANKED} AS categories, array_to_string(list_transform(k, lambda s: s.category || ':' || -s.lost), ',') AS scores,
    regexp_matches(family_text, ' {_any(classify.RULES.family)} ') OR regexp_matches(family_title, ' {_any(classify.RULES.family_title)} ') AS family, {' OR '.join(map(_counts, classify.RULES.fundraiser))} AS fundraiser FROM read""")
def event_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents as events: categories, all scores and facets (family before its veto, which SQL can't pair)."""
    body = F.concat(F.expr(_pick(OPENINGS, "doc_id")), F.lit(". "), F.coalesce("text", F.lit("")))
    d = catalog.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), signals.read(F.expr(_pick(TITLES, "doc_id")), body, classify.RULES).alias("r"))
    order = F.array(*map(F.lit, classify.PRIORITY))
    ranked = F.array_sort(F.transform("r.scores", lambda s: F.struct(-s["score"], F.array_position(order, s["category"]), F.concat(s["category"], F.lit(":"), s["score"]).alias("shown"))))
    return d.select("id", F.array_join(classify.ranked(F.col("r.scores")), ",").alias("categories"), F.array_join(F.transform(ranked, lambda s: s["shown"]), ",").alias("scores"), (F.col("r.family") | F.col("r.suppressed")).alias("family"), F.col("r.fundraiser").alias("fundraiser"))


def _term(t: str) -> str:
    """A term in either reading of digits; a letter also stands for three or more of it, which are one when squeezed."""
    body = "".join("[\\s._*-]*" if c == " " else f"{c}({c}{c}+)?" for c in t)
    return " OR ".join(f"regexp_matches({v}, '(^|[^a-z0-9]){body}([^a-z0-9]|$)')" for v in ("t", "l"))


def _apart(t: str) -> str:
    """A term inside letters written apart, all of which are read together."""
    return f"len(list_filter(list_transform(regexp_extract_all(l, '([a-z0-9][\\s._*-]){{2,}}[a-z0-9]'), lambda r: regexp_replace(r, '[^a-z0-9]', '', 'g')), lambda r: contains(r, '{t}'))) > 0"


@query(f"""WITH d AS (SELECT doc_id, strip_accents(lower(coalesce(text, ''))) AS t FROM documents), v AS (SELECT *, translate(t, '{moderation.LEET_FROM}', '{moderation.LEET_TO}') AS l FROM d)
  SELECT doc_id, CASE WHEN {_term('worthless')} OR {_apart('worthless')} THEN 'extreme' WHEN {_term('moron')} OR {_apart('moron')} THEN 'high' WHEN {_term('idiot')} OR {_term('the and')} THEN 'contextual' END AS severity FROM v""")
def moderation_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.table(spark, sf_dir, "documents")
    return d.select("doc_id", moderation.severity_of(moderation.matches(F.col("text"), TERMS)).alias("severity"))


@query(f"WITH {EVENTS_SQL} SELECT id, coalesce(CASE WHEN id % 5 <> 0 THEN image_url END, 'https://img.example.org/venue.jpg') AS image FROM ev")
def image_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("id") % 5 == 0, "https://img.example.org/placeholder.png").otherwise(F.col("image_url"))
    return catalog.events(spark, sf_dir).select("id", text.image_of(own, F.lit("https://img.example.org/venue.jpg")).alias("image"))


@query(f"WITH {EVENTS_SQL} SELECT id, category || CASE WHEN fest_a THEN ',fest-a' ELSE '' END || CASE WHEN umbrella THEN ',umbrella' ELSE '' END || CASE WHEN fest_b THEN ',fest-b' ELSE '' END || ',extra' AS tags FROM ev")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.events(spark, sf_dir).select("id", F.array_join(text.tag_union(F.col("tags"), F.array(F.upper("category"), F.lit("Extra"))), ",").alias("tags"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Hall ' || CAST(s_suppkey AS VARCHAR) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN '12 Main St' END AS address, CASE WHEN s_suppkey % 4 = 0 THEN 'Springfield' END AS city FROM supplier")
def comma_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat('Hall ', s_suppkey, ', 12 Main St , Springfield') WHEN 2 THEN concat('Hall ', s_suppkey, ',12 Main St,44308') WHEN 1 THEN 'Just a hall' ELSE '9 Elm St, 12 Main St, Town' END")
    c = text.comma_location(raw)
    return catalog.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), c["name"].alias("name"), c["address"].alias("address"), c["city"].alias("city"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'porch' WHEN 1 THEN 'stage' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS number, 'porchfest2024' AS key FROM part")
def festival_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.expr("CASE p_partkey % 3 WHEN 0 THEN array('x', concat('porch-', p_size)) WHEN 1 THEN array(concat('stage-', p_brand)) ELSE array('x') END")
    c = text.column_tag(tags)
    return catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), c["kind"].alias("kind"), c["number"].alias("number"), text.query_key(F.lit("Porch-Fest 2024")).alias("key"))


@query("SELECT o_orderkey AS id, 'WEEKLY' AS freq, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS every FROM orders")
def rule_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.rule_map(F.concat(F.lit("freq=WEEKLY;junk; interval = "), (F.col("o_orderkey") % 5 + 1).cast("string")))
    return catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.try_element_at(m, F.lit("FREQ")).alias("freq"), F.try_element_at(m, F.lit("INTERVAL")).alias("every"))


@query(f"WITH {EVENTS_SQL} SELECT id, 'UID:' || source_id AS uid, 'DTSTART:' || strftime(start_at, '%Y%m%dT%H%M%SZ') AS starts FROM ev")
def calendar_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.events(spark, sf_dir).withColumns({"description": F.lit(None).cast("string"), "updates": F.lit(0)})
    lines = F.split("component", "\r\n")
    return calendars.components(rows).select("id", F.get(lines, F.lit(1)).alias("uid"), F.get(lines, F.lit(4)).alias("starts"))


@query(f"WITH {EVENTS_SQL} SELECT source_id, title, {sql_stamp('start_at')} AS start_at, {sql_stamp('end_at')} AS end_at FROM ev")
def calendar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as calendar text and parsed back."""
    rows = catalog.events(spark, sf_dir).withColumns({"description": F.lit("line one\nline two; with, signs"), "updates": F.lit(0)})
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.col("component"), F.lit("\r\nEND:VCALENDAR\r\n"))
    parsed = calendars.events(calendars.components(rows).select(F.col("id").alias("feed_id"), body.alias("body")))
    return calendars.normalised(parsed, "ics").select("source_id", "title", stamp("start_at").alias("start_at"), stamp("end_at").alias("end_at"))


@query(f"WITH {EVENTS_SQL} SELECT id, {sql_stamp('start_at')} AS start_at FROM ev WHERE start_at > {NOW} - INTERVAL 3 HOUR ORDER BY ev.start_at, id LIMIT 50")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.feed_items(catalog.events(spark, sf_dir), AS_OF).select("id", stamp("start_at").alias("start_at"))


@query(f"WITH {EVENTS_SQL}, {VENUES_SQL} SELECT 'static' AS kind, 1 AS n UNION ALL SELECT 'event', count(*) FROM ev WHERE start_at > {NOW} - INTERVAL 90 DAY UNION ALL SELECT 'venue', count(*) FROM ve WHERE listed UNION ALL SELECT 'organization', count(*) FROM customer")
def sitemap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = spark.createDataFrame([("/",)], "path string")
    pages = sinks.sitemap(static, catalog.events(spark, sf_dir), catalog.venues(spark, sf_dir), catalog.organizations(spark, sf_dir), AS_OF)
    return pages.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL} SELECT id, title AS name, {sql_stamp('start_at')} AS starts, CAST(price_min AS VARCHAR) AS price FROM ev""")
def structured_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data embedded in a page and extracted again."""
    e = catalog.events(spark, sf_dir).withColumn("venue", F.concat(F.lit("Venue "), F.col("venue_id").cast("string")))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.col("json"), F.lit('</script><script type="application/ld+json">{broken</script></html>'))
    o = sinks.structured(e).select("id", F.explode(feeds.schema_objects(feeds.json_ld(page), "Event")).alias("j"))
    return o.select("id", F.get_json_object("j", "$.name").alias("name"), stamp(F.try_to_timestamp(F.get_json_object("j", "$.startDate"))).alias("starts"), F.get_json_object("j", "$.offers.price").alias("price"))


@query(f"WITH {EVENTS_SQL} SELECT source_id, title, {sql_stamp('start_at')} AS start_at, CAST(price_min AS DOUBLE) AS price_min FROM ev")
def tribe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a calendar interface, rendered from events and parsed by the adapter."""
    e = catalog.events(spark, sf_dir)
    item = F.struct(F.col("source_id").alias("id"), F.concat(F.lit("<b>"), F.col("title"), F.lit("</b>")).alias("title"), F.date_format(F.from_utc_timestamp("start_at", "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("start_date"), F.concat(F.lit("$"), F.col("price_min").cast("string")).alias("cost"))
    pages = e.groupBy(F.floor(F.col("id") / 50).alias("page")).agg(F.to_json(F.struct(F.lit(20).alias("total_pages"), F.collect_list(item).alias("events"))).alias("body"))
    return feeds.tribe(pages, "tribe").select("source_id", "title", stamp("start_at").alias("start_at"), "price_min")


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 12 AS INTEGER) AS hour, CAST(o_orderkey % 60 AS INTEGER) AS minute, CAST(o_orderkey % 300 AS INTEGER) AS minutes FROM orders WHERE o_orderkey % 12 <> 0")
def clock_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.table(spark, sf_dir, "orders").filter("o_orderkey % 12 <> 0")
    c = times.parse_clock(F.format_string("%d:%02d a.m.", F.col("o_orderkey") % 12, F.col("o_orderkey") % 60))
    n = F.col("o_orderkey") % 300
    d = times.iso_duration_minutes(F.format_string("PT%dH%dM59S", F.floor(n / 60), n % 60))
    return o.select(F.col("o_orderkey").alias("id"), c["hour"].alias("hour"), c["minute"].alias("minute"), d.alias("minutes"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, max(length(text)) AS longest FROM conversations GROUP BY conv_id")
def thread_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.table(spark, sf_dir, "conversations")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), F.max(F.length("text")).cast("long").alias("longest"))


QUERIES, SQL = query.queries, query.sql

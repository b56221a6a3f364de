"""Duplicate groups, merge plans and capped runs, with SQL that settles the same greedy choices by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.catalog import EVENTS_SQL
from tidewell.functions import text
from tidewell.operators import matching
from tidewell.plans import dedupe
from tidewell.queries.base import Registry, eastern
from tidewell.queries.entities import listings

query = Registry()
PLACEHOLDERS, FIRST, AGGREGATORS = ("src7",), ("src3", "src1"), ("src6", "src7")
CAP = 40


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumns({"description": F.when(F.col("id") % 3 == 0, F.lit("A description that is long enough")), "overridden": F.col("id") % 97 == 0})


def ranked_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.ranked(described(spark, sf_dir), PLACEHOLDERS, FIRST, AGGREGATORS)


def _key(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({c}), '''', ''), '[^a-z0-9]+', ' ', 'g'))"


def _umbrella(short: str, long_: str) -> str:
    pattern = "'^(.+?)(?::|\\s[—–-]\\s)(.+)$'"
    return f"(regexp_matches({long_}, {pattern}) AND {_key(f'regexp_extract({long_}, {pattern}, 1)')} = {_key(short)} AND {_key(f'regexp_extract({long_}, {pattern}, 2)')} <> '')"


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
#: Listings, and how any two of their titles match: the passes' tests, once for each pair of different titles.
TITLES_SQL = f"""{EVENTS_SQL}, li AS (SELECT id, title, source, source_id, image_url, date_trunc('hour', start_at) AS start_at, end_at, CASE WHEN id % 11 <> 0 THEN venue_id END AS place,
    strftime({eastern("date_trunc('hour', start_at)")}, '%Y-%m-%d') AS day, source = 'src7' AS again, source = 'src7' AND (strftime({eastern("date_trunc('hour', start_at)")}, '%H:%M') = '09:00' OR end_at IS NULL) AS low,
    CASE WHEN id % 3 = 0 THEN 'A description that is long enough' END AS description, id % 97 = 0 AS overridden FROM ev),
  ti AS (SELECT title, {_key("title")} AS key, list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT list_contains([{STOP}], w) AND NOT regexp_full_match(w, '[0-9]+(st|nd|rd|th)')) AS tk FROM (SELECT DISTINCT title FROM li)),
  t0 AS (SELECT a.title AS ta, b.title AS tb, a.key AS ka, b.key AS kb, a.tk AS xa, b.tk AS xb, CASE WHEN length(a.key) <= length(b.key) THEN a.key ELSE b.key END AS ks, CASE WHEN length(a.key) <= length(b.key) THEN b.key ELSE a.key END AS kl,
    CASE WHEN len(a.tk) <= len(b.tk) THEN a.tk ELSE b.tk END AS s, CASE WHEN len(a.tk) <= len(b.tk) THEN b.tk ELSE a.tk END AS l FROM ti a, ti b),
  t1 AS (SELECT *, list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]) AS j, regexp_replace(kl, '^[^ ]* ', '') AS r1, len(xa) >= 2 AND len(xb) >= 2 AS rich, replace(ka, ' ', '') = replace(kb, ' ', '') AS same,
    contains(' ' || kl || ' ', ' ' || ks || ' ') AND ks <> kl AS phrase, {_umbrella("ta", "tb")} OR {_umbrella("tb", "ta")} AS umbrella FROM t0),
  t2 AS (SELECT *, len(list_filter(s, lambda t: list_contains(l, t))) >= 0.9 * len(s) AS nine, len(list_filter(s, lambda t: list_contains(l, t))) >= 0.75 * len(s) AS three,
    rich AND len(list_filter(s, lambda t: list_contains(l, t) OR list_contains(j, t) OR (length(t) >= 5 AND len(list_filter(l, lambda u: length(u) >= 5 AND levenshtein(t, u) <= 1)) > 0))) >= 0.9 * len(s) AS tolerant,
    coalesce(xa[1] = xb[1] AND xa[2] = xb[2], false) AS lead, regexp_replace(r1, '^[^ ]* ', '') AS r2 FROM t1),
  t3 AS (SELECT *, ka <> '' AND kb <> '' AND (same OR phrase OR (rich AND (nine OR lead))) AS strong FROM t2),
  tp AS (SELECT ta, tb, same, strong, rich AND three AS fuzzy, same OR starts_with(kl, ks || ' ') OR (contains(kl, ' ') AND r1 = ks) OR (contains(kl, ' ') AND contains(r1, ' ') AND r2 = ks) OR coalesce(xa[1] = xb[1] AND xa[2] = xb[2] AND xa[3] = xb[3], false) OR strong OR tolerant AS exact,
    ka <> '' AND kb <> '' AND (same OR (NOT umbrella AND (phrase OR (rich AND nine)))) AS loose, NOT umbrella AND tolerant AS at_once FROM t3)"""


def _anchored(number: int, pairs: str) -> str:
    """A pass over pairs (a, b): rounds that tell anchors (1) from members (2), then members at their first anchor, numbered."""
    e, s, g = f"e{number}", f"s{number}", f"g{number}"
    return f"""{e} AS ({pairs}),
  {s} AS (SELECT 0 AS r, id, 0 AS st FROM (SELECT a AS id FROM {e} UNION SELECT b FROM {e})
    UNION ALL SELECT s.r + 1, s.id, CASE WHEN s.st <> 0 THEN s.st WHEN q.anchored THEN 2 WHEN q.in_doubt THEN 0 ELSE 1 END FROM {s} s
    LEFT JOIN (SELECT b, bool_or(x.st = 1) AS anchored, bool_or(x.st = 0) AS in_doubt FROM {e} JOIN {s} x ON x.id = a GROUP BY b) q ON q.b = s.id WHERE EXISTS (SELECT 1 FROM {s} WHERE st = 0)),
  m{number} AS (SELECT b, arg_min(a, (x.start_at, a)) AS a FROM {e} JOIN li x ON x.id = a WHERE a IN (SELECT id FROM {s} WHERE st = 1 AND r = (SELECT max(r) FROM {s})) GROUP BY b),
  {g} AS (SELECT '{number}:' || CAST(a AS VARCHAR) AS group_id, b AS event_id, row_number() OVER (PARTITION BY a ORDER BY x.start_at, b) AS position, {number} AS pass_no FROM m{number} JOIN li x ON x.id = b
    UNION ALL SELECT DISTINCT '{number}:' || CAST(a AS VARCHAR), a, 0, {number} FROM m{number})"""


AFTER = "a.source <> b.source AND (a.start_at < b.start_at OR (a.start_at = b.start_at AND a.id < b.id))"
LEFT1 = "(SELECT * FROM li WHERE place IS NOT NULL AND id NOT IN (SELECT event_id FROM g1))"
LEFT2 = "(SELECT * FROM li WHERE place IS NOT NULL AND id NOT IN (SELECT event_id FROM g1 UNION ALL SELECT event_id FROM g2))"
LEFT3 = "(SELECT * FROM li WHERE place IS NOT NULL AND id NOT IN (SELECT event_id FROM g1 UNION ALL SELECT event_id FROM g2 UNION ALL SELECT event_id FROM g3))"
TITLES = "JOIN tp ON tp.ta = a.title AND tp.tb = b.title"
GROUPS_SQL = f"""WITH RECURSIVE {TITLES_SQL},
  {_anchored(1, f"SELECT a.id AS a, b.id AS b FROM li a JOIN li b ON a.place = b.place AND a.start_at = b.start_at AND {AFTER} {TITLES} WHERE exact")},
  {_anchored(2, f"SELECT a.id AS a, b.id AS b FROM {LEFT1} a JOIN {LEFT1} b ON a.place = b.place AND epoch_us(b.start_at) - epoch_us(a.start_at) <= 7200000000 AND {AFTER} {TITLES} WHERE fuzzy")},
  {_anchored(3, f"SELECT a.id AS a, b.id AS b FROM {LEFT2} a JOIN {LEFT2} b ON a.place = b.place AND a.day = b.day AND NOT a.again AND b.low {TITLES} WHERE strong")},
  e4 AS (SELECT a.id AS a, b.id AS b, row_number() OVER (ORDER BY CASE WHEN same THEN 0 ELSE 1 END, abs(epoch_us(a.start_at) - epoch_us(b.start_at)), a.start_at, a.id, b.start_at, b.id) AS n
    FROM (SELECT * FROM li WHERE place IS NULL) a JOIN {LEFT3} b ON a.day = b.day AND a.source <> b.source {TITLES} WHERE same OR loose OR (a.start_at = b.start_at AND at_once)),
  s4 AS (SELECT n, a, b, 0 AS st FROM e4 UNION ALL (
    WITH o AS (SELECT * FROM s4 WHERE st = 0), na AS (SELECT a, min(n) AS n FROM o GROUP BY a), nb AS (SELECT b, min(n) AS n FROM o GROUP BY b), c AS (SELECT o.a, o.b, o.n FROM o JOIN na ON na.n = o.n JOIN nb ON nb.n = o.n)
    SELECT n, a, b, CASE WHEN n IN (SELECT n FROM c) THEN 1 ELSE 0 END FROM o WHERE n IN (SELECT n FROM c) OR (a NOT IN (SELECT a FROM c) AND b NOT IN (SELECT b FROM c)))),
  g4 AS (SELECT '4:' || CAST(b AS VARCHAR) AS group_id, unnest([b, a]) AS event_id, unnest([0, 1]) AS position, 4 AS pass_no FROM s4 WHERE st = 1),
  gr AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4)"""
GOOD = "coalesce(length(trim(description)) > 20, false)"
#: Members with their rank in the group, groups with their tier, plans, and the source keys of what a group deletes.
PLANS_SQL = f"""{GROUPS_SQL},
  me AS (SELECT gr.group_id, li.*, {_key("title")} AS key, row_number() OVER (PARTITION BY group_id ORDER BY low, place IS NULL, CASE WHEN image_url IS NOT NULL AND {GOOD} THEN 0 WHEN image_url IS NOT NULL OR {GOOD} THEN 1 ELSE 2 END,
    CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src6' THEN 1000 WHEN 'src7' THEN 1001 ELSE 900 END, position) AS rank FROM gr JOIN li ON li.id = gr.event_id),
  ri AS (SELECT group_id, max(s) > 1 AS risk FROM (SELECT group_id, count(DISTINCT start_at) AS s FROM me GROUP BY group_id, source) GROUP BY group_id),
  te AS (SELECT group_id, CASE WHEN count(DISTINCT place) <> 1 OR count(*) FILTER (place IS NULL) > 0 THEN 3 WHEN count(DISTINCT start_at) = 1 AND count(DISTINCT source) >= 2 THEN CASE WHEN count(DISTINCT key) = 1 AND min(key) <> '' THEN 0 ELSE 1 END
    WHEN epoch_us(max(start_at)) - epoch_us(min(start_at)) <= 7200000000 THEN 2 ELSE 3 END AS tier FROM me GROUP BY group_id),
  pl AS (SELECT me.group_id, max(id) FILTER (rank = 1) AS canonical_id, max(start_at) FILTER (rank = 1) AS start_at, max(source) FILTER (rank = 1) AS kept_source,
    coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (rank > 1 AND NOT overridden), '') AS delete_ids, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (rank > 1 AND overridden), '') AS preserved_ids,
    count(*) FILTER (rank > 1 AND NOT overridden) AS n, CASE WHEN max(image_url) FILTER (rank = 1) IS NULL THEN arg_min(image_url, rank) FILTER (rank > 1 AND image_url IS NOT NULL) END AS image_url,
    CASE WHEN NOT bool_or(rank = 1 AND {GOOD}) THEN arg_min(description, rank) FILTER (rank > 1 AND {GOOD}) END AS description FROM me GROUP BY me.group_id),
  al AS (SELECT me.group_id, me.source, me.source_id, canonical_id, 'dedupe:tier' || CAST(tier AS VARCHAR) || ':' || CASE WHEN me.source = kept_source THEN 'same-source' ELSE 'cross-source' END AS reason FROM me JOIN pl USING (group_id) JOIN te USING (group_id) WHERE rank > 1 AND NOT overridden)"""


def _capped_sql(cap: str) -> str:
    """Plans that fit under a cap: all if they do, else the surest first, in order, each that still fits."""
    return f"""{PLANS_SQL}, ca AS (SELECT {cap} AS cap), ok AS (SELECT pl.*, tier FROM pl JOIN te USING (group_id) JOIN ri USING (group_id) WHERE NOT risk),
  qu AS (SELECT group_id, n, row_number() OVER (ORDER BY tier, start_at, group_id) AS i FROM ok WHERE tier <= 1),
  st AS (SELECT CAST(0 AS BIGINT) AS i, CAST((SELECT cap FROM ca) AS BIGINT) AS room, CAST(NULL AS VARCHAR) AS group_id UNION ALL SELECT qu.i, CASE WHEN n <= room THEN room - n ELSE room END, CASE WHEN n <= room THEN qu.group_id END FROM st JOIN qu ON qu.i = st.i + 1),
  ch AS (SELECT group_id, CASE WHEN (SELECT sum(n) FROM ok) <= (SELECT cap FROM ca) THEN 'uncapped' WHEN (SELECT min(room) FROM st) < (SELECT cap FROM ca) THEN 'partial-drain' ELSE 'stalled' END AS outcome
    FROM (SELECT group_id FROM st WHERE group_id IS NOT NULL AND (SELECT sum(n) FROM ok) > (SELECT cap FROM ca) UNION ALL SELECT group_id FROM ok WHERE (SELECT sum(n) FROM ok) <= (SELECT cap FROM ca)))"""


@query(f"{GROUPS_SQL} SELECT group_id, event_id, CAST(position AS INTEGER) AS position, CAST(pass_no AS INTEGER) AS pass_no FROM gr")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.duplicate_groups(listings(spark, sf_dir), PLACEHOLDERS).withColumnRenamed("pass", "pass_no")


@query(f"{PLANS_SQL} SELECT group_id, canonical_id, delete_ids, preserved_ids, image_url, description, CAST(tier AS INTEGER) AS tier, risk FROM pl JOIN te USING (group_id) JOIN ri USING (group_id)")
def merge_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_members(spark, sf_dir)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return matching.merge_plan(ranked).join(matching.tier_of_group(ranked), "group_id").select("group_id", "canonical_id", joined("delete_ids"), joined("preserved_ids"), "image_url", "description", "tier", "risk")


@query(f"{PLANS_SQL} SELECT source, source_id, canonical_id, reason FROM al")
def alias_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_members(spark, sf_dir)
    return matching.alias_rows(ranked, matching.tier_of_group(ranked))


@query(f"{_capped_sql(str(CAP))} SELECT group_id, outcome FROM ch")
def capped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a run may execute under a cap."""
    chosen, outcome = dedupe.chosen(dedupe.planned(ranked_members(spark, sf_dir)), CAP)
    return chosen.select("group_id", F.lit(outcome).alias("outcome"))


@query(f"""{_capped_sql("100")}, ln AS (SELECT id AS event_id, user_id % 10 AS venue_id, user_id AS organization_id FROM ev WHERE id % 2 = 0),
  mc AS (SELECT me.*, pl.canonical_id, canonical_id IN (SELECT event_id FROM ln) AS linked FROM me JOIN ch USING (group_id) JOIN pl USING (group_id))
  SELECT 'delete' AS kind, id, group_id AS detail FROM mc WHERE rank > 1 AND NOT overridden
  UNION ALL SELECT 'merge', canonical_id, coalesce(image_url, description) FROM pl WHERE group_id IN (SELECT group_id FROM ch) AND (image_url IS NOT NULL OR description IS NOT NULL)
  UNION ALL SELECT DISTINCT 'venue', canonical_id, CAST(venue_id AS VARCHAR) FROM mc JOIN ln ON event_id = id WHERE rank > 1 AND NOT overridden AND NOT linked
  UNION ALL SELECT DISTINCT 'organization', canonical_id, CAST(organization_id AS VARCHAR) FROM mc JOIN ln ON event_id = id WHERE rank > 1 AND NOT overridden AND NOT linked AND NOT (source = 'src6' AND organization_id = 6)
  UNION ALL SELECT 'alias', canonical_id, reason FROM al WHERE group_id IN (SELECT group_id FROM ch)""")
def dedupe_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that one capped run does, as (kind, id, detail)."""
    e, members = described(spark, sf_dir), ranked_members(spark, sf_dir)
    links = catalog.events(spark, sf_dir).filter("id % 2 = 0").select(F.col("id").alias("event_id"), "venue_id", F.col("organization_id"))
    credits = spark.createDataFrame([("src6", 6)], "source string, organization_id long")
    done = dedupe.run(members, links.select("event_id", "venue_id"), links.select("event_id", "organization_id"), credits, e.count(), 100)
    row = lambda df, kind, id_, detail: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), detail.cast("string").alias("detail"))
    return (
        row(done.deletes, "delete", "id", F.col("group_id"))
        .unionByName(row(done.merges, "merge", "id", F.coalesce("image_url", "description")))
        .unionByName(row(done.venue_links, "venue", "canonical_id", F.col("venue_id")))
        .unionByName(row(done.organization_links, "organization", "canonical_id", F.col("organization_id")))
        .unionByName(row(done.aliases, "alias", "canonical_id", F.col("reason")))
    )


QUERIES, SQL = query.queries, query.sql

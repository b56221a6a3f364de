"""Geography and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.catalog import VENUES_SQL
from tidewell.functions import geo, times
from tidewell.operators import digest, joins, windows
from tidewell.queries.base import Registry, sql_stamp, stamp

query = Registry()
H_SQL = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)"


@query(f"""WITH {VENUES_SQL}, j AS (SELECT a.id AS a, b.id AS b, {H_SQL} AS h FROM ve a JOIN ve b ON a.area_id = b.area_id AND a.id < b.id)
  SELECT a, b, round(2 * 3959 * atan2(sqrt(h), sqrt(1 - h)), 6) AS digest, round(2 * 3958.8 * asin(least(1, sqrt(h))), 6) AS plan, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM j""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of venues of an area; each two places of a pack are measured once."""
    v = catalog.venues(spark, sf_dir).select(F.col("area_id").alias("g"), "id", "lat", "lng")
    c = [F.col(x) for x in ("item_a.lat", "item_a.lng", "item_b.lat", "item_b.lng")]
    values = {"digest": F.round(geo.haversine(*c), 6), "plan": F.round(geo.haversine_clamped(*c), 6), "metres": F.round(geo.haversine(*c, geo.METRES), 3)}
    return joins.smaller_first(joins.item_pairs(joins.packs(v, "lat", "lng")).withColumns(values), *values)


@query(f"WITH {VENUES_SQL} SELECT printf('%.5f|%.5f', lat, lng) AS key, count(*) AS n FROM ve GROUP BY 1")
def marker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.venues(spark, sf_dir).groupBy(geo.coordinate_key(F.col("lat"), F.col("lng")).alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {VENUES_SQL} SELECT min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM ve")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.bounding_box(catalog.venues(spark, sf_dir))


@query(f"WITH {VENUES_SQL} SELECT CASE WHEN lat BETWEEN 41.0005 AND 41.0205 AND lng BETWEEN -81.5005 AND -81.4705 THEN CASE WHEN lat > 41.0055 AND lat < 41.0105 AND lng > -81.4955 AND lng < -81.4905 THEN 'rest' ELSE 'ring' END ELSE 'rest' END AS slug, count(*) AS n FROM ve GROUP BY 1")
def neighbourhood_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = [[-81.5005, 41.0005], [-81.4705, 41.0005], [-81.4705, 41.0205], [-81.5005, 41.0205]]
    hole = [[-81.4955, 41.0055], [-81.4905, 41.0055], [-81.4905, 41.0105], [-81.4955, 41.0105]]
    world = [[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0]]
    shapes = spark.createDataFrame([("ring", 0, [outer, hole]), ("rest", 1, [world])], "slug string, ordinal int, rings array<array<array<double>>>")
    return geo.locate(catalog.venues(spark, sf_dir), shapes).groupBy("slug").agg(F.count("*").alias("n"))


@query(f"WITH {VENUES_SQL} SELECT id FROM ve WHERE lat BETWEEN 41.0 AND 41.05 AND lng BETWEEN -81.5 AND -81.45 AND id % 3 <> 0")
def geocode_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE id % 3 WHEN 0 THEN 'CITY' ELSE 'ROOFTOP' END")
    ok = geo.geocode_accepted(kind, F.lit("00001"), F.lit("00001"), F.col("lat"), F.col("lng"), (41.0, -81.5, 41.05, -81.45), ("ROOFTOP", "RANGE"))
    return catalog.venues(spark, sf_dir).filter(ok).select("id")


@query("SELECT r_name AS region, count(*) AS nations, min(n_name) AS first FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = catalog.table(spark, sf_dir, "nation").join(F.broadcast(catalog.table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))  # 5 regions
    return n.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations"), F.min("n_name").alias("first"))


@query(f"SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS month, CAST(dayofweek(date_trunc('month', o_orderdate)) AS INTEGER) AS pad, CAST((CAST(last_day(o_orderdate) AS DATE) - CAST(date_trunc('month', o_orderdate) AS DATE)) + 1 + dayofweek(date_trunc('month', o_orderdate)) + 6 - dayofweek(last_day(o_orderdate)) AS INTEGER) AS cells FROM orders")
def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.table(spark, sf_dir, "orders").select(F.to_date(F.trunc("o_orderdate", "MM")).alias("m")).distinct()
    grid = times.month_grid(F.col("m"))
    return m.select(stamp("m").alias("month"), F.datediff("m", F.get(grid, F.lit(0))).alias("pad"), F.size(grid).alias("cells"))


@query("SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) AS DATE) + CAST((3 - dayofweek(date_trunc('month', o_orderdate)) + 7) % 7 + 7 AS INTEGER) AS second_wednesday, CAST(last_day(o_orderdate) AS DATE) - CAST((dayofweek(last_day(o_orderdate)) - 5 + 7) % 7 AS INTEGER) AS last_friday FROM orders")
def nth_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.table(spark, sf_dir, "orders").select(F.to_date(F.trunc("o_orderdate", "MM")).alias("month")).distinct()
    return m.select("month", times.nth_weekday(F.col("month"), F.lit(3), F.lit(2)).alias("second_wednesday"), times.nth_weekday(F.col("month"), F.lit(5), F.lit(-1)).alias("last_friday"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + CAST((2 - dayofweek(o_orderdate) + 7) % 7 + 14 AS INTEGER) AS third FROM orders")
def next_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.get(times.next_weekly(F.to_date("o_orderdate"), 2, 3), F.lit(2)).alias("third"))


@query("SELECT p_partkey AS id, list_aggregate(list_sort(list_distinct([CAST(floor(i * (p_size + 9) / 4.0 + 0.5) AS INTEGER) FOR i IN range(5)])), 'string_agg', ',') AS places FROM part")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(windows.even_positions(F.col("p_size") + 10, 5).cast("array<string>"), ",").alias("places"))


@query(f"""WITH {VENUES_SQL} SELECT CASE WHEN id % 4 = 0 THEN CASE id % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'out' ELSE 'unknown' END WHEN lat > 41.0005 AND lat < 41.0505 AND lng > -81.4755 AND lng < -81.4305 THEN 'in' ELSE 'out' END AS place, count(*) AS n FROM ve GROUP BY 1""")
def locality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = F.array(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((-81.4755, 41.0005), (-81.4305, 41.0005), (-81.4305, 41.0505), (-81.4755, 41.0505)))))
    city = F.expr("CASE id % 3 WHEN 0 THEN ' Oakville' WHEN 1 THEN 'FARAWAY' ELSE 'x' END")
    lat = F.when(F.col("id") % 4 != 0, F.col("lat"))
    return catalog.venues(spark, sf_dir).groupBy(geo.locality(lat, F.col("lng"), rings, city, ("oakville",), ("faraway",)).alias("place")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT p_partkey AS id, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(range(1, length(p_name) + 1), lambda i: CAST(unicode(p_name[i]) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS seed FROM part),
  a AS (SELECT *, (seed + 1831565813) % 4294967296 AS a FROM f), t AS (SELECT *, (xor(a, a >> 15) * (a | CAST(1 AS HUGEINT))) % 4294967296 AS t FROM a),
  u AS (SELECT *, xor((t + (xor(t, t >> 7) * (t | CAST(61 AS HUGEINT))) % 4294967296) % 4294967296, t) AS u FROM t)
  SELECT id, CAST(seed AS BIGINT) AS seed, round(CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296.0, 9) AS jitter FROM u""")
def digest_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = digest.fnv1a(F.col("p_name"))
    return catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), seed.alias("seed"), F.round(digest.mulberry32(seed), 9).alias("jitter"))


QUERIES, SQL = query.queries, query.sql

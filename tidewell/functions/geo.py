"""Distances, boxes and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.scratch import materialize

#: Mean earth radii in use, by unit and purpose.
MILES_DIGEST, MILES_PLAN, METRES = 3959.0, 3958.8, 6_371_000.0


def _half(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    up, over = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    return F.pow(F.sin(up), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(over), 2)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = MILES_DIGEST) -> Column:
    """Great-circle distance by the arctangent form; null if a coordinate is."""
    h = _half(lat1, lng1, lat2, lng2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_clamped(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = MILES_PLAN) -> Column:
    """The arcsine form with its argument held at 1."""
    h = _half(lat1, lng1, lat2, lng2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def coordinate_key(lat: Column, lng: Column) -> Column:
    """Both coordinates to five decimals, joined by a bar."""
    return F.when(lat.isNotNull() & lng.isNotNull(), F.format_string("%.5f|%.5f", lat.cast("double"), lng.cast("double")))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def geocode_accepted(kind: Column, zip_wanted: Column, zip_found: Column, lat: Column, lng: Column, box: tuple[float, float, float, float], kinds: tuple[str, ...]) -> Column:
    """Whether a geocoder's answer is precise enough, agrees in zip where both are known, and lies in the box."""
    agrees = zip_wanted.isNull() | zip_found.isNull() | (zip_wanted == zip_found)
    return kind.isin(*kinds) & agrees & F.coalesce(in_box(lat, lng, *box), F.lit(False)) & ~F.isnan(lat) & ~F.isnan(lng)


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring, an array of [lng, lat] arrays."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i - 1 + n, n))
        ax, ay, bx, by = a[0], a[1], b[0], b[1]
        rise = F.when(by != ay, by - ay)
        return ((ay > lat) != (by > lat)) & (lng < (bx - ax) * (lat - ay) / rise + ax)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(crosses(i), 1).otherwise(0))
    return F.when(n > 2, hits % 2 == 1).otherwise(False)


def in_polygon(lng: Column, lat: Column, rings: Column) -> Column:
    """Even-odd over all rings, so that a hole is outside and all polygons of a multipolygon may be given at once."""
    return F.aggregate(rings, F.lit(False), lambda s, ring: s != in_ring(lng, lat, ring))


def with_box(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons with the bounding box of their rings."""
    points = F.flatten(F.col(rings))
    x, y = _axis(points, 0), _axis(points, 1)
    return polygons.withColumns({"west": F.array_min(x), "east": F.array_max(x), "south": F.array_min(y), "north": F.array_max(y)})


def _axis(points: Column, i: int) -> Column:
    return F.transform(points, lambda p: p[i])


#: Edges reach this much farther when cells are covered, beyond what rounding can move a point.
SLACK = 1e-9


def _edges(rings: Column) -> Column:
    """All edges of an array of rings, rings of two points or fewer left out."""
    def of(ring: Column) -> Column:
        n = F.size(ring)
        edge = lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
        return F.transform(ring, lambda p, i: edge(p, F.get(ring, F.pmod(i - 1 + n, n))))

    return F.flatten(F.transform(F.filter(rings, lambda ring: F.size(ring) > 2), of))


def _odd(lng: Column, lat: Column, edges: Column) -> Column:
    """Whether a ray from the point crosses an odd number of the edges: the test of ``in_polygon``, over edges."""
    def crosses(e: Column) -> Column:
        rise = F.when(e["by"] != e["ay"], e["by"] - e["ay"])
        return ((e["ay"] > lat) != (e["by"] > lat)) & (lng < (e["bx"] - e["ax"]) * (lat - e["ay"]) / rise + e["ax"])

    return F.aggregate(edges, F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))


def covering(polygons: DataFrame, across: int = 16) -> DataFrame:
    """Polygons (slug, ordinal, rings) as rows (level, y, x, slug, ordinal, edges) of the square cells that they cover.

    Cells of a level are 360 / 2**level degrees wide; a polygon takes the level at which its box is at most ``across`` cells, so
    it has a bounded number of them.  A cell that no edge touches lies wholly inside, and edges is null, or wholly outside, and
    there is no row; for any other, edges are those at the cell's latitudes, all that an even-odd test of its points needs.
    Rows of one slug and ordinal are polygons of their own; polygons without a ring of three points have no cells.
    """
    boxed = with_box(polygons.select("slug", "ordinal", "rings"))
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    level = F.when(span > 0, F.least(F.floor(F.log2(across * 360 / span)), F.lit(30))).otherwise(30).cast("int")
    leveled = boxed.filter(span.isNotNull()).withColumn("level", level).withColumn("pid", F.monotonically_increasing_id())
    known = materialize(leveled.withColumn("size", 360 / F.pow(F.lit(2.0), "level")), "polygons")
    size = F.col("size")
    cell = lambda low, high: F.sequence(F.floor((low - SLACK) / size), F.floor((high + SLACK) / size))
    edges = known.select("pid", "size", F.explode(_edges(F.col("rings"))).alias("e"))
    by_row = edges.withColumn("y", F.explode(cell(F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by"))))
    rows = by_row.groupBy("pid", "y").agg(F.collect_list("e").alias("edges"))
    # an edge touches a cell if the boxes of both meet and the cell's corners are not all on one side of the edge
    met = by_row.withColumn("x", F.explode(cell(F.least("e.ax", "e.bx"), F.greatest("e.ax", "e.bx"))))
    side = lambda i, j: (F.col("e.bx") - F.col("e.ax")) * ((F.col("y") + j) * size - F.col("e.ay")) - (F.col("e.by") - F.col("e.ay")) * ((F.col("x") + i) * size - F.col("e.ax"))
    corners = [side(i, j) for i in (0, 1) for j in (0, 1)]
    reach = SLACK * (F.abs(F.col("e.bx") - F.col("e.ax")) + F.abs(F.col("e.by") - F.col("e.ay")))
    touched = met.filter((F.least(*corners) <= reach) & (F.greatest(*corners) >= -reach)).select("pid", "y", "x", F.lit(True).alias("edge")).distinct()
    cells = known.select("pid", "slug", "ordinal", "level", "size", F.explode(cell(F.col("south"), F.col("north"))).alias("y"), cell(F.col("west"), F.col("east")).alias("xs")).withColumn("x", F.explode("xs"))
    judged = cells.join(rows, ["pid", "y"]).join(touched, ["pid", "y", "x"], "left")
    whole = _odd((F.col("x") + 0.5) * size, (F.col("y") + 0.5) * size, F.col("edges"))
    return judged.filter(F.col("edge") | whole).select("level", "y", "x", "slug", "ordinal", F.when(F.col("edge"), F.col("edges")).alias("edges"))


def locate(points: DataFrame, polygons: DataFrame, lat: str = "lat", lng: str = "lng", across: int = 16) -> DataFrame:
    """Points with the slug of the first polygon (by ordinal, then slug) that holds them, or null.

    ``polygons`` has slug, ordinal and rings.  Each place is met by equality with the cells of ``covering`` at each level in
    use (31 at most for polygons on a globe): cells inside a polygon answer at once, only cells on a border test edges.  Places
    that occur often are looked up once; those without a finite coordinate are in no polygon.
    """
    cells = materialize(covering(polygons, across), "cells")
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # a few whole numbers
    y, x = F.col(lat).cast("double"), F.col(lng).cast("double")
    places = points.select(y.alias("_lat"), x.alias("_lng")).filter((F.abs("_lat") <= 1e6) & (F.abs("_lng") <= 1e6)).distinct()
    at = F.col("_level")
    asked = places.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    size = 360 / F.pow(F.lit(2.0), at)
    keyed = asked.select("_lat", "_lng", at.alias("level"), F.floor(F.col("_lat") / size).alias("y"), F.floor(F.col("_lng") / size).alias("x"))
    held = keyed.join(cells, ["level", "y", "x"]).filter(F.col("edges").isNull() | _odd(F.col("_lng"), F.col("_lat"), F.col("edges")))
    first = held.groupBy("_lat", "_lng").agg(F.min(F.struct("ordinal", "slug")).alias("_first"))
    return points.join(first, (y == F.col("_lat")) & (x == F.col("_lng")), "left").withColumn("slug", F.col("_first.slug")).drop("_lat", "_lng", "_first")


def locality(lat: Column, lng: Column, rings: Column, city: Column, inside: tuple[str, ...], outside: tuple[str, ...]) -> Column:
    """in, out or unknown: by coordinates where there are any, else by lists of cities."""
    named = F.lower(F.trim(city))
    by_name = F.when(named.isin(*inside), "in").when(named.isin(*outside), "out").otherwise("unknown")
    return F.when(lat.isNull() | lng.isNull(), by_name).when(in_polygon(lng, lat, rings), "in").otherwise("out")


def any_within(lat: Column, lng: Column, areas: Column, miles: Column) -> Column:
    """Whether a point lies within ``miles`` of any of an array of structs with lat and lng."""
    return F.exists(areas, lambda a: haversine(a["lat"], a["lng"], lat, lng) <= miles)


"""Time bins and cells against plain versions, with one key that holds most rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import geo
from tidewell.operators import joins, windows

T0 = datetime(1969, 12, 30)  # bins before 1970 are whole too


def timed(n, seed, span=4000, null=0.05):
    """Rows (id, key, start_at, source): a third or more of one key, ties, nulls."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 3 + ["a", "b", None]), None if rng.random() < null else T0 + timedelta(minutes=rng.randrange(span)), f"s{rng.randrange(3)}") for i in range(n)]


@pytest.mark.parametrize("hours", [1.0, 0.5, 0.0])
def test_sessions_equal_a_walk(spark, hours):
    rows = timed(400, 1)
    want = {}
    for key in {r[1] for r in rows}:
        number, before = 0, None
        for i, _, at, _ in sorted((r for r in rows if r[1] == key and r[2]), key=lambda r: r[2]):
            number += before is None or at - before > timedelta(hours=hours)
            want[i], before = number, at
    frame = spark.createDataFrame(rows, "id long, title string, start_at timestamp, source string")
    got = {r["id"]: r["session"] for r in windows.sessions(frame, "title", hours).collect()}
    assert got == {r[0]: want.get(r[0]) for r in rows}
    groups = {}
    for i, key, _, source in rows:
        if key and i in want:
            groups.setdefault((key, want[i]), []).append((i, source))
    wanted = sorted((k, len(v), len({s for _, s in v}), "+".join(sorted({s for _, s in v})), min(v)[0]) for (k, _), v in groups.items() if len(v) > 1 and len({s for _, s in v}) > 1)
    assert sorted(tuple(r) for r in windows.clusters(frame, "title", hours).select("title", "n", "sources", "pair", "first_id").collect()) == wanted
    assert windows.sessions(frame.filter("false"), "title", hours).collect() == []


@pytest.mark.parametrize("days", [0, 1, 3])
def test_trusted_equal_all_pairs(spark, days):
    rows = [(i, k, at) for i, k, at, _ in timed(300, 2, span=60_000)]
    trusted = [(1000 + i, k, at) for i, k, at, _ in timed(12, 3, span=60_000, null=0.2) if k != "b"] + [(2000, rows[0][1], rows[0][2])]
    schema = "id long, venue_id string, start_at timestamp"
    near = lambda r, t: t[1] == r[1] and r[1] is not None and r[2] and t[2] and abs(t[2] - r[2]) <= timedelta(days=days)
    want = {}
    for r in rows:
        close = any(near(r, t) for t in trusted)
        want[r[0]] = (bool(close), not close and r[1] is not None and any(t[1] == r[1] for t in trusted))
    got = joins.near_trusted(spark.createDataFrame(rows, schema), spark.createDataFrame(trusted, schema), days).collect()
    assert len(got) == len(rows) and {r["id"]: (r["suppress"], r["needs_review"]) for r in got} == want
    none = joins.near_trusted(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), days)
    assert none.filter("suppress OR needs_review").isEmpty() and none.count() == len(rows)


def test_a_hot_venue_is_in_no_window(spark):
    """Rows are never ordered by venue or title: windows stand over bins only."""
    frame = spark.range(9).select("id", F.lit("v").alias("venue_id"), F.lit("t").alias("title"), F.lit("s").alias("source"), F.timestamp_seconds("id").alias("start_at"))
    assert "Window" not in joins.near_trusted(frame, frame)._jdf.queryExecution().optimizedPlan().toString()
    plan = windows.sessions(frame, "title", 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")  # the window reads the aggregate


def star(x, y, r, n, rng):
    return [[x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)] for i in range(n)]


def holds(rings, x, y):
    odd = False
    for ring in rings:
        for i in range(len(ring) if len(ring) > 2 else 0):
            (ax, ay), (bx, by) = ring[i], ring[i - 1]
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


@pytest.mark.parametrize("across", [1, 5, 16])
def test_places_in_polygons_equal_all_rings(spark, across):
    rng = random.Random(5)
    shapes = [(f"p{i % 9}", i // 2, [star(rng.uniform(-4, 4), rng.uniform(-4, 4), rng.choice([0.01, 0.5, 3]), rng.randrange(3, 25), rng) for _ in range(rng.randrange(1, 4))]) for i in range(24)]
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]  # edges and corners on the borders of cells
    shapes += [("square", -2, [square]), ("twice", -1, [square]), ("twice", -1, [square]), ("flat", -3, [[[1.0, 1.0], [2.0, 1.0]]]), ("none", -4, []), ("null", -5, None), ("far", 90, [[[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0]]])]
    on_lines = [(float(y), float(x)) for x in (0, 1, 2) for y in (0, 1, 2)] + [(c[1], c[0]) for s in shapes[:6] for c in s[2][0]]
    spots = on_lines + [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(600)] + [(None, 1.0), (1.0, None), (float("nan"), 0.0), (float("inf"), 0.0), (95.0, 0.0)]
    rows = [(i, *p) for i, p in enumerate(spots * 2)]
    want = {}
    for i, y, x in rows:
        fit = sorted((o, s) for s, o, rings in shapes if None not in (y, x) and math.isfinite(y) and holds(rings or [], x, y))
        want[i] = fit[0][1] if fit else None
    polygons = spark.createDataFrame(shapes, "slug string, ordinal int, rings array<array<array<double>>>")
    points = spark.createDataFrame(rows, "id long, lat double, lng double")
    got = geo.locate(points, polygons, across=across)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {r["id"]: r["slug"] for r in got.collect()} == want
    assert geo.locate(points, polygons.filter("false")).filter("slug IS NOT NULL").isEmpty()


def test_inner_cells_answer_without_edges(spark):
    ring = [[5 * math.cos(i / 50 * math.pi), 5 * math.sin(i / 50 * math.pi)] for i in range(100)]
    cells = geo.covering(spark.createDataFrame([("disc", 0, [ring])], "slug string, ordinal int, rings array<array<array<double>>>")).collect()
    inner = [c for c in cells if c["edges"] is None]
    assert len(inner) > len(cells) / 2 and all(len(c["edges"]) < 60 for c in cells if c["edges"])

"""Queries of similar rows return every pair of rows, copies too, and make them pack by pack."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import joins, matching
from tidewell.queries import QUERIES


def test_pairs_of_items_are_all_pairs(spark):
    """Small packs, a text with more copies than a pack holds, repeated ids, and rows without an id, a group or a text, by brute force."""
    rng = random.Random(3)
    rows = [(rng.choice("gggh") if i % 50 else None, None if i % 31 == 0 else i % 290, rng.choice(("a", "a", "a", "b", "c", None))) for i in range(300)]
    met = joins.item_pairs(joins.packs(spark.createDataFrame(rows, "g string, id long, t string"), "t", most=7))
    got = joins.smaller_first(met.withColumn("same", F.col("item_a.t").eqNullSafe(F.col("item_b.t"))), "same")
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    want = [(min(x[1], y[1]), max(x[1], y[1]), x[2] == y[2]) for x, y in combinations(known, 2) if x[0] == y[0] and x[1] != y[1]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_pack_grows_with_copies(spark):
    rows = spark.range(20_000).selectExpr("1 AS g", "id", "IF(id < 19000, 'hot', CAST(id AS STRING)) AS t")
    packed = joins.packs(rows, "t", most=500)
    sizes = [r[0] for r in packed.select(F.aggregate("items", F.lit(0), lambda n, i: n + F.size(i["ids"]))).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 800
    found = joins.smaller_first(joins.item_pairs(packed))
    assert found.count() == 20_000 * 19_999 // 2
    # pairs of packs are dealt out, and nothing is shuffled once they become pairs of rows
    assert found._jdf.queryExecution().executedPlan().toString().split("Exchange")[0].count("Generate") == 4


@pytest.fixture(scope="module")
def copies(spark, sf_dir, tmp_path_factory):
    """Tables with several copies of their rows under other keys."""
    place = str(tmp_path_factory.mktemp("copies"))
    for name, key, step, n in (("supplier", "s_suppkey", 10, 12), ("part", "p_partkey", 200, 4), ("events", "event_id", 1000, 2)):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").crossJoin(spark.range(n).withColumnRenamed("id", "copy"))
        rows.withColumn(key, (F.col(key) + F.col("copy") * step).cast("long")).drop("copy").write.parquet(f"{place}/{name}.parquet")
    return place


def edits(a, b):
    return a == b or any(a[:i] + a[i + 1 :] in (b, b[:i] + b[i + 1 :]) for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def miles(a, b, radius):
    la, lb, dl, dn = *map(math.radians, (a["lat"], b["lat"])), math.radians(b["lat"] - a["lat"]), math.radians(b["lng"] - a["lng"])
    h = math.sin(dl / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(dn / 2) ** 2
    return 2 * radius * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def share(a, b):
    return len(a & b) / len(a | b)


def parts(spark, copies):
    return [(r["p_partkey"], set(r["p_name"].split(" ")), r["p_type"], r["p_size"]) for r in spark.read.parquet(f"{copies}/part.parquet").collect()]


def venues(spark, copies):
    return [{"id": r["s_suppkey"], "name": r["s_name"], "area": r["s_nationkey"], "lat": r["s_suppkey"] % 100 / 1000 + 41, "lng": r["s_suppkey"] % 70 / 1000 - 81.5} for r in spark.read.parquet(f"{copies}/supplier.parquet").collect()]


def ordered(rows, key):
    return combinations(sorted(rows, key=key), 2)


def rounded(rows):
    return sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows)


def test_jaccard_pairs_has_every_pair(spark, copies):
    want = [(a[0], b[0], share(a[1], b[1])) for a, b in ordered(parts(spark, copies), lambda r: r[0]) if a[3] == b[3] and a[1] & b[1]]
    assert rounded(QUERIES["jaccard_pairs"](spark, copies).select("a", "b", "similarity").collect()) == rounded(want)


def test_dice_pairs_has_every_pair(spark, copies):
    want = [(a[0], b[0], 2 * len(a[1] & b[1]) / (len(a[1]) + len(b[1]))) for a, b in ordered(parts(spark, copies), lambda r: r[0]) if a[2:] == b[2:]]
    assert rounded(QUERIES["dice_pairs"](spark, copies).select("a", "b", "similarity").collect()) == rounded(want)


def test_haversine_has_every_pair(spark, copies):
    want = [(a["id"], b["id"], miles(a, b, 3959)) for a, b in ordered(venues(spark, copies), lambda v: v["id"]) if a["area"] == b["area"]]
    got = sorted(tuple(r) for r in QUERIES["haversine"](spark, copies).select("a", "b", "digest").collect())
    assert [r[:2] for r in got] == [w[:2] for w in sorted(want)] and all(abs(r[2] - w[2]) < 1e-5 for r, w in zip(got, sorted(want)))


def test_one_edit_pairs_has_every_pair(spark, copies):
    want = [(a["id"], b["id"]) for a, b in ordered(venues(spark, copies), lambda v: v["id"]) if a["area"] == b["area"] and edits(a["name"], b["name"])]
    assert rounded(QUERIES["one_edit_pairs"](spark, copies).select("a", "b").collect()) == rounded(want)


def test_venue_pairs_has_every_pair(spark, copies):
    want = []
    for a, b in ordered(venues(spark, copies), lambda v: v["id"]):
        x, y = (f"grand hall n{v['area']} r{v['id'] % 3}{' annex' if v['id'] % 8 == 0 else ''}" for v in (a, b))
        by = {"EXACT": x == y, "ADDRESS": a["id"] % 40 == b["id"] % 40, "FUZZY": share(set(x.split()), set(y.split())) >= 0.6, "GEO": miles(a, b, 6_371_000) <= 75}
        want += [(a["id"], b["id"], signal) for signal, holds in by.items() if holds]
    assert rounded(QUERIES["venue_pairs"](spark, copies).select("a", "b", "signal").collect()) == rounded(want)


def test_venue_address_pairs_has_every_pair(spark, copies):
    want = [(a["id"], b["id"]) for a, b in ordered(venues(spark, copies), lambda v: v["id"]) if a["id"] % 40 == b["id"] % 40]
    assert rounded(QUERIES["venue_address_pairs"](spark, copies).select("a", "b").collect()) == rounded(want)


def test_venue_name_pairs_has_every_pair(spark, copies):
    want = [(a["id"], b["id"]) for a, b in ordered(venues(spark, copies), lambda v: v["id"]) if (a["area"] == b["area"]) + (a["id"] % 3 == b["id"] % 3) >= 1]
    assert rounded(QUERIES["venue_name_pairs"](spark, copies).select("a", "b").collect()) == rounded(want)


def test_dup_pairs_exact_has_every_pair(spark, copies):
    from tidewell.queries.entities import listings

    want = matching.exact_pairs(matching.prepared(listings(spark, copies)).filter("place IS NOT NULL")).select("id_a", "id_b").collect()
    assert want and rounded(QUERIES["dup_pairs_exact"](spark, copies).select("a", "b").collect()) == rounded(want)


def test_events_are_paired_by_time_then_id(spark):
    """Times that differ within a second, one id at two times, and titles that match in one order only."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 5, 18)
    rows = [(i % 37, f"Oak {'Series' if i % 3 else 'Club'}", f"s{i % 3}", at + timedelta(seconds=(i % 4) / 2), None, "p") for i in range(60)]
    frame = matching.prepared(spark.createDataFrame(rows, "id long, title string, source string, start_at timestamp, end_at timestamp, place string"))
    shorter = lambda ka, kb, ta, tb: F.length(ka) < F.length(kb)
    want = matching.pairs(frame, ["place", "second"], test=shorter(F.col("key_a"), F.col("key_b"), None, None)).select("id_a", "id_b")
    assert rounded(matching.class_pairs(frame, ["place", "second"], shorter).collect()) == rounded(want.collect()) != []


def test_dup_pairs_fuzzy_has_every_pair(spark, copies):
    from tidewell.queries.entities import listings

    want = matching.fuzzy_pairs(matching.prepared(listings(spark, copies)).filter("place IS NOT NULL")).select("id_a", "id_b").collect()
    assert want and rounded(QUERIES["dup_pairs_fuzzy"](spark, copies).select("a", "b").collect()) == rounded(want)

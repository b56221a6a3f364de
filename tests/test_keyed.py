"""Tables in buckets against a plain dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.sources import keyed

SCHEMA = "id long, seq long, kind string, bucket string"


def state(rows, known):
    for r in rows:
        if r[0] not in known or known[r[0]][1] < r[1]:
            known[r[0]] = r
    return known


def tally(known):
    out = {}
    for r in known.values():
        out[r[2]] = out.get(r[2], 0) + 1
    return out


def check(spark, path, known):
    assert sorted(map(tuple, keyed.read(spark, path).collect()), key=str) == sorted(known.values(), key=str)
    assert {r["kind"]: r["n"] for r in keyed.read_counts(spark, path).collect()} == tally(known)


def test_batches_equal_a_dictionary(spark, tmp_path):
    rng, path, known, seq = random.Random(1), str(tmp_path / "t"), {}, 0
    for _ in range(4):
        rows = []
        for _ in range(40):
            seq += 1
            rows.append((rng.choice([None, *range(60)]), seq, rng.choice(["hot"] * 4 + ["a", None]), "x"))
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, SCHEMA)
        keyed.merge(frame, path, ["id"], "seq", "kind", count=8)
        check(spark, path, state(rows, known))
        keyed.merge(frame, path, ["id"], "seq", "kind", count=8)  # the same batch again
        check(spark, path, known)
    before = keyed.manifest(spark, path).version
    assert keyed.merge(frame.filter("false"), path, ["id"], "seq", "kind") == [] and keyed.manifest(spark, path).version == before
    assert keyed.clean(spark, path, keep=1) > 0
    check(spark, path, known)
    with pytest.raises(ValueError):
        keyed.merge(frame, path, ["id"], "seq", "seq")


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.merge(spark.range(1000).select("id", F.lit(1).cast("long").alias("seq"), F.lit("a").alias("kind"), F.lit("x").alias("bucket")), path, ["id"], "seq", "kind", count=32)
    before = keyed.manifest(spark, path).folders["rows"]
    batch = spark.createDataFrame([(5, 2, "b", "y"), (2000, 1, "b", "y"), (6, 0, "late", "y")], SCHEMA)
    written = keyed.merge(batch, path, ["id"], "seq", "kind")
    after = keyed.manifest(spark, path).folders["rows"]
    assert 0 < len(written) <= 3 and {b for b in after if after[b] != before.get(b)} <= set(map(str, written))
    assert {r["kind"]: r["n"] for r in keyed.read_counts(spark, path).collect()} == {"a": 999, "b": 2}
    assert keyed.read(spark, path, version=0).filter("kind = 'b'").isEmpty()  # readers of the version before are not disturbed
    found = keyed.lookup(spark, path, spark.createDataFrame([(5,), (2000,), (7777,)], "id long"))
    assert sorted(r["kind"] for r in found.collect()) == ["b", "b"] and len(found.inputFiles()) <= 3


def test_a_batch_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first, second = ([(i, s, k, "x") for i in range(20)] for s, k in ((1, "a"), (2, "b")))
    keyed.merge(spark.createDataFrame(first, SCHEMA), path, ["id"], "seq", "kind", count=4)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", fail)
        with pytest.raises(OSError):
            keyed.merge(spark.createDataFrame(second, SCHEMA), path, ["id"], "seq", "kind")
    check(spark, path, state(first, {}))
    keyed.merge(spark.createDataFrame(second, SCHEMA), path, ["id"], "seq", "kind")
    check(spark, path, state(second, {}))
    stale = keyed.manifest(spark, path)
    with pytest.raises(OSError, match="another writer"):
        keyed._commit(spark, path, stale)
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, str(tmp_path / "none"))

"""A word index against the expression on every text."""

import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewell.sources import keyed, search

TEXTS = {1: "The Café in the park", 2: "in theory", 3: "within the hall", 4: None, 5: "", 6: "C++ in-the Rain", 7: "in  the", 8: "the in", 9: "IN THE END!! +++", 10: "a_b in the", None: "in the void"}
TERMS = ["in the", "cafe", "Café", "the", "c++", "+++", "nowhere", "in nowhere", "a_b", "end!!", "in-the"]


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def plain(texts, term):
    return {i for i, t in texts.items() if t is not None and re.search(rf"(?<!\w){re.escape(fold(term))}(?!\w)", fold(t))}


def test_index_equals_a_scan(spark, tmp_path):
    path, schema = str(tmp_path / "words"), "id long, seq long, text string"
    search.index(spark.createDataFrame([(i, 1, t) for i, t in TEXTS.items()], schema), path, count=4, spread=2)
    for term in TERMS:
        assert {r["id"] for r in search.find(spark, path, term).collect()} == plain(TEXTS, term) - {None}, term
    changed = {1: "gone", 8: "now in the light", 11: "nowhere"}
    search.index(spark.createDataFrame([(i, 2, t) for i, t in changed.items()] + [(2, 0, "in the past")], schema), path, count=4, spread=2)
    now = {i: t for i, t in (TEXTS | changed).items() if i is not None}
    for term in ("in the", "cafe", "nowhere"):
        assert {r["id"] for r in search.find(spark, path, term).collect()} == plain(now, term)


def test_a_search_reads_the_buckets_of_its_word(spark, tmp_path):
    path = str(tmp_path / "words")
    search.index(spark.createDataFrame([(i, 1, f"common word{i}") for i in range(200)], "id long, seq long, text string"), path, count=16, spread=2)
    found = search.find(spark, path, "common word7")
    assert [r["id"] for r in found.collect()] == [7]
    words = {f for f in found.inputFiles() if "/words/words/" in f or "/words/rows-" in f}
    assert 0 < len(words) <= 2 and keyed.counts_of(spark, f"{path}/words", ["common"]).collect()[0]["n"] == 200


def test_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "words")
    search.index(spark.createDataFrame([(1, 1, None)], "id long, seq long, text string"), path)
    assert search.find(spark, path, "any").collect() == []
    with pytest.raises(FileNotFoundError):
        search.find(spark, str(tmp_path / "none"), "any")


def test_a_batch_shuffles_lists_once_and_leaves_no_intermediates(spark, tmp_path, monkeypatch):
    """Postings of a second batch with common rows: a shuffle a table, of fewer bytes than one for each posting's row, and no words left in the shared folder."""
    path, plans, written = str(tmp_path / "words"), [], []
    make, place = keyed._merged, search.scratch
    monkeypatch.setattr(keyed, "_merged", lambda *a: plans.append(make(*a)) or plans[-1])
    monkeypatch.setattr(search, "scratch", lambda *a: written.append(place(*a)) or written[-1])
    rows = spark.range(3000).select("id", F.col("id").alias("seq"), F.concat(F.lit("a common text of words and word"), F.col("id") % 20).alias("text"))
    for left_out in (0, 1):
        search.index(rows.filter(F.col("id") % 3 != left_out), path, count=4, spread=2, keep=1)
    assert [p._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") for p in plans] == [1] * 4
    assert len(written) == 2 and not any(os.path.exists(w.removeprefix("file:")) for w in written)
    assert {r["n"] for r in keyed.counts_of(spark, f"{path}/words", ["common", "word7"]).collect()} == {3000, 150}
    assert keyed.read(spark, f"{path}/words").groupBy("word", "part", "id").count().filter("count > 1").isEmpty()
    assert len(os.listdir(f"{path}/words/_manifests")) <= 2 and sum(n.startswith("rows-") for n in os.listdir(f"{path}/words")) == 1
    assert search.find(spark, path, "word7").count() == 150


def test_rows_that_are_their_key_equal_a_set(spark, tmp_path):
    """Nulls, repeats and batches with common rows, listed a few rows at a time."""
    rng, path, known = random.Random(4), str(tmp_path / "t"), set()
    for _ in range(3):
        rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, -1, 2**31, 2**63 - 1, -(2**63), *range(30)])) for _ in range(80)]
        known |= set(rows)
        keyed.merge(spark.createDataFrame(rows, "word string, part int, id long"), path, ["word", "part", "id"], "id", "word", count=4, place=["word", "part"])
        assert sorted(map(tuple, keyed.read(spark, path).collect()), key=str) == sorted(known, key=str)
        assert {r["word"]: r["n"] for r in keyed.read_counts(spark, path).collect()} == {w: sum(k[0] == w for k in known) for w in {k[0] for k in known}}

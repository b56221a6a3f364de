"""Phrases with their places: counting, asides, conditions, vetoes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import classify, signals
from tidewell.functions.signals import Rules, Run, Signal


def read(spark, rows, rules=classify.RULES):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string")
    return [r["r"] for r in frame.select("i", signals.read(F.col("t"), F.col("d"), rules).alias("r")).orderBy("i").collect()]


def scores(row):
    return {s["category"]: s["score"] for s in row["scores"]}


def test_categories_by_place(spark):
    rows = [
        ("Open mic at the mill", "Poets, plus stand-up comedy"),
        ("Open mic at the mill", "Poets. Comedy welcome"),
        ("Movie marathon", None),
        ("Marathon", None),
        ("Learn more", None),
        ("Learn weaving", None),
        ("Haunted tour", "by lamp"),
        ("Odile's autumn tour", "by lamp"),
        ("Stroll", "an autumn tour"),
        ("Film festival", ""),
        (None, None),
        ("Run", "10.5K, then 5 k"),
    ]
    got = read(spark, rows)
    assert [scores(r) for r in got] == [{"music": 100}, {"music": 100, "comedy": 110}, {}, {"fitness": 100}, {}, {"visual-art": 70, "learning": 40}, {}, {"music": 70}, {}, {"film": 170, "festival": 100}, {}, {"fitness": 100}]


def test_facets_by_place(spark):
    rows = [
        ("Bar", "We cannot admit kids"),
        ("Bar", "We cannot admit dogs. Kids welcome"),
        ("Supper", "supports our local youth"),
        ("Youth supper", "supports our local youth"),
        ("Songs", "His three young children sing"),
        ("Songs", "Children sing"),
        ("Adult camp", ""),
        ("Art camp", ""),
    ]
    assert [r["family"] for r in read(spark, rows)] == [False, True, False, True, False, True, False, True]
    funds = [("Our fundraising campaign", ""), ("Fundraising dinner", ""), ("Fund-raising", "for roofs"), ("A toast", "proceeds go to nobody")]
    assert [r["fundraiser"] for r in read(spark, funds)] == [False, True, True, True]


def test_vetoes(spark):
    rows = [
        ("Kids walk", "Child abuse awareness; help prevent child abuse"),
        ("Kids walk", "They talk of child abuse"),
        ("Kids walk", "Child abuse. Awareness is another sentence"),
        ("Kids talk", "He drowned the 3-year-old child"),
        ("Kids talk", "He drowned in work while children sang"),
        ("Kids talk", "A murder; the neighbour was arrested"),
        ("Kids murder mystery", "A murder; the neighbour was arrested"),
        ("Kids murder", "nobody knows"),
        ("Talk", "A murder; the neighbour was arrested"),
    ]
    got = read(spark, rows)
    assert [r["rule"] for r in got] == [None, "child-harm", "child-harm", "child-harm", None, "serious-harm", None, None, "serious-harm"]
    assert [r["family"] for r in got] == [r["rule"] is None for r in got[:-1]] + [False]
    assert [r["suppressed"] for r in got] == [r["rule"] is not None for r in got[:-1]] + [False]
    assert got[5]["terms"] == ["murder", "arrested"]


def test_phrases():
    assert signals.expand("{a,b c,} d") == ["a d", "b c d", "d"] and signals.expand("x{y,{z,w}}") == ["xy", "xz", "xw"]
    with pytest.raises(ValueError):
        signals.Finder([("Upper",)])


def test_every_place_like_a_plain_search():
    draw = random.Random(5)
    words = "a ab abc b bc c".split()
    for _ in range(200):
        phrases = tuple({" ".join(draw.choices(words, k=draw.randint(1, 3))) + draw.choice(["", "", "*"]) for _ in range(6)})
        text = " " + " ".join(draw.choices([*words, "."], k=draw.randint(0, 30))) + " "
        found = signals.Finder([phrases]).find(text).get(0, [])
        plain = {}
        for p in phrases:
            pattern = f"(?<= )(?=({re.escape(p[:-1])}[^ ]*|{re.escape(p)}) )" if p.endswith("*") else f"(?<= )(?=({re.escape(p)}) )"
            for m in re.finditer(pattern, text):
                plain[m.start()] = max(plain.get(m.start(), 0), m.end(1))
        assert found == sorted(plain.items())


def test_runs_like_a_plain_search():
    draw = random.Random(6)
    for _ in range(300):
        run = Run(("o",), ("c",), gap=draw.choice([None, 4]), fillers=draw.choice([None, ("f",)]), to_end=draw.choice([0, 3, 99]))
        reader = signals.Reader(Rules((), (("g", run),)))
        text = " " + " ".join(draw.choices("ocfx.", k=draw.randint(0, 20))) + " "
        said = signals.Said(text, reader.finder.find(text), [m.start() for m in signals.STOPS.finditer(text)])
        plain, at = [], 1
        while at < len(text):
            made = None
            if text[at] == "o":
                close = text.find("c", at + 1)
                between = text[at + 1 : close]
                if close > 0 and "." not in between and (run.gap is None or len(between) <= run.gap) and (run.fillers is None or set(between) <= {"f", " "} and between.count("f") <= 3):
                    end = close + 1
                    if run.to_end:
                        stop = text.find(" . ", end)
                        end = min(stop if stop >= 0 else len(text) - 1, end + run.to_end)
                    made = (at, end)
            if made:
                plain.append(made)
            at = made[1] if made else at + 1
        assert reader.run_places(said, run) == plain


def test_cost_grows_with_text_not_phrases(spark):
    long = "plus open mic and comedy to the kids murder child abuse awareness " * 20_000
    many = Rules(tuple(Signal("c", 1, (f"{a}{b} word",)) for a in "abcdefghij" for b in "klmnopqrst"), classify.ASIDES)
    assert scores(read(spark, [("x", long)])[0])["music"] == 100
    assert scores(read(spark, [("ak word", long)], many)[0]) == {"c": 1}


def test_only_signals_with_a_phrase_are_tested(monkeypatch):
    """A text is tested for the signals whose phrases are in it, not for all."""
    reader, tested, counts = signals.Reader(classify.RULES), [], signals.Reader.counts
    monkeypatch.setattr(signals.Reader, "counts", lambda self, signal, *rest: tested.append(signal) or counts(self, signal, *rest))
    assert reader.read(" jazz brunch large ring ", 13)["scores"] == [{"category": "music", "score": 40}, {"category": "food", "score": 100}]
    assert len(tested) == 2 < len(classify.SIGNALS)
    assert reader.read(" large ring ", 7) == {"scores": [], "family": False, "fundraiser": False, "rule": None, "terms": [], "suppressed": False}


def test_rows_of_a_small_file_are_dealt_out(spark, sf_dir):
    from tidewell.queries import QUERIES

    assert QUERIES["category_scores"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

"""The corpus pipeline from end to end on planted cases, and its stages on hard rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, texts, items=(), labels=(), extra=()):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *extra], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def through(spark, docs, sf_dir, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = stage(spark, docs, sf_dir)
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture
def words():
    r = random.Random(5)
    return lambda n: " ".join(f"{r.choice('bcdfgk')}{r.choice('aeiou')}{r.randrange(10**6)}" for _ in range(n))


def test_planted_cases(spark, tmp_path, words):
    base, line = words(200), words(12)
    edited = base.split()
    edited[50] = "edited"
    passage = words(14)
    texts = [
        base,  # 0: the first of its copies
        base.upper().lower(),  # 1: an exact copy
        " ".join(edited),  # 2: a near copy
        f"{line}\n{words(80)}",  # 3: the first to have the line
        f"{words(80)}\n{line}",  # 4: loses it
        f"{words(60)} {passage} {words(60)}",  # 5: holds a benchmark item
        f"{words(40)} {words(20)}",  # 6: clean
        words(20),  # 7: too short
        "the same words " * 60,  # 8: repeats itself
        None,
        "",
        words(70),
    ]
    docs = tables(spark, tmp_path, texts, [passage, words(30)])
    assert set(through(spark, docs, str(tmp_path), 1)) == {0, 1, 2, 3, 4, 5, 6, 11}
    lines = through(spark, docs, str(tmp_path), 2)
    assert set(lines) == {0, 2, 3, 4, 5, 6, 11} and lines[4]["text"] == texts[4].split("\n")[0] and lines[4]["n_chars"] == len(lines[4]["text"])
    near = through(spark, docs, str(tmp_path), 3)
    assert set(near) == {0, 3, 4, 5, 6, 11}
    clean = through(spark, docs, str(tmp_path), 4)
    assert set(clean) == set(near) and passage not in clean[5]["text"] and all(clean[i]["text"] == near[i]["text"] for i in near if i != 5)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(clean)
    for i, r in out.items():
        assert r["size"] == len(clean[i]["text"].split()) and r["taken"] <= 2 * r["size"]


def test_stages_keep_columns_whatever_they_are_called(spark, tmp_path, words):
    docs = tables(spark, tmp_path, [words(80) for _ in range(5)], [words(12)])
    names = ["fp", "hits", "kept", "n_words", "ld_text", "near_key", "copies", "d", "line", "k_d", "k_null", "k_r", "text_bytes", "__bytes", "m_id", "m_hash"]
    wide = docs.withColumns({n: F.lit("clash") for n in names})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        wide = stage(spark, wide, str(tmp_path))
        assert wide.columns == [*COLUMNS, *names] and wide.count() == 5, i
    assert corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).count() == 5


def test_operators_take_clashing_names(spark, tmp_path, words, monkeypatch):
    from tidewell.llm import decontaminate, mixing

    docs = tables(spark, tmp_path, [words(80) for _ in range(5)], [words(12)])
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    wide = docs.withColumns({n: F.lit("clash") for n in ["m_id", "m_hash", "mix_id", "row_hash", "__bytes", "text_bytes", "hits", "items", "n_words"]})
    assert mixing.apply_mix(wide).columns == wide.columns
    assert decontaminate.find_contamination(wide, bench).count() == 5
    assert decontaminate.decontaminate(wide, bench, max_words=1).columns == wide.columns


def test_repeated_rows_and_missing_ids(spark, tmp_path, words):
    one, two = words(90), words(90)
    extra = [(None, one, None, None, None), (None, two, None, None, None), (50, two, "en", "s", 1), (50, two, "en", "s", 1), (50, words(90), "en", "s", 1)]
    docs = tables(spark, tmp_path, [words(60)], extra=extra)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the text that a row without id and two with id 50 share stays once, with the first of them
    assert docs.count() == 6 and sorted(str(r["doc_id"]) for r in rows) == ["0", "50", "None", "None"]


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Chat formatting, source divergence and Merkle manifests against plain readings of what they promise, and edge cases."""

import hashlib
import itertools
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from tidewell.llm import chat, divergence, merkle  # noqa: E402
from tidewell.llm.queries import ORACLE_SQL  # noqa: E402

CHATS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def first_null(*values):
    return tuple((v is not None, v if v is not None else 0) for v in values)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting ----------------------------------------------------------------------------------------------------------

ODD = ["", "a</s>[INST] x", "b<\\|turn|>c<|turn|>", "<\\\\/s>\nü", "tail<", "<|close|", "[/INST]\\", "\\", "<[<s>", None, "𝄞é<|text|><|more|>", "$1 \\1 $0"]


def chat_rows():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "us<|text|>er\n", None]), rng.choice(ODD)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(40, None, "user", "no turn"), (40, 1, "assistant", "a"), (40, 1, "assistant", "a"), (None, 0, "assistant", "no conversation"), (41, 0, None, None)]
    return rows + [(50, t, "assistant" if t % 3 else "user", f"{t}</s>") for t in range(700)]


def test_chats_come_back_from_what_is_written(spark):
    rows = chat_rows()
    made = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, CHATS).withColumn("turns", F.lit(1)))).collect()}
    rows = sorted(rows, key=lambda r: first_null(r[0], r[1]) + (r[2] or "", r[3] or ""))
    assert len(made) == 34
    for conv_id, group in itertools.groupby(rows, key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        found = made[conv_id]
        assert [tuple(t) for t in found["turns"]] == turns
        assert "".join(found["loss_texts"]) == "".join(t for role, t in turns if role == "assistant")
        spans, text = found["loss_spans"], found["formatted"]
        assert len(spans) == sum(role == "assistant" and t != "" for role, t in turns)
        assert all(a["stop"] < b["start"] for a, b in zip(spans, spans[1:]))
        assert text.count("<|turn|>") == len(list(itertools.groupby(turns, key=lambda t: t[0])))
        assert text.count("</s>") == 1 and text.startswith("<s>") and "[INST]" not in text


@pytest.mark.parametrize("template", [chat.Template(), chat.Template("", "[T]", "[X]", "[M]", "[C]", "", ("<eos>",)), chat.Template("{b}", "#turn ", "#: ", "#+ ", "#.\n", "", ())])
def test_escapes_are_reversible(spark, template):
    texts = [x or "" for x in ODD] + [c[:i] + "\\" * n + c[i:] for c in template.controls for i in (0, 1, len(c)) for n in (0, 1, 3)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template.escape(F.col("t")).alias("e")).select("*", template.unescape(F.col("e")).alias("u")).collect()
    assert all(r["t"] == r["u"] and not any(c in r["e"] for c in template.controls) for r in rows)


@pytest.mark.parametrize("marks", [{"turn": "<a", "guarded": ("<ab",)}, {"turn": "<<t"}, {"close": "<\\c"}, {"more": "<|text|>"}])
def test_ambiguous_templates_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(**marks)


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 4)
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 4, 5, 17)], "v array<bigint>").select("v", chat.running_sums(F.col("v")).alias("s")).collect()
    assert all(r["s"] == list(itertools.accumulate(r["v"])) for r in rows)


def test_chats_of_empty_and_long(spark):
    assert chat.chat_report(spark.createDataFrame([], CHATS)).collect() == []
    long = "wörter </s> " * 100_000
    row = chat.chat_report(spark.createDataFrame([(1, 0, "assistant", long)], CHATS)).first()
    assert row["loss_chars"] == len(long) and row["loss_sha256"] == sha(long)


# Source divergence --------------------------------------------------------------------------------------------------------


def against_sql(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    with duckdb.connect() as con:
        con.register("documents", frame.toPandas())
        want = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({ORACLE_SQL['op12_source_divergence']})").fetchall()
    clashing = frame.withColumn("term", F.lit("x")).withColumn("n", F.lit("y")).withColumn("docs", F.lit(None))
    assert sorted(tuple(r) for r in divergence.audit(clashing).select("lang", "source", "part", "item", "value", "rank").collect()) == sorted(want)
    return want


def test_divergence_with_nulls_ties_and_empty_groups(spark):
    rng = random.Random(3)
    words = ["a", "B", "b", "é", "É", "zz", "日", "x1y", "10", "it's"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))) if i % 13 else None, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, "ß"]), 1) for i in range(300)]
    rows += [(1, "only here", "fr", "alone", 1), (1, None, "xx", "q", 1), (1, "", "xx", "r", 1)] + [(2, "same row", "en", "s1", 8)] * 12
    found = against_sql(spark, rows)
    assert ("xx", "q", "pair", "r", 0, 1) in found
    assert not [r for r in found if r[0] == "fr"]


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_terms_of_long_texts_and_handed_on_counts(spark, monkeypatch):
    text = "Abéc 12 x'y  Z\n" * 3000
    plain = Counter(t for t in __import__("re").findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))
    monkeypatch.setattr(divergence, "PIECE", 101)
    assert Counter(t.decode() for piece in divergence.terms(text.encode()) for t in piece) == plain
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    texts = ["a b c a", "d e f", None, "a g h i j", "a a"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(["s", "t", "s", "s", "t"]), pa.array([t.encode() if t else None for t in texts], pa.binary())], names=["lang", "source", "text"])
    n, docs, batches = Counter(), Counter(), 0
    for out in divergence._counted(iter([batch])):
        batches += 1
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert batches > 1 and n["s", "a"] == 3 and docs["s", "a"] == 2 and n["t", "a"] == 2 and docs["t", "a"] == 1 and n["s", ""] == 0


@pytest.mark.parametrize(("slack", "top"), [(0, 7), (3, 1), (10_000, 5)])
def test_radix_ranks_equal_a_full_sort(spark, slack, top):
    rng = random.Random(top)
    rows = [(None if i % 5 == 0 else i % 5, rng.choice([0, 1, 5, 5, 5, 2047, 2048, 2**40]), rng.choice(["", "a", "ab", "abc", "é", None, "b"]), i) for i in range(400)] + [(9, 3, "same", i) for i in range(40)]
    frame = spark.createDataFrame(rows, "g long, v long, item string, digit long")
    got = divergence.radix_top(frame, ["g"], "v", "item", top, slack=slack, value_bits=41).collect()
    want = []
    for g in {r[0] for r in rows}:
        order = sorted((-r[1], (r[2] or "").encode()) for r in rows if r[0] == g)[:top]
        want += [first_null(g) + (rank, -v, item) for rank, (v, item) in enumerate(order, 1)]
    assert sorted(first_null(r["g"]) + (r["rank"], r["v"], (r["item"] or "").encode()) for r in got) == sorted(want)
    assert {r["digit"] for r in got} <= {r[3] for r in rows} and len({r["digit"] for r in got if r["g"] != 9}) == len([r for r in got if r["g"] != 9])


# Merkle manifest ----------------------------------------------------------------------------------------------------------


def leaf_of(d):
    return sha("".join("-" if d[k] is None else f"{len(str(d[k]).encode())}:{d[k]}" for k in merkle.FIELDS))


def tree_of(hashes):
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 16 * 16 : place // 16 * 16 + 16]
            steps[i].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        at = [place // 16 for place in at]
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], steps


def proofs_of(rows):
    by_source = {}
    for d in rows:
        by_source.setdefault(d["source"], []).append(d)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda d: (*first_null(d["doc_id"]), leaf_of(d)))
        trees[s] = tree_of([leaf_of(d) for d in by_source[s]])
    root, tops = tree_of([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for d, own in zip(by_source[s], trees[s][1], strict=True):
            seen = dict(d)
            if d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0:
                seen["text"] = d["text"].translate({c: c + 32 for c in range(65, 91)})
            folded = leaf_of(seen)
            for left, right in own + top:
                folded = sha(left + folded + right)
            out.append((d["doc_id"], leaf_of(d), trees[s][0], root, sha("".join(a + b for a, b in own + top)), folded, folded == root))
    return out


def test_proofs_equal_brute_force(spark):
    rows = [(i if i % 7 else None, "Text %d" % (i % 50) if i % 11 else None, "x" if i % 3 else None, None if i % 5 == 0 else ["s", "", "ß"][i % 3], i) for i in range(900)]
    rows += [(1, "One", "A", "alone", 3)] + [(2, "Copy", "A", "copies", 4)] * 20 + [(3, "N" * 300_000, None, "long", None)] + [(i, "T", None, f"many{i}", 1) for i in range(30)]
    frame = spark.createDataFrame(rows, DOCS)
    clashing = frame.select("*", *(F.lit("x").alias(c) for c in ("tree", "hash", "idx", "n", "root", "steps", "seen")))
    order = lambda r: (*first_null(r[0]), *r[1:])
    got = sorted((tuple(r) for r in merkle.proof_report(clashing).collect()), key=order)
    assert got == sorted(proofs_of([r.asDict() for r in frame.collect()]), key=order)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    assert merkle.proof_report(spark.createDataFrame([], DOCS)).collect() == []
    row = merkle.proof_report(spark.createDataFrame([(None, None, None, None, None)], DOCS)).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == sha("-----") and row["proof_sha256"] == sha("") and row["verified"]


def test_places_in_a_hot_tree(spark):
    rows = [("hot", i // 3, "h") for i in range(900)] + [("=b", 1, "h"), ("-", 5, "h"), ("-", 2, "h")]
    got = merkle.ranked(spark.createDataFrame(rows, "tree string, v long, hash string").repartition(7), "v").collect()
    for tree, count in (("hot", 900), ("=b", 1), ("-", 2)):
        own = sorted((r["idx"], r["v"]) for r in got if r["tree"] == tree)
        assert [i for i, _ in own] == list(range(count)) and [v for _, v in own] == sorted(v for _, v in own) and {r["n"] for r in got if r["tree"] == tree} == {count}

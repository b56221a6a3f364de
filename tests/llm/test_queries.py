"""Each registered query against its SQL, or against a plain reading of its contract over the same whole table."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import test_operators as plainly  # noqa: E402
from test_oracles import duck, plain  # noqa: E402, F401

from tidewell.llm import chaining, html_extract, quality  # noqa: E402
from tidewell.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):  # noqa: F811
    answer = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    expected = sorted(tuple(plain(v) for v in r) for r in answer.fetchall())
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == expected


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def rows_of(spark, sf_dir, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}


def test_mix_comes_near_its_targets(spark, sf_dir):
    rows = QUERIES["op1_pareto_mix"](spark, sf_dir).collect()
    taken, target, longest = Counter(), {}, Counter()
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in target.items())


def test_quality_verdicts_follow_the_learned_list(spark, sf_dir, documents):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    rows = rows_of(spark, sf_dir, "op2_quality_rules")
    for doc_id, text in documents:
        c = dict(zip(quality.COUNTS, quality.counts((text or "").encode()), strict=True))
        per = lambda a, b: c[a] / c[b] if c[b] else 0.0
        x = {
            "words": float(c["n_words"]), "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_lines_per_line": per("n_dup_lines", "n_lines"),
            "repeat_words_per_word": per("n_repeat_words", "n_words"), "words_per_line": per("n_words", "n_lines"), "upper_per_char": per("n_upper", "word_chars"), "digits_per_char": per("n_digits", "word_chars"),
            "marks_per_word": per("n_marks", "n_words"), "shouts_per_word": per("n_shouts", "n_words"), "echoes_per_word": per("n_echoes", "n_words"), "distinct_per_word": per("n_distinct", "n_words"),
        }
        rejected = any(all(x[k.feature] > k.threshold if k.above else x[k.feature] <= k.threshold for k in rule) for rule in rules.rules)
        assert rows[doc_id]["kept"] == (not rows[doc_id]["base_failed"] and not rejected)


def test_page_texts(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op4_tag_path_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == html_extract.main_text(pages[r["page_id"]] or "") and r["n_chars"] == len(r["text"])


def test_lines(spark, sf_dir, documents):
    import hashlib

    # lines of the whole table, in the order of doc_id; ids are unique here
    expected = plainly.brute_lines([t for _, t in documents])
    rows = rows_of(spark, sf_dir, "op5_line_dedup")
    for i, (doc_id, _) in enumerate(documents):
        n, kept, text = expected[i]
        assert (rows[doc_id]["n_lines"], rows[doc_id]["n_kept"], rows[doc_id]["kept_sha256"]) == (n, kept, hashlib.sha256(text.encode()).hexdigest())


def test_tokens(spark, sf_dir, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = rows_of(spark, sf_dir, "op6_token_counts")
    for doc_id, text in documents:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (rows[doc_id]["n_tokens"], rows[doc_id]["n_bytes"], rows[doc_id]["over_limit"]) == (n, len((text or "").encode()), n > 512)


def test_fingerprints_and_components(spark, sf_dir, documents):
    fps = {d: plainly.brute_fingerprint(t) for d, t in documents}
    ids = list(fps)
    component = {d: d for d in ids}

    def find(d):
        while component[d] != d:
            d = component[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                component[y] = x
    for doc_id, r in rows_of(spark, sf_dir, "op7_simhash_vptree").items():
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[doc_id]:016x}", find(doc_id))


def test_passages(spark, sf_dir, documents):
    """Every run of 50 words that an earlier, different text has is found; a document with no run of 12 common words has none."""
    found = {}
    for r in QUERIES["op10_collinear_chains"](spark, sf_dir).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    long_, short = set(), set()
    for doc_id, text in documents:
        words = chaining.words((text or "").encode())
        inside = {j for a, b in found.get(doc_id, []) for j in range(a, b)}
        runs = {k: tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        assert {j for k, run in runs.items() if run in long_ for j in range(k, k + 50)} <= inside
        few = {tuple(words[k : k + 6]) for k in range(len(words) - 5)}
        assert few & short or not inside
        long_ |= set(runs.values())
        short |= few


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_long_texts(spark, sf_dir, tmp_path):
    """A text of 5 MB among others, and one that repeats it, in each query over documents."""
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600_000)), lambda i: F.when(i % 40 == 0, F.lit("\n")).otherwise(F.hex(F.xxhash64(i) % 16_777_216))), " ")
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, long).otherwise(F.lit("a few words")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: rows_of(spark, str(tmp_path), n) for n in QUERIES if n.startswith("op") and n not in ("op4_tag_path_text", "op8_warc_shards")}
    assert {len(r) for n, r in got.items() if n != "op10_collinear_chains"} == {4} and set(got["op10_collinear_chains"]) == {1}
    assert got["op7_simhash_vptree"][1]["component_id"] == 0 and got["op5_line_dedup"][1]["n_kept"] == 0

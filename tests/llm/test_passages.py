"""Substring dedup: chains, alignment and whole searches against brute force, with hot groups, repeats and long texts."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chaining

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def found_in(docs):
    found = defaultdict(list)
    for row in chaining.repeated_passages(docs).collect():
        found[row["doc_id"]].append((row["start"], row["stop"], row["sources"]))
    return {k: sorted(v) for k, v in found.items()}


def covered(spans):
    return {i for a, b, _ in spans for i in range(a, b)}


def test_passages_are_found_and_clean_texts_left(spark):
    r = random.Random(11)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    passage = fresh(70)
    edited = passage.copy()
    for i in (20, 41, 60):
        edited[i] = "changed"
    edited.insert(30, "added")
    texts = [
        " ".join(fresh(50) + passage + fresh(50)), " ".join(fresh(90) + passage + fresh(10)), " ".join(fresh(10) + edited + fresh(80)), " ".join(fresh(300)), " ".join(fresh(30) + passage[:30] + fresh(60)),
        " ".join(fresh(60) + [w.upper() for w in passage]), None, "", "x " * 400, " ".join(passage),
    ]
    texts += [texts[3], texts[3]]
    docs = docs_of(spark, texts).withColumn("start", F.lit(0))
    found = found_in(docs)
    assert set(found) == {1, 2, 5, 9, 10, 11}
    assert found[1] == [(90, 160, [0])] and found[5] == [(60, 130, [0])] and found[9] == [(0, 70, [0])]
    assert found[10] == found[11] == [(0, 300, [3])] and found[2][0][0] == 10 and found[2][0][1] == 81
    cut = {x["doc_id"]: x["text"] for x in chaining.drop_passages(docs).collect()}
    assert set(cut) == {0, 1, 2, 3, 4, 5, 6, 7, 8} and cut[3] == texts[3] and passage[35] not in cut[1] and cut[0] == texts[0]
    assert chaining.repeated_passages(docs.limit(0)).count() == 0


def test_chains_are_optimal():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 12)
        a, b = np.sort([r.randrange(40) for _ in range(n)]), np.array([r.randrange(40) for _ in range(n)])
        score = {}
        for i in sorted(range(n), key=lambda i: (a[i], -b[i])):
            before = [score[j] - chaining.GAP_COST * (a[i] - a[j] + b[i] - b[j]) for j in score if a[j] < a[i] and b[j] < b[i]]
            score[i] = chaining.K + max([0, *before])
        best = max(score.values())
        ends = {(a[c[-1]], b[c[-1]]) for c in chaining.chains(a, b)}
        assert any((a[i], b[i]) in ends and abs(s - best) < 1e-9 for i, s in score.items())


def test_common_places():
    r = random.Random(4)
    for _ in range(200):
        x, y = ([r.randrange(5) for _ in range(r.randrange(25))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        common = sorted(chaining._common(x, y))
        rest = iter(y)
        assert len(common) == table[-1][-1] and all(v in rest for v in (x[i] for i in common))


def test_turns():
    assert chaining.turns(np.array([5, 3, 5, 5, 3], np.uint64)).tolist() == [0, 0, 1, 2, 1] and not len(chaining.turns(np.zeros(0, np.uint64)))


def test_alignment_marks_equal_partners_in_order():
    r = random.Random(8)
    for _ in range(100):
        y = np.array([r.randrange(1 << 30) for _ in range(200)], np.uint32)
        x = edited(r, y.tolist(), 9)
        where = {v: i for i, v in enumerate(y.tolist())}
        a = np.array([i for i in range(len(x) - 5) if all(x[i + k] in where and where[x[i + k]] == where[x[i]] + k for k in range(6))])
        if not len(a):
            continue
        b = np.array([where[x[i]] for i in a])
        hit = chaining.aligned(np.array(x, np.uint32), y, *chaining.runs(a, b))
        want, got = {i for i, v in enumerate(x) if v in where}, set(np.flatnonzero(hit).tolist())
        assert got <= want and len(got) >= 0.9 * len(want)


def edited(r, words, every):
    """One edit in each ``every`` words: a word changed, added or left out."""
    out = []
    for at in range(0, len(words), every):
        part = list(words[at : at + every])
        i, kind = r.randrange(len(part)), r.randrange(3)
        if kind == 0:
            part[i] = r.randrange(1 << 30, 1 << 31)
        elif kind == 1:
            part.insert(i, r.randrange(1 << 30, 1 << 31))
        else:
            part.pop(i)
        out += part
    return out


def test_verbatim_passages_against_brute_force(spark):
    """Every run of 50 or more words that any earlier text has is covered; beyond its ends only what agrees by chance."""
    r = random.Random(21)
    vocabulary = [f"v{i}" for i in range(2000)]
    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    pool = [fresh(r.randrange(30, 120)) for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = [x for _ in range(r.randrange(4)) for x in (fresh(r.randrange(60)), r.choice(pool))]
        texts.append([w for p in [*parts, fresh(r.randrange(1, 80))] for w in p])
    seen, want = set(), {}
    for i, t in enumerate(texts):
        own = {tuple(t[k : k + 50]): k for k in range(len(t) - 49)}
        want[i] = {k + j for k in range(len(t) - 49) if tuple(t[k : k + 50]) in seen for j in range(50)}
        seen |= set(own)
    found = found_in(docs_of(spark, [" ".join(t) for t in texts]))
    for i, w in want.items():
        got = covered(found.get(i, []))
        assert w <= got
        assert len(got - w) <= 30 * len(found.get(i, []))


@pytest.mark.parametrize(("every", "least"), [(10, 0.95), (7, 0.8)])
def test_fuzzy_passages(spark, every, least):
    r = random.Random(every)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(80) for _ in range(60)]
    texts = [" ".join([*fresh(40), *p, *fresh(40)]) for p in passages]
    texts += [" ".join(map(str, [*fresh(30), *edited(r, p, every), *fresh(30)])) for p in passages]
    found = found_in(docs_of(spark, texts))
    assert set(found) <= set(range(60, 120)) and len(found) >= least * 60


def test_a_seed_repeated_in_its_hub(spark):
    r = random.Random(31)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    head, tail = fresh(30), fresh(30)
    texts = [[*fresh(20), *head, *fresh(40), *head, *tail, *fresh(9)], [*fresh(15), *head, *tail, *fresh(15)]]
    assert covered(found_in(docs_of(spark, [" ".join(t) for t in texts]))[1]) == set(range(15, 75))


def test_a_large_group_of_near_copies_and_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(chaining, "TILE", 16)  # many tiles a hub
    r = random.Random(41)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    base, hot = fresh(120), fresh(60)
    near = [[*base[:i], f"changed{i}", *base[i + 1 :]] for i in range(100)]
    with_hot = [[*fresh(30), *hot, *fresh(20)] for _ in range(100)]
    found = found_in(docs_of(spark, [" ".join(t) for t in [*near, *with_hot]]))
    assert set(found) == set(range(1, 100)) | set(range(101, 200))
    assert all(len(covered(found[i])) >= 110 for i in range(1, 100))
    assert all(covered(found[i]) == set(range(30, 90)) for i in range(101, 200))


def test_repeated_rows_shared_ids_and_clashes(spark):
    r = random.Random(51)
    fresh = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    one, two, other = fresh(80), fresh(80), fresh(90)
    rows = [(1, one), (1, one), (1, two), (2, two), (3, f"{fresh(10)} {one}"), (None, one), (4, other), (4, other), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("d", "hub", "start", "cut_spans", "text_hash", "c_d")})
    assert found_in(docs) == {2: [(0, 80, [1])], 3: [(10, 90, [1])]}
    left = chaining.drop_passages(docs)
    assert left.columns == docs.columns and left.count() == 8


def test_a_long_text(spark):
    r = random.Random(61)
    long = " ".join(f"u{r.randrange(10**9)}" for _ in range(400_000))
    found = found_in(docs_of(spark, [long, f"{long} tail", "word " * 300_000]))
    assert set(found) == {1} and covered(found[1]) >= set(range(399_990))

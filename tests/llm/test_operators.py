"""The training-text operators against brute force, and on nulls, empty and long texts, ties, repeats, clashes and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, html_extract, line_dedup, mixing, pii, quality, simhash, token_counts, warc
from tidewell.llm.common import materialize
from tidewell.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, source=lambda i: f"s{i % 3}"):
    rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of", "naïve", "日本", "x!"]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 160))) for _ in range(120)]
    out += [out[0], out[1] + " tail", out[2].replace("w", "W"), None, "", " \n\t ", "word " * 3000, "a\nb\na\n\nb", "x"]
    for i in range(20):  # near copies
        words = out[5].split()
        words[i % len(words)] = f"edit{i}"
        out.append(" ".join(words))
    out += ["\n".join(["A common line of some length here", out[7], f"line {i}"]) for i in range(6)]
    return out


# mixing ---------------------------------------------------------------------------------------------------------------------


def test_targets_stop_at_the_cap_and_share_the_rest():
    rows = mixing.source_targets([("b", 100), (None, 50), ("a", 10), ("é", 1000)])
    assert [r[0] for r in rows] == ["a", "b", "é", None]
    target = {r[0]: r[2] for r in rows}
    assert target["a"] == 20 and target["b"] == 200 and target[None] == 100
    assert sum(target.values()) == pytest.approx(1.5 * 1160)
    assert all(t <= 2 * s + 1e-9 for _, s, t in rows)
    assert mixing.source_targets([]) == [] and mixing.source_targets([("a", 0)])[0][2] == 0


def test_mix_meets_targets_and_repeats(spark, texts):
    docs = docs_of(spark, texts * 4, lambda i: None if i % 7 == 0 else f"s{i % 3}").withColumn("copies", F.lit("clash"))
    first = sorted(mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect(), key=str)
    assert first == sorted(mixing.mix(docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect(), key=str)
    assert len(first) == 4 * len(texts)
    taken, target = Counter(), {}
    for r in first:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in first))


def test_mix_applies_and_takes_empty_tables(spark, texts):
    docs = docs_of(spark, texts + texts[:1])
    counts = mixing.mix(docs).agg(F.sum("copies").alias("n")).first()["n"]
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == counts
    same = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 4, DOCS)
    assert mixing.apply_mix(same).count() == mixing.mix(same).agg(F.sum("copies")).first()[0] == 6
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_weights_change_inclusion(spark):
    docs = docs_of(spark, ["a b c d"] * 400, lambda i: f"s{i % 2}").withColumn("q", F.when(F.col("doc_id") < 200, 1.0).otherwise(0.2))
    rows = mixing.mix(docs, weights=(1, 1), total=0.4, weight=F.col("q")).collect()
    heavy, light = sum(r["copies"] for r in rows if r["doc_id"] < 200), sum(r["copies"] for r in rows if r["doc_id"] >= 200)
    assert heavy > 3 * light and sum(r["taken"] for r in rows) == pytest.approx(0.4 * 1600, abs=8)


def test_mix_of_one_row_repeated(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 7)
    rows = [(1, "a b c", "x")] * 500 + [(i, "d e f g", "x") for i in range(2, 200)] + [(i, "h i", "y") for i in range(300, 900)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, len(t.split())) for d, t, _ in rows)
    taken, target = Counter(), {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 2 for s, t in target.items())


# quality --------------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_equal_brute_force(texts):
    for t in [*texts, "a b c a b c", "a a a a", "é|é é|é\n\né|é", "\x1ca\x85b\xa0c d"]:
        got = quality.counts((t or "").encode())
        expected = brute_counts(t)
        assert got[:5] == expected if expected[0] else got == (0,) * len(quality.COUNTS)


def test_rules_are_learned_and_applied(spark):
    r = random.Random(3)
    good = [" ".join(f"v{r.randrange(4000)}." for _ in range(80)) for _ in range(300)]
    bad = [" ".join(f"v{r.randrange(4000)}###" for _ in range(80)) for _ in range(100)]
    docs = docs_of(spark, good + bad + ["short", None]).withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, 1 if i < 300 else 0, 0) for i in range(400) if i % 2], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert rules.rules and all("reject" in line for line in rules.describe())
    judged, names = quality.judge(docs, rules)
    kept = {row["doc_id"]: row[names["kept"]] for row in judged.collect()}
    assert names["kept"] == "_kept" and all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 402))
    assert quality.filter_quality(docs, labels).columns == docs.columns
    nothing = quality.fit(docs, labels.limit(0))
    assert nothing.rules == [] and quality.judge(docs.limit(0), nothing)[0].count() == 0


# personal data ----------------------------------------------------------------------------------------------------------------

PII = [
    "mail a.b+c@x-y.example.org_d@e.fr, ip 1.2.3.4.5.6.7.8 and 999.1.1.1, 0001.2.3.255, card 4111 1111-1111 1111 or 4111111111111112, +1 (521) 555-6210 +12",
    "@a@b.c d@e.f@g.h 12--34 1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    None,
    "",
    "IBAN DE89370400440532013000 and DE89 3704 0044 0532 0130 00, bad DE89370400440532013001",
    "my ssn 123-45-6789;" + " " * 60 + "order 123-45-6789" + " " * 60 + "tel 330-555-1234",
    "é" * 50 + " 4111111111111111 日本 x@y.zz",
    "a" * 60000 + "@" + "b." * 20000 + "c " + "1" * 50000 + " " + "+" * 1000,
    "5 " * 40000,
]


def brute_pii(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), r, k, m.end()) for r, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_base_spans_equal_brute_force(spark):
    rows = pii.pii_report(docs_of(spark, PII)).collect()
    for r in rows:
        if len(PII[r["doc_id"]] or "") < 100_000:  # Python's own expression is quadratic there
            expected = brute_pii(PII[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
            assert set(filter(None, expected.split(","))) <= set(r["spans"].split(","))
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert spans[4].count("iban") == 2 and spans[5] == "ssn:7:18,local_phone:160:172"
    assert len(rows) == len(PII) and pii.pii_report(docs_of(spark, PII).limit(0)).count() == 0


def test_redaction_keeps_the_rest(spark):
    docs = docs_of(spark, ["write a@b.cc now", None, "nothing"]).withColumn("pii_spans", F.lit(0))
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs.select("doc_id", "text", "pii_spans")).collect()}
    assert out == {0: "write [email] now", 1: None, 2: "nothing"}


# HTML ------------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
<header><a href=/>Home</a> Site name</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-banner">We use cookies, many of them.</div>
<{0}><h1>A title</h1><p>First paragraph &amp; more, with <b>bold</b>text, and so on.<p>Second&nbsp;paragraph;
 it is long enough, really.<!-- gone <p>no</p> --><br>After break.<ul><li>item one, first</li><li>item two</ul></{1}>
<section id="comments"><p>Bob: nice, nice, nice, article.</p></section><aside>Related, links, here.</aside><form>Name <input></form><div class="ad">Buy, now, please.</div><footer>&copy; 2024, all rights.</footer></body></html>"""
TEXT = "A title First paragraph & more, with boldtext, and so on. Second paragraph; it is long enough, really. After break. item one, first item two"


@pytest.mark.parametrize("tag", ["article", "main", "div class=post"])
def test_main_text_is_the_article(tag):
    assert html_extract.main_text(PAGE.replace("{0}", tag).replace("{1}", tag.split()[0])) == TEXT


def test_html_edge_cases(spark):
    pages = ["", None, "plain, text", "a < b <", "<p>x", "<!-- open", "<script>never closed", "<p>" * 3000 + "deep, text.", '<div class="sidebar">only, this.</div>', "&#65;&eacute;&bogus;&#1114112;"]
    rows = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(rows).collect()}
    assert [out[i][0] for i in range(9)] == ["", "", "plain, text", "a < b <", "x", "", "", "deep, text.", "only, this."]
    assert out[9][0].startswith("Aé&bogus;") and all(len(t) == n for t, n in out.values())
    assert html_extract.extract(rows.limit(0)).count() == 0


# lines --------------------------------------------------------------------------------------------------------------------------


def brute_lines(texts):
    norm = lambda line: b" ".join(line.encode().split()).lower().decode()
    first = {}
    order = sorted((i, xxhash.xxh64_intdigest((t or "").encode(), 42), t) for i, t in enumerate(texts))
    for i, _, t in order:
        for k, line in enumerate((t or "").split("\n")):
            if s := norm(line):
                first.setdefault(s, (i, k))

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))

    gone = {s for s in first for o in first if len(s) >= 16 <= len(o) and first[o] < first[s] and abs(len(s) - len(o)) < 2 and near(s, o)}
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        keep = [line for k, line in enumerate(lines) if not norm(line) or (first[norm(line)] == (i, k) and norm(line) not in gone)]
        out[i] = (sum(bool(norm(x)) for x in lines), sum(bool(norm(x)) for x in keep), "\n".join(keep))
    return out


def test_lines_equal_brute_force(spark, texts):
    r = random.Random(1)
    base = ["".join(r.choice("abcé ") for _ in range(n)) for n in (15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 200)]
    lines = []
    for b in base:
        b = "x" + b.strip() + "y"
        for p in (0, len(b) // 2, len(b) - 1):
            lines += [b, b[:p] + "Z" + b[p + 1 :], b[:p] + b[p + 1 :], b[:p] + "q" + b[p:], b[:p] + "日本" + b[p + 1 :]]
    r.shuffle(lines)
    many = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)] + texts[-16:] + ["  A\tb \n\n", "a b", None, "", "one\n\ntwo\n"]
    expected = brute_lines(many)
    for row in line_dedup.line_report(docs_of(spark, many)).collect():
        n, kept, text = expected[row["doc_id"]]
        assert (row["n_lines"], row["n_kept"], row["kept_sha256"]) == (n, kept, hashlib.sha256(text.encode()).hexdigest()), many[row["doc_id"]]


def test_line_stage_keeps_columns_and_blanks(spark):
    docs = docs_of(spark, ["same line\nother", "same line", None, "", " \n", "same line\nthird\n"]).withColumn("ld_kept", F.lit(1))
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {0: ("same line\nother", 15), 2: (None, None), 3: ("", 0), 4: (" \n", 2), 5: ("third\n", 6)}
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(docs.limit(0)).count() == 0


# tokens ------------------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    hard = [*texts, "a<|endoftext|>b  c\n\n <|endoftext|>", "don't I'LL x  y   z\r\n ١٢٣ é́ 👩‍👩‍👧 \x01", "ab" * 20000, " " * 5000]
    out = {r["doc_id"]: r for r in token_counts.count_tokens(docs_of(spark, hard), path).collect()}
    for i, t in enumerate(hard):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    small = token_counts.TokenCounter(path)
    token_counts.REMEMBERED, kept = 50, token_counts.REMEMBERED
    try:
        assert [small.count(t or "") for t in hard] == [out[i]["n_tokens"] for i in range(len(hard))]
    finally:
        token_counts.REMEMBERED = kept


# SimHash ------------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[j : j + k]) for j in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_equal_brute_force(spark, texts):
    docs = docs_of(spark, texts).withColumn("fp", F.lit("clash"))
    fps = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    for spare in (None, 0, 1):
        for r in simhash.near_duplicates(docs, spare=spare).collect():
            assert (r["fp"] % (1 << 64), r["component_id"]) == (fps[r["doc_id"]], find(r["doc_id"]))
    kept = simhash.drop_near_duplicates(docs, shingle=4, similarity=None)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in range(len(texts))}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_shards_are_exact_in_any_shape(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    points = [int(b) ^ sum({1 << int(k) for k in r.integers(0, 64, r.integers(0, 5))}) for b in base for _ in range(40)]
    p = np.unique(np.array([*points, 0, 2**64 - 1, *r.integers(0, 2**63, 900).tolist()], np.uint64))
    forest = simhash.Forest(len(p))
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i] ^ p) <= 4).tolist():
            forest.join(i, j)
    expected = forest.roots(np.arange(len(p)))
    assert (simhash.link_shard(p, 4) == expected).all()
    # tiles and bands give the same components
    frame = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    links = simhash.hamming_links(frame, 4, tile=64)
    found = {row["node"]: row["component"] for row in connected_components(links).collect()}
    groups, mine = defaultdict(set), defaultdict(set)
    for i, x in enumerate(p.view(np.int64).tolist()):
        groups[expected[i]].add(x)
        mine[found.get(x, x)].add(x)
    assert set(map(frozenset, groups.values())) == set(map(frozenset, mine.values()))


def test_triangle_bounds_spare_distances():
    r = np.random.default_rng(6)
    centres = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = lambda n: np.array([sum(1 << int(k) for k in set(r.integers(0, 64, n))) for _ in range(40)], np.uint64)
    for n, clustered, most in ((64, False, 0.95), (1000, False, 0.6), (1600, True, 0.3)):
        p = np.unique((centres[:, None] ^ flips(6)[None, :]).ravel() if clustered else r.integers(0, 2**63, n, dtype=np.uint64))
        tally: list[int] = []
        simhash.link_shard(p, 4, tally)
        print(n, clustered, tally[0] / (len(p) * (len(p) - 1) / 2))
        assert tally[0] <= most * len(p) * (len(p) - 1) / 2


@pytest.mark.parametrize(("width", "values"), [(12, 1), (12, 5), (13, 64), (8, 1000)])
def test_leaves_of_a_band_hold_several_values(width, values):
    leaves = simhash.band_leaves(width, values)
    sizes = np.bincount(leaves)
    assert len(leaves) == 1 << width and sizes.min() >= 1 and sizes.max() <= values and len(sizes) <= max(1, 4 * (1 << width) // values)


def test_similarity_links_texts_that_share_their_shingles(spark):
    r = random.Random(11)
    fresh = lambda n: [f"u{r.randrange(10**6)}" for _ in range(n)]
    bases = [fresh(120) for _ in range(6)]
    edit = lambda w, at: " ".join("E" if i in at else x for i, x in enumerate(w))
    texts = [" ".join(b) for b in bases] + [edit(b, {10 * k}) for k, b in enumerate(bases)]
    texts += [edit(bases[0], {7 + k % 100}) for k in range(300)]  # each near the first
    texts += [" ".join(bases[k][:60] + fresh(60)) for k in range(6)]  # half in common: not near
    texts += ["same few", "Same  few", None, "", "one"]
    docs = docs_of(spark, texts).withColumn("sig", F.lit("clash"))
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    assert all(found[i] == i % 6 for i in range(12)) and all(found[i] == 0 for i in range(12, 312))
    assert all(found[i] == i for i in range(312, 318))
    assert [found[i] for i in range(318, 323)] == [318, 318, 320, 320, 322]
    few = [t for t in texts[:60]]
    signed = materialize(simhash.fingerprints(docs_of(spark, few), 5, signed=True).groupBy("fp").agg(F.min("sig").alias("sig")), "signed")
    for tile in (7, 4096):  # tiles lose nothing
        links = simhash.similar_links(signed, tile=tile)
        assert connected_components(links).select("component").distinct().count() == 6
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0), similarity=0.8).count() == 0


def test_copies_unlike_each_other_join_their_original(spark):
    r = random.Random(5)
    base = [f"u{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)]
    for k in range(150):  # each about 0.84 like the original, and about 0.71 like each other
        at = set(r.sample(range(400), 7))
        texts.append(" ".join(f"e{k}" if i in at else w for i, w in enumerate(base)))
    docs = docs_of(spark, texts)
    sig = {x["doc_id"]: np.frombuffer(x["sig"], np.uint8) for x in simhash.fingerprints(docs, 5, signed=True).collect()}
    alike = lambda i, j: (sig[i] == sig[j]).mean() >= (0.8 - simhash.SLACK) * 255 / 256 + 1 / 256
    near = [i for i in range(1, 151) if alike(0, i)]
    assert len(near) > 130 and sum(alike(i, j) for i in near for j in near if i < j) < 0.2 * len(near) * len(near) / 2
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    assert {found[i] for i in near} == {0}


def test_all_signatures_of_a_fingerprint_take_part(spark, monkeypatch):
    r = np.random.default_rng(8)
    a, b = (r.integers(0, 256, simhash.HASHES, dtype=np.uint8).tobytes() for _ in range(2))
    made = spark.createDataFrame([(0, 255, a), (1, 255, b), (2, 0, a), (3, 65535, b)], "doc_id long, fp long, sig binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: made)
    assert {x["component_id"] for x in simhash.near_duplicates(made, similarity=0.8).collect()} == {0}
    signed = made.select("fp", "sig")
    for tile in (1, 4096):
        assert connected_components(simhash.similar_links(signed, tile=tile)).select("component").distinct().count() == 1


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    r = random.Random(21)
    fresh = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(60))
    own, shared = [fresh() for _ in range(30)], [fresh(), fresh()]
    rows = [(None, t, "en", "s", len(t)) for t in own] + [(7, t, "en", "s", len(t)) for t in shared]
    rows += [(None, own[0], "en", "s", 1), (7, shared[0], "en", "s", 1), (None, shared[1], "en", "s", 1), (3, own[1], "en", "s", 1), (9, None, "en", "s", 0), (9, "", "en", "s", 0)]
    kept = [(x["doc_id"], x["text"]) for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    expected = [(3, own[1]), (7, shared[0]), (7, shared[1])] + [(None, t) for t in own if t != own[1]]
    assert sorted((k for k in kept if k[1]), key=str) == sorted(expected, key=str) and len(kept) == len(expected) + 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (501, 500)] + [(None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# WARC ---------------------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 1200
    rows = [(i, f"https://e.example/{i} %\n" if i % 3 else None if i % 2 else "", long if i % 4 == 0 else "y" * 50 if i % 4 == 1 else f"{long}{i}") for i in range(60)]
    rows += [(100, "u", None), (101, "u", ""), (None, "n", long), (56, rows[56][1], long), (-5, "neg", "z" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(0))
    manifests = []
    for turn, frame in enumerate((pages, pages.repartition(9))):
        path = str(tmp_path / f"out{turn}")
        manifests.append([tuple(r) for r in warc.write_warc(frame, path, shards=5, roll_bytes=3000).orderBy("name").collect()])
    assert manifests[0] == manifests[1]  # names, counts, sizes and digests of all files
    assert len(manifests[0]) > 5 and not list((tmp_path / "out0").glob("_temporary*"))
    back = warc.read_warc(spark, str(tmp_path / "out0")).collect()
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"]) for r in back)
    assert got == Counter((i, u, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, u, h in rows)
    for r in back:
        html = next(h for i, u, h in rows if (i, u) == (r["page_id"], r["url"]))
        if html == long and r["page_id"] != 56:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 56, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, (html or "").encode())
    assert warc.write_warc(pages.limit(0), str(tmp_path / "none")).count() == 0 and warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_found(tmp_path):
    record = warc.record(1, "u", b"x" * 20, "2024-01-01T00:00:00Z", None, False)
    assert warc.parse(record)["payload"] == b"x" * 20
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"xxx", b"xyx", 1))


# benchmarks ------------------------------------------------------------------------------------------------------------------------


def norm_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(texts, items, window):
    windows = defaultdict(set)
    for i, t in items:
        w = norm_words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = []
    for t in texts:
        w, hit, names = norm_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    names |= owners
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [3, 10])
def test_hits_equal_brute_force(spark, window):
    r = random.Random(window)
    word = lambda: r.choice(["a", "b", "c", "dé", "7"])
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 14)))) for i in range(25)] + [(90, None), (91, "A, b! C"), (92, "a b c"), (10, "zz")]
    texts = [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(60)] + [None, "", "ZZ", "a-b-c"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_hits(texts, items, window)
    for max_words in (2_000_000, 3):  # the second needs several passes
        found = decontaminate.find_contamination(docs_of(spark, texts).withColumn("hits", F.lit(0)), benchmark, window, max_words)
        for row in found.collect():
            hit = sum(s["stop"] - s["start"] for s in row["_hits"])
            digest = hashlib.sha256(",".join(row["items"]).encode()).hexdigest()
            assert (row["n_words"], hit, len(row["items"]), digest) == expected[row["doc_id"]]
    report = decontaminate.contamination_report(docs_of(spark, texts), benchmark, window).collect()
    assert all((x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"]) == expected[x["doc_id"]] and x["contaminated"] == (x["n_hit"] > 0) for x in report)
    assert decontaminate.contamination_report(docs_of(spark, texts).limit(0), benchmark).count() == 0
    assert {x["n_hit"] for x in decontaminate.contamination_report(docs_of(spark, texts), benchmark.limit(0)).collect()} == {0}


def test_cutting_leaves_no_window(spark):
    item = "one two three four five six seven eight nine ten eleven"
    filler = " ".join(f"f{i}" for i in range(40))
    texts = [f"{filler}. One, two three four five {item} six seven eight nine ten eleven {filler}", item, filler, None, ""]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, texts)
    out = decontaminate.decontaminate(docs, benchmark)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and set(rows) == {0, 2, 3, 4} and rows[2]["text"] == filler
    assert "nine" not in rows[0]["text"] and rows[0]["n_chars"] == len(rows[0]["text"]) and rows[0]["text"].startswith(filler)


def test_cutting_does_not_depend_on_the_number_of_automata(spark, monkeypatch):
    r = random.Random(9)
    items = [" ".join(f"i{k}x{j}" for j in range(12)) for k in range(8)]
    fresh = lambda n: " ".join(f"f{r.randrange(10**6)}" for _ in range(n))
    half = lambda t, a: " ".join(t.split()[:6] if a else t.split()[6:])
    # mostly items of different groups; items in items, deeper than two rounds; below the limit; clean
    nested = items[0]
    for k in range(1, 6):
        nested = f"{half(items[k], True)} {nested} {half(items[k], False)}"
    texts = [" ".join([*items, fresh(64)]), f"{fresh(900)}. {nested}, {fresh(90)}", f"{items[3]} {fresh(40)}", fresh(30), None, ""]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs_of(spark, texts).withColumn("hits", F.lit(0))
    one = {x["doc_id"]: tuple(x) for x in decontaminate.decontaminate(docs, benchmark).collect()}
    assert set(one) == {1, 2, 3, 4, 5} and "x" not in one[1][1]
    real = decontaminate.groups_of
    monkeypatch.setattr(decontaminate, "groups_of", lambda b, *_: real(b, 30))
    assert decontaminate.groups_of(benchmark) > 1
    several = decontaminate.decontaminate(docs, benchmark)
    assert several.columns == docs.columns and {x["doc_id"]: tuple(x) for x in several.collect()} == one

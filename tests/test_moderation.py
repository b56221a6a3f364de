"""The automaton of terms against a regular expression for each term."""

import random
import re

from tidewell.functions import moderation

SEP = r"[\s._*-]*"
TERMS = [("bad", "contextual"), ("badger", "high"), ("worst one", "extreme"), ("worsto ne", "high"), ("moron", "high"), ("a1 b", "contextual"), ("moron", "contextual"), ("Idiots", "extreme"), ("???", "high")]
ALLOWED = ("Badger  state", "bad weather")


def by_expressions(text):
    """What each term's own expression finds: (term, evasion)."""
    base = re.sub(r"\s+", " ", (text or "").lower()).strip(" ")
    leet = base.translate(str.maketrans("013457@$!", "oieastasi"))
    squeeze = lambda s: re.sub(r"(.)\1{2,}", r"\1", s)
    out = []
    for term, severity in moderation.highest(TERMS).items():
        pattern = "(?<![a-z0-9])" + SEP.join(re.findall("[a-z0-9]+", term)) + "(?![a-z0-9])"
        hit = any(re.search(pattern, v) for v in (base, squeeze(base), leet, squeeze(leet)))
        hit = hit and not any(term in p and p in base for p in ("badger state", "bad weather"))
        runs = [re.sub("[^a-z0-9]", "", r) for r in re.findall(r"(?:[a-z0-9][\s._*-]){2,}[a-z0-9]", leet)]
        apart = severity != "contextual" and re.fullmatch("[a-z0-9]{5,}", term) and any(term in r for r in runs)
        if hit or apart:
            out.append((term, not hit))
    return out


def test_automaton_equals_expressions(spark):
    rng = random.Random(7)
    bits = ["bad", "badger", "worst", "one", "moron", "m0r0n", "m o r o n", "mooooron", "a1", "b", "al b", "weather", "state", "ger", "idi0ts", "i.d.i.o.t.s", "idiot", "Idiots", "\U0001f600", "é", "x", "w-o-r-s-t"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  ", ".", "_", "-", "*", "!", "\n", "\t.", ", ", "...", "   "]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["", None, "bad", " moron ", "x" * 300_000 + " worst.. one", "😀😀😀 bad"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: [(m["term"], m["evasion"]) for m in r["found"]] for r in frame.select("id", moderation.matches(frame["text"], TERMS, ALLOWED).alias("found")).collect()}
    plain = {i: t if t is None else t.replace("é", "e") for i, t in enumerate(texts)}
    assert got == {i: by_expressions(t) for i, t in plain.items()}
    assert sum(map(bool, got.values())) > 500
    assert frame.select(moderation.severity_of(moderation.matches(frame["text"], [])).alias("s")).filter("s IS NOT NULL").isEmpty()


def test_cost_does_not_grow_with_terms():
    """A thousand terms are still one walk over the text."""
    many = tuple((f"term{i}", "high") for i in range(1000))
    whole, apart = moderation._automata(many)
    assert len(whole) == len(apart) == 1000 and moderation._find("a term7 b", many, ()) == [{"term": "term7", "severity": "high", "evasion": False}]

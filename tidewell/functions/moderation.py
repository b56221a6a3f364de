"""Text moderation: term lists with severities against disguised spellings.

Terms are (term, severity) with severities contextual, high and extreme.  The list is a parameter and small (its size is checked);
an automaton of all terms reads the text's variants, so screening is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import unaccent

RANK = {"contextual": 1, "high": 2, "extreme": 3}
STATUS = {"extreme": "cancelled", "high": "pending_review", "contextual": "pending_review"}
LEET_FROM, LEET_TO = "013457@$!", "oieastasi"
MAX_TERMS = 2_000
FOUND = "array<struct<term:string,severity:string,evasion:boolean>>"
LEET = str.maketrans(LEET_FROM, LEET_TO)
SEPARATOR_CHARS = " \t\n\v\f\r._*-"
SEPARATORS = re.compile(r"[ \t\n\v\f\r._*-]+")
APART = re.compile(r"(?:[a-z0-9][ \t\n\v\f\r._*-]){2,}[a-z0-9]")
TRIPLE = re.compile(r"(.)\1{2,}")
WORD = re.compile(r"[a-z0-9]")


def normal(text: Column) -> Column:
    """Lower case without diacritics, runs of white space as one space."""
    return F.trim(F.regexp_replace(unaccent(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " "))


def highest(terms: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Each term once, with its highest severity."""
    out: dict[str, str] = {}
    for term, severity in terms:
        key = term.lower().strip()
        if re.search(r"[a-z0-9]", key) and RANK[severity] > RANK.get(out.get(key, ""), 0):
            out[key] = severity
    if len(out) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return out


@lru_cache(maxsize=8)
def _automata(known: tuple[tuple[str, str], ...]) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of the terms without separators, each with the places of its word ends; and of the terms looked for in letters apart."""
    whole, apart = ahocorasick.Automaton(), ahocorasick.Automaton()
    for i, (term, severity) in enumerate(known):
        words = re.findall(r"[a-z0-9]+", term)
        joints = frozenset(accumulate(map(len, words)))
        key = "".join(words)
        whole.add_word(key, (len(key), [*(whole.get(key)[1] if key in whole else ()), (i, joints)]))
        if RANK[severity] > 1 and re.fullmatch(r"[a-z0-9]{5,}", term):
            apart.add_word(term, i)
    for made in (whole, apart):
        if len(made):
            made.make_automaton()
    return whole, apart


def _named(text: str, whole: ahocorasick.Automaton) -> set[int]:
    """Terms that stand in a text with separators between their words only, and not inside a longer word."""
    found: set[int] = set()
    at = None
    for last, (size, terms) in whole.iter(SEPARATORS.sub("", text)):
        if all(i in found for i, _ in terms):
            continue
        if at is None:  # where the characters without separators stand in the text
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            at = np.flatnonzero(~np.isin(points, [ord(c) for c in SEPARATOR_CHARS]))
        own = at[last - size + 1 : last + 1]
        before, after = text[own[0] - 1 : own[0]] if own[0] else "", text[own[-1] + 1 : own[-1] + 2]
        if not (WORD.match(before) or WORD.match(after)):
            breaks = set((np.flatnonzero(np.diff(own) > 1) + 1).tolist())
            found.update(i for i, joints in terms if breaks <= joints)
    return found


def _find(text: str, known: tuple[tuple[str, str], ...], phrases: tuple[str, ...]) -> list[dict]:
    whole, apart = _automata(known)
    leet = text.translate(LEET)
    squeezed = TRIPLE.sub(r"\1", text)
    named: set[int] = set()
    for variant in dict.fromkeys((text, squeezed, leet, TRIPLE.sub(r"\1", leet))):
        named |= _named(variant, whole)
    if named and phrases:
        said = [p for p in phrases if p in text]
        named = {i for i in named if not any(known[i][0] in p for p in said)}
    hidden = {i for run in APART.findall(leet) for _, i in apart.iter(SEPARATORS.sub("", run))} if len(apart) else set()
    return [{"term": known[i][0], "severity": known[i][1], "evasion": i not in named} for i in sorted(named | hidden)]


def matches(text: Column, terms: Iterable[tuple[str, str]], allowed: Iterable[str] = ()) -> Column:
    """Array of struct<term, severity, evasion> found in a text, in the order of the terms; none in a null text.

    A term counts in any of four variants (digits as letters, squeezed repeats), unless an allowed phrase with it stands in the
    text.  High and extreme one-word terms of five letters or more also count inside letters written apart.  All terms are one
    automaton that goes over each variant once, in Arrow batches, so cost does not grow with the terms.
    """
    known = tuple(highest(terms).items())
    phrases = tuple(re.sub(r"\s+", " ", p.lower()).strip() for p in allowed)
    if not known:
        return F.array().cast(FOUND)

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([_find(t.as_py(), known, phrases) for t in texts], pa.list_(pa.struct([("term", pa.string()), ("severity", pa.string()), ("evasion", pa.bool_())])))

    return find(normal(text))


def severity_of(found: Column) -> Column:
    """The highest severity of the matches, or null."""
    top = F.array_max(F.transform(found, lambda m: F.when(m["severity"] == "extreme", 3).when(m["severity"] == "high", 2).otherwise(1)))
    return F.when(top == 3, "extreme").when(top == 2, "high").when(top == 1, "contextual")


def screen(fields: Iterable[Column], terms: Iterable[tuple[str, str]], allowed: Iterable[str] = ()) -> Column:
    """struct<flagged, severity, status> of an event's joined text fields."""
    severity = severity_of(matches(F.concat_ws("\n", *fields), terms, allowed))
    return F.struct(severity.isNotNull().alias("flagged"), severity.alias("severity"), F.when(severity == "extreme", STATUS["extreme"]).when(severity.isNotNull(), STATUS["high"]).alias("status"))

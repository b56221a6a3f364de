"""Weighted phrases, found in one pass with their places, so that asides, conditions and vetoes apply by position.

Rules are data (``Rules``); ``read`` compiles all their phrases into one automaton and goes over each text once in Arrow batches,
so the cost of a text grows with its length and matches, not with the number of phrases.

A phrase is words with single spaces.  ``{a,b c,}`` stands for either part, ``#`` for any number, and a word ending in ``*`` for
every word that begins so.  Texts are read in lower case; what is neither letter nor digit parts words, and ``.!?`` end a sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Phrases = tuple[str, ...]
Place = tuple[int, int]
MAX_PHRASES = 100_000
STOPS = re.compile(r"(?= \. )")
FOUND = "struct<scores:array<struct<category:string,score:int>>,family:boolean,fundraiser:boolean,rule:string,terms:array<string>,suppressed:boolean>"


@dataclass(frozen=True)
class Signal:
    """Adds weight to a category once if one of its phrases counts somewhere.

    ``scope`` is text or title.  A match does not count inside an aside of group ``outside``, directly behind a word of ``before``
    or directly in front of one of ``after``; with ``followed`` some word must come, with ``ahead_of`` one of these or the end of the
    sentence.  ``needs`` must stand somewhere in the text outside the asides, ``unless`` nowhere at all.
    """

    category: str
    weight: int
    phrases: Phrases
    scope: str = "text"
    outside: str = ""
    before: Phrases = ()
    after: Phrases = ()
    followed: bool = False
    ahead_of: Phrases = ()
    needs: Phrases = ()
    unless: Phrases = ()


@dataclass(frozen=True)
class Run:
    """From an opening phrase to the nearest closing one in the sentence, or the opening phrase alone.

    ``gap`` limits the characters between them; with ``fillers`` only those words may stand there, ``most`` at most; ``to_end``
    stretches the run to the end of its sentence, or by as many characters as it says.
    """

    opens: Phrases
    closes: Phrases = ()
    gap: int | None = None
    fillers: Phrases | None = None
    most: int = 3
    to_end: int = 0


@dataclass(frozen=True)
class Rules:
    signals: tuple[Signal, ...]
    #: (group, run) of what is said beside the event; of a group, each phrase serves the first run that takes it.
    asides: tuple[tuple[str, Run], ...] = ()
    family: Phrases = ()
    family_title: Phrases = ()
    fundraiser: tuple[Signal, ...] = ()
    #: Words that tell of prevention or teaching, and topics that they make harmless within ``near`` characters of a sentence.
    framing: Phrases = ()
    topics: Phrases = ()
    near: int = 60
    child_harm: tuple[Run, ...] = ()
    serious: Phrases = ()
    cues: Phrases = ()
    fiction: Phrases = ()


def expand(phrase: str) -> list[str]:
    """The phrases that braces stand for."""
    inner = re.search(r"\{([^{}]*)\}", phrase)
    if not inner:
        return [" ".join(phrase.split())]
    return list(dict.fromkeys(p for part in inner[1].split(",") for p in expand(phrase[: inner.start()] + part + phrase[inner.end() :])))


def plain(text: Column) -> Column:
    """Words apart by one space, with one before and behind; numbers as #, ends of sentences as a dot; null as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "#", " ")
    for pattern, put in ((r"[0-9]+(\.[0-9]+)?", "#"), (r"[.!?]+", " . "), (r"[^a-z#.À-ɏ]+", " ")):
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), " +", " ")


class Finder:
    """One automaton of all phrases of some groups."""

    def __init__(self, groups: Iterable[Phrases]) -> None:
        self.groups = {g: i for i, g in enumerate(dict.fromkeys(groups))}
        self.automaton = ahocorasick.Automaton()
        keys: dict[str, set[int]] = {}
        for group, i in self.groups.items():
            for phrase in (p for raw in group for p in expand(raw) if p):
                if not re.fullmatch(r"[a-z#À-ɏ]+( [a-z#À-ɏ]+)*\*?", phrase):
                    raise ValueError(f"phrase {phrase!r} is not words in lower case")
                keys.setdefault(f" {phrase[:-1]}" if phrase.endswith("*") else f" {phrase} ", set()).add(i)
        if len(keys) > MAX_PHRASES:
            raise ValueError(f"more than {MAX_PHRASES} phrases")
        for key, owners in keys.items():
            self.automaton.add_word(key, (len(key), key[-1] != " ", tuple(owners)))
        if keys:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, list[Place]]:
        """The places of each group's phrases by their starts; of those that start together the longest."""
        best: dict[int, dict[int, int]] = {}
        if len(self.automaton):
            for last, (size, open_ended, owners) in self.automaton.iter(text):
                end = text.index(" ", last + 1) if open_ended else last
                for owner in owners:
                    places = best.setdefault(owner, {})
                    start = last - size + 2
                    places[start] = max(end, places.get(start, 0))
        return {owner: sorted(places.items()) for owner, places in best.items()}


@dataclass(frozen=True)
class Said:
    """A text, the places of phrases in it by group, and where its sentences end."""

    text: str
    found: dict[int, list[Place]]
    stops: list[int]

    def stop_after(self, place: int) -> int:
        at = bisect_left(self.stops, place)
        return self.stops[at] if at < len(self.stops) else len(self.text) - 1


class Reader:
    """Rules made ready for texts that ``plain`` has made."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        runs = [run for _, run in rules.asides] + list(rules.child_harm)
        parts = [p for r in runs for p in (r.opens, r.closes)] + [p for s in rules.signals + rules.fundraiser for p in (s.phrases, s.needs, s.unless)]
        self.finder = Finder([*parts, rules.family, rules.family_title, rules.framing, rules.topics, rules.serious, rules.cues, rules.fiction])
        # what a text can call for only by a phrase that is in it, each with that phrase's group
        of = self.finder.groups
        self.signals, self.fundraiser = ([(of[s.phrases], s) for s in some] for some in (rules.signals, rules.fundraiser))
        self.asides = [(of[run.opens], group, run) for group, run in rules.asides]
        self.child_harm = [(of[run.opens], run) for run in rules.child_harm]

    def places(self, found: dict[int, list[Place]], phrases: Phrases) -> list[Place]:
        return found.get(self.finder.groups[phrases], []) if found else []

    def run_places(self, said: Said, run: Run, gone: list[Place] | None = None) -> list[Place]:
        """A run's places, in order; phrases inside what is ``gone`` neither open nor close one."""
        out: list[Place] = []
        closes = outside(self.places(said.found, run.closes), gone or [])
        starts = [start for start, _ in closes]
        reach = len(said.text) if run.gap is None else run.gap
        if run.fillers is not None:
            reach = min(reach, run.most * (1 + max(map(len, run.fillers), default=0)) + 1)
        for start, end in outside(self.places(said.found, run.opens), gone or []):
            if out and start < out[-1][1]:
                continue
            if run.closes:
                at = bisect_left(starts, end)
                if at == len(closes):
                    break
                close = closes[at]
                if close[0] > said.stop_after(end) or close[0] - end > reach:
                    continue
                if run.fillers is not None:
                    words = said.text[end : close[0]].split()
                    if len(words) > run.most or not set(words) <= set(run.fillers):
                        continue
                end = close[1]
            if run.to_end:
                end = min(said.stop_after(end), end + run.to_end)
            out.append((start, end))
        return out

    def softened(self, said: Said) -> list[Place]:
        """Spans of a topic and a framing word that stand next to each other; each word serves once, framing words in front first."""
        if not (self.places(said.found, self.rules.framing) and self.places(said.found, self.rules.topics)):
            return []
        marks = sorted([(*p, "f") for p in self.places(said.found, self.rules.framing)] + [(*p, "t") for p in self.places(said.found, self.rules.topics)])
        out: list[Place] = []
        for first in "ft":
            left, i = [], 0
            while i < len(marks):
                a, b = marks[i], marks[i + 1] if i + 1 < len(marks) else None
                if b and a[2] == first != b[2] and 0 <= b[0] - a[1] <= self.rules.near and b[0] < said.stop_after(a[1]):
                    out.append((a[0], b[1]))
                    i += 2
                else:
                    left.append(a)
                    i += 1
            marks = left
        return sorted(out)

    def veto(self, said: Said) -> tuple[str | None, list[str]]:
        """child-harm, or serious-harm with the cue of a true case outside fiction; the phrases that tell of it."""
        soft = self.softened(said)
        for opens, run in self.child_harm:
            if opens not in said.found:
                continue
            harm = outside(self.run_places(said, run), soft)
            if harm:
                return "child-harm", [said.text[slice(*harm[0])]]
        serious, cues = (outside(self.places(said.found, p), soft) for p in (self.rules.serious, self.rules.cues))
        if serious and cues and not self.places(said.found, self.rules.fiction):
            return "serious-harm", [said.text[slice(*serious[0])], said.text[slice(*cues[0])]]
        return None, []

    def counts(self, signal: Signal, said: Said, title_end: int, asides: list[Place]) -> bool:
        def kept(start: int, end: int) -> bool:
            ahead = said.text[said.text.rfind(" ", 0, start - 1) + 1 : start - 1] if signal.before else ""
            behind = said.text[end + 1 : said.text.find(" ", end + 1)] if signal.after or signal.followed or signal.ahead_of else ""
            if signal.ahead_of and behind not in ("", ".", *signal.ahead_of):
                return False
            return not (ahead in signal.before or behind in signal.after or signal.followed and behind in ("", "."))

        limit = title_end if signal.scope == "title" else len(said.text)
        if not any(end < limit and kept(start, end) for start, end in outside(self.places(said.found, signal.phrases), asides)):
            return False
        if signal.needs and not outside(self.places(said.found, signal.needs), asides):
            return False
        return not (signal.unless and self.places(said.found, signal.unless))

    def read(self, text: str, title_end: int) -> dict:
        found = self.finder.find(text)
        if not found:
            return {"scores": [], "family": False, "fundraiser": False, "rule": None, "terms": [], "suppressed": False}
        said = Said(text, found, [m.start() for m in STOPS.finditer(text)])
        asides: dict[str, list[Place]] = {}
        for opens, group, run in self.asides:
            if opens in said.found:
                known = asides.get(group, [])
                asides[group] = merged(known + self.run_places(said, run, known))
        scores: dict[str, int] = {}
        for phrases, signal in self.signals:
            if phrases in said.found and self.counts(signal, said, title_end, asides.get(signal.outside, [])):
                scores[signal.category] = scores.get(signal.category, 0) + signal.weight
        near = asides.get("family", [])
        family = bool(outside(self.places(said.found, self.rules.family), near)) or any(end < title_end for _, end in outside(self.places(said.found, self.rules.family_title), near))
        rule, terms = self.veto(said)
        return {
            "scores": [{"category": c, "score": s} for c, s in scores.items()],
            "family": family and rule is None,
            "fundraiser": any(phrases in said.found and self.counts(s, said, title_end, asides.get(s.outside, [])) for phrases, s in self.fundraiser),
            "rule": rule,
            "terms": terms,
            "suppressed": family and rule is not None,
        }


def merged(places: list[Place]) -> list[Place]:
    """Places without overlaps, in order."""
    out: list[Place] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def outside(places: list[Place], asides: list[Place]) -> list[Place]:
    """Those that touch no aside; asides are in order and apart."""
    if not asides or not places:
        return places
    ends = [end for _, end in asides]
    out = []
    for start, end in places:
        at = bisect_left(ends, start + 1)
        if at == len(asides) or asides[at][0] >= end:
            out.append((start, end))
    return out


@lru_cache(maxsize=8)
def _reader(rules: Rules) -> Reader:
    return Reader(rules)


@lru_cache(maxsize=8)
def _udf(rules: Rules):
    scores = pa.list_(pa.struct([("category", pa.string()), ("score", pa.int32())]))
    kind = pa.struct([("scores", scores), ("family", pa.bool_()), ("fundraiser", pa.bool_()), ("rule", pa.string()), ("terms", pa.list_(pa.string())), ("suppressed", pa.bool_())])

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array, title_ends: pa.Array) -> pa.Array:
        reader = _reader(rules)
        return pa.array([reader.read(t.as_py(), n.as_py()) for t, n in zip(texts, title_ends)], kind)

    return find


def read(title: Column, description: Column, rules: Rules) -> Column:
    """Struct of what the rules find: scores by category in the order of the signals, family, fundraiser, and a veto on family.

    ``rule`` is null, child-harm or serious-harm, ``terms`` the phrases that tell of it, ``suppressed`` whether words for families were
    there.  Nulls are empty texts, which have no scores, no facets and no veto.  Texts are read whole, once.
    """
    _reader(rules)  # phrases that are not words fail here, not in a task
    text = plain(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return _udf(rules)(text, F.length(plain(title)))

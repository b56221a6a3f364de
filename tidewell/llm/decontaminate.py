"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items' words is built once on the driver and broadcast; its size is bounded, as items are split into
groups of at most ``MAX_WORDS`` words, each a pass of its own.  Tasks stream the words of whole documents through it and
track the longest match that ends at each word.  A match of ``window`` words or more marks those words as hit and names the
items that hold the window.  Words outside the items' vocabulary break every match, so only runs of known word pairs are
streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows, materialize, safe, utf8

#: Words of items in one automaton (up to 1 kB each in a task); larger benchmarks take more passes.
MAX_WORDS = 300_000
#: Lower-cases A-Z, keeps digits, letters and all bytes of characters beyond ASCII, and turns the rest into spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class ItemAutomaton:
    """Suffix automaton over the words of many items, with the items that hold each window."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        self.window, self.vocabulary, self.pairs = window, {}, set()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text))
            if ids:
                known.setdefault(ids, set()).add(item)
        ends: dict[int, set[int]] = {}  # state -> items that have its windows
        for ids in known:
            last = 0
            for word in ids:
                last = self._extend(last, word)
        self.short: dict[int, set[int]] = {}  # state of a whole item below the window's length -> its items
        self.least = window
        for ids, owners in known.items():
            state = matched = 0
            for word in ids:
                state, matched = self.step(state, matched, word)
                if matched >= window:
                    ends.setdefault(self.cut(state), set()).update(owners)
            if len(ids) < window:
                self.short.setdefault(state, set()).update(owners)
                self.least = min(self.least, len(ids))
            self.pairs.update(zip(ids, ids[1:]))
        self.owners = ends
        # of each state, the states among its suffixes that are whole short items, longest first
        self.shorts: list[tuple[int, ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.shorts[self.link[state]]
            self.shorts[state] = (state, *up) if state in self.short else up
        n = max(1, len(self.vocabulary))
        self.pair_keys = np.array(sorted(a * n + b for a, b in self.pairs), np.int64)

    def _new(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        """Appends a word; an existing transition is followed, or its state split where it also stands for longer strings."""
        if (there := self.next[last].get(word)) is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new, at = self._new(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: int, there: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if (to := self.next[state].get(word)) is None:
            return 0, 0
        return to, matched + 1

    def cut(self, state: int) -> int:
        """The state that stands for the last ``window`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of word positions (sorted, merged, end exclusive) and the items whose windows occur."""
        if len(tokens) < self.least:
            return [], set()
        get, n = self.vocabulary.get, max(1, len(self.vocabulary))
        ids = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
        spans: list[list[int]] = []
        items: set[int] = set()
        for begin, end in self._runs(ids, n):
            state = matched = 0
            for at, word in enumerate(ids[begin:end].tolist(), begin):
                state, matched = self.step(state, matched, word)
                reach = 0
                if matched >= self.window:
                    reach = matched
                    items |= self.owners[self.cut(state)]
                if self.short:
                    for s in self.shorts[state]:
                        if self.length[s] <= matched:
                            reach = max(reach, self.length[s])
                            items |= self.short[s]
                if reach:
                    start = at + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at + 1])
        return [(a, b) for a, b in spans], items

    def _runs(self, ids: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Stretches of word pairs that occur in items, long enough for a window; single known words where an item is one word."""
        if self.least == 1:
            good, extra = ids >= 0, 0
        else:
            keys = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * n + ids[1:], -1)
            at = np.searchsorted(self.pair_keys, keys)
            good, extra = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == keys if len(self.pair_keys) else keys == -2, 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin + extra >= self.least:
                yield begin, end + extra


def groups_of(benchmark: DataFrame, max_words: int = MAX_WORDS) -> int:
    """How many automata of about ``max_words`` words the items need."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    return max(1, -(-int(total) // (6 * max_words)))


def automaton(benchmark: DataFrame, window: int, group: int, groups: int) -> ItemAutomaton:
    """The automaton of one group of the items (item_id, text)."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("text"))
    part = sized if groups == 1 else sized.filter(F.coalesce(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)), F.lit(0)) == group)
    return ItemAutomaton([(r["item_id"], bytes(r["text"])) for r in part.toLocalIterator()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with n_words, hit spans (array of word positions start, stop) and items (sorted item ids as strings).

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.  Null and
    empty texts have no words and no hits; null item ids count as no item but still mark words; repeated items count once.
    Texts of any length are streamed whole, in time that grows with their words.  The new columns are named n_words, hits
    and items, with underscores before them where ``docs`` has such columns.
    """
    return _find(docs, benchmark, window, groups_of(benchmark, max_words), *safe(docs, "n_words", "hits", "items"))


def _find(docs: DataFrame, benchmark: DataFrame, window: int, groups: int, n_words: str, hits: str, items: str) -> DataFrame:
    """``docs`` with the hits of all automata, each a pass; of several, the driver and tasks hold one at a time.

    With several, the documents are written once, numbered; a pass reads numbers and texts and writes the numbers of documents with hits
    (the first one all numbers, with counts of words), and what the passes found is joined to the documents in the end.
    """
    spark = docs.sparkSession
    if groups == 1:
        return _pass(docs, spark.sparkContext.broadcast(automaton(benchmark, window, 0, 1)), docs.columns, n_words, hits, items)
    (row,) = safe(docs, "row_number")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    passes = []
    for group in range(groups):
        shared = spark.sparkContext.broadcast(automaton(benchmark, window, group, groups))
        found = _pass(numbered.select(row, "text"), shared, [row], n_words, hits, items)
        passes.append(materialize(found if group == 0 else found.filter(F.size(hits) > 0), "decontaminate-hits"))
        shared.destroy()
    listed = reduce(DataFrame.unionByName, passes).groupBy(row).agg(F.max(n_words).alias(n_words), F.flatten(F.collect_list(hits)).alias(hits), F.flatten(F.collect_list(items)).alias(items))
    kept = [c for c in docs.columns if c not in (n_words, hits, items)]
    return numbered.select(*kept, row).join(_merged(listed, hits, items), row).select(*kept, n_words, hits, items)


def _merged(found: DataFrame, hits: str, items: str) -> DataFrame:
    """Rows with the spans of all passes merged; an item lies in one automaton, but null ids and repeats may not."""

    def fn(c: dict[str, list]) -> dict[str, list]:
        c[hits] = [[{"start": a, "stop": b} for a, b in merge([(s["start"], s["stop"]) for s in spans])] for spans in c[hits]]
        c[items] = [sorted(set(names)) for names in c[items]]
        return c

    return map_rows(found, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema))


def _pass(docs: DataFrame, shared, carried: list[str], n_words: str, hits: str, items: str) -> DataFrame:
    """The columns ``carried`` of ``docs`` with what one automaton finds in their texts."""
    kept = [c for c in carried if c not in (n_words, hits, items)]
    (whole,) = safe(docs, "text_bytes")
    source = docs.select(*kept, utf8("text").alias(whole))
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    schema = f"{kept_schema}, `{n_words}` long, `{hits}` array<struct<start:int,stop:int>>, `{items}` array<string>"

    def fn(c: dict[str, list]) -> dict[str, list]:
        machine = shared.value
        counts, spans, found = [], [], []
        for text in c[whole]:
            tokens = words(text)
            own, names = machine.scan(tokens)
            names.discard(None)
            counts.append(len(tokens))
            spans.append([{"start": a, "stop": b} for a, b in own])
            found.append(sorted(names))
        return {k: c[k] for k in kept} | {n_words: counts, hits: spans, items: found}

    return map_rows(source, fn, schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, as ``find_contamination`` finds them."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """The documents without test items, columns and their order as given.

    Spans of ``window`` or more words that match an item (or a whole shorter item) are cut from the text; a document
    with more than ``max_coverage`` of its words hit goes.  Cutting repeats until no hit is left, as two ends may form a
    window; each round judges what the last one left.  Several automata count as one: a round gathers the hits of all of
    them before it judges and cuts, and the next searches only what has changed.  Documents without a hit, null texts
    among them, stay as they are; n_chars, where present, follows the text.
    """
    groups = groups_of(benchmark, max_words)
    if groups == 1:
        return _cut(docs, docs.sparkSession.sparkContext.broadcast(automaton(benchmark, window, 0, 1)), max_coverage)
    names = safe(docs, "n_words", "hits", "items")
    clean_, open_ = [], docs
    while True:
        found = materialize(_find(open_, benchmark, window, groups, *names), "decontaminate")
        hit = F.size(F.col(names[1])) > 0
        clean_.append(found.filter(~hit).select(*docs.columns))
        # each round makes the texts that are left shorter, so rounds end
        open_ = materialize(_cut_hits(found.filter(hit), docs, names[1], max_coverage), "decontaminate-cut")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, clean_)


def _cut_hits(found: DataFrame, docs: DataFrame, hits: str, max_coverage: float) -> DataFrame:
    """Documents with ``hits``, less these words; those with more than ``max_coverage`` of their words hit go."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def fn(c: dict[str, list]) -> dict[str, list]:
        keep = []
        for i, text in enumerate(c["text"]):
            data = text.encode()
            plain = data.translate(NORMAL)
            cleaned = without(data, plain, plain.split(), [(s["start"], s["stop"]) for s in c[hits][i]], max_coverage)
            if cleaned is None:
                continue
            keep.append(i)
            c["text"][i] = cleaned.decode()
            if "n_chars" in names:
                c["n_chars"][i] = len(c["text"][i])
        return {k: [c[k][i] for i in keep] for k in names}

    return map_rows(found.select(*names, hits), fn, schema)


def _cut(docs: DataFrame, shared, max_coverage: float) -> DataFrame:
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sized = "n_chars" in names

    def fn(c: dict[str, list]) -> dict[str, list]:
        machine = shared.value
        keep = []
        for i, text in enumerate(c["text"]):
            cleaned = clean(machine, text.encode(), max_coverage) if text else text
            if cleaned is None and text is not None:
                continue
            keep.append(i)
            if isinstance(cleaned, bytes):
                c["text"][i] = cleaned.decode()
                if sized:
                    c["n_chars"][i] = len(c["text"][i])
        return {k: [v[i] for i in keep] for k, v in c.items()}

    return map_rows(docs, fn, schema)


def clean(machine: ItemAutomaton, text: bytes, max_coverage: float) -> bytes | str | None:
    """The text without hit spans; '' marks a text left as it was, None one that goes."""
    changed = False
    while True:
        plain = text.translate(NORMAL)
        tokens = plain.split()
        spans, _ = machine.scan(tokens)
        if not spans:
            return text if changed else ""
        if (text := without(text, plain, tokens, spans, max_coverage)) is None:
            return None
        changed = True


def without(text: bytes, plain: bytes, tokens: list[bytes], spans: list[tuple[int, int]], max_coverage: float) -> bytes | None:
    """The text without spans of its words, which are ``tokens`` in ``plain``; None if they are over ``max_coverage`` of them."""
    if sum(b - a for a, b in spans) > max_coverage * len(tokens):
        return None
    at, starts, stops = 0, [], []
    for token in tokens:
        at = plain.index(token, at)
        starts.append(at)
        at += len(token)
        stops.append(at)
    pieces, begin = [], 0
    for a, b in spans:
        pieces.append(text[begin : starts[a]])
        begin = stops[b - 1]
    return b"".join([*pieces, text[begin:]])

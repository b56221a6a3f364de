"""Substring dedup by collinear chaining: passages of a document that an earlier one has, exactly or with edits.

1. Documents with equal texts are one class; only its smallest doc_id is searched.
2. Seeds are window minimisers of ``k``-word hashes: any run of ``k + w - 1`` equal words has a seed in common.  A seed
   carries five bits of each of the SIDE words before and behind it.
3. Of each seed the earliest document is the hub, found by map-side minima; every other document's seed is matched with the
   hub's, so a seed gives as many matches as it has places, and the join's large side can be split where a seed is hot.
   Where the hub has a seed at m places, the n-th place in another document meets the hub's place n modulo m.
4. Matches of a document are chained per hub: order in both texts, a cost for gaps, prefix maxima in a Fenwick tree.  A
   chain of one seed goes on only if enough of the words beside it agree for a stretch (see 5).
5. Chains are aligned: each with the words of its document LEAST words beyond both ends, and a hub's words once for up to
   TILE chains.  Stretches of ``similarity`` or more are matched words.
6. A passage is a stretch of ``least`` words or more that matched stretches, of one or several hubs, cover.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewell.llm.common import map_rows, materialize, safe, utf8
from tidewell.llm.mixing import word_count

K, WINDOW = 6, 14
#: Least words of a passage, and the share of its words that must agree.
LEAST, SIMILARITY = 50, 0.8
#: Cost of each word of a gap, against K for each seed; so no gap of a chain has over 60 words in both texts together.
GAP_COST = 0.1
#: Words that are aligned beyond a chain's outermost seeds.
MARGIN = LEAST
#: Shortest stretch of aligned words that counts.
STRETCH = 12
#: Words on each side of a seed whose five bits it carries, and how far they may be shifted.
SIDE, SHIFT = 6, 2
#: Chains that are aligned with one copy of a hub's words.
TILE = 2048
#: A written table of at most this many bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def coded(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def seeds(one: np.ndarray, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and neighbour bits of the window minimisers over word hashes; of equal ones in a window the rightmost."""
    n = len(one) - k + 1
    if n < 1:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for i in range(k):  # polynomial over word hashes, modulo 2**64
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    if n <= w:
        at = np.array([n - 1 - int(np.argmin(mixed[::-1]))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(mixed, w)[:, ::-1]
        at = np.unique(np.arange(n - w + 1) + w - 1 - view.argmin(axis=1))
    few = np.zeros(len(one) + 2 * SIDE, np.int64)
    few[SIDE : SIDE + len(one)] = one % np.uint64(31) + np.uint64(1)  # 0: beyond the text
    near = np.zeros(len(at), np.int64)
    for i in range(SIDE):  # the words before, nearest first, then those behind
        near |= few[at + SIDE - 1 - i] << np.int64(5 * i)
        near |= few[at + SIDE + k + i] << np.int64(5 * (SIDE + i))
    return at.astype(np.int32), mixed[at], near


def turns(values: np.ndarray) -> np.ndarray:
    """How often each value occurs before."""
    order = np.argsort(values, kind="stable")
    first = np.concatenate(([True], values[order][1:] != values[order][:-1])) if len(values) else np.zeros(0, bool)
    place = np.arange(len(values))
    out = np.zeros(len(values), np.int32)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return out


def support(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Of each pair of neighbour bits, the words that seem to agree among the best SIDE that adjoin the seed, on both sides."""
    unpack = lambda v: (v[:, None] >> (5 * np.arange(2 * SIDE, dtype=np.int64))) & 31
    a, b = unpack(mine), unpack(theirs)
    hit = np.zeros(a.shape, bool)
    for side in (slice(0, SIDE), slice(SIDE, 2 * SIDE)):
        x, y, h = a[:, side], b[:, side], hit[:, side]
        for s in range(-SHIFT, SHIFT + 1):
            lo, hi = max(0, -s), min(SIDE, SIDE - s)
            h[:, lo:hi] |= (x[:, lo:hi] == y[:, lo + s : hi + s]) & (x[:, lo:hi] > 0)
    none = np.zeros((len(a), 1), np.int64)
    before = np.concatenate([none, np.cumsum(hit[:, :SIDE], axis=1)], axis=1)
    behind = np.concatenate([none, np.cumsum(hit[:, SIDE:], axis=1)], axis=1)
    return np.max([before[:, i] + behind[:, SIDE - i] for i in range(SIDE + 1)], axis=0)


#: Agreeing words beside a lone seed that make a stretch with it.
LEAST_SUPPORT = math.ceil(SIMILARITY * STRETCH) - K


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int) -> None:
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        """The largest value at places below ``at``."""
        out = (-1e18, -1)
        while at > 0:
            if self.best[at] > out:
                out = self.best[at]
            at -= at & -at
        return out


def chains(a: np.ndarray, b: np.ndarray, weight: float = K, cost: float = GAP_COST) -> list[list[int]]:
    """Disjoint best chains of matches (a[i], b[i]), as lists of i: both places strictly ascend.

    A chain scores ``weight`` a match less ``cost`` for each word between matches in either text; a match whose best
    predecessor would lower its score begins a new chain.
    """
    # most often the matches form one diagonal
    if (np.diff(a) > 0).all() and (np.diff(b) > 0).all() and (cost * (np.diff(a) + np.diff(b)) < weight).all():
        return [list(range(len(a)))]
    order = np.lexsort((-b, a))
    values = np.unique(b)
    rank = np.searchsorted(values, b[order]).tolist()
    xs, ys = a[order].tolist(), b[order].tolist()
    tree, score, back = Fenwick(len(values)), [0.0] * len(xs), [-1] * len(xs)
    for i, (x, y) in enumerate(zip(xs, ys)):  # of equal a the larger b comes first, so none precedes another
        best, j = tree.upto(rank[i])
        gain = best - cost * (x + y)
        score[i] = weight + max(0.0, gain)
        back[i] = j if gain > 0 else -1
        tree.put(rank[i], (score[i] + cost * (x + y), i))
    used, out, places = [False] * len(xs), [], order.tolist()
    for end in sorted(range(len(xs)), key=lambda i: -score[i]):
        if used[end]:
            continue
        at, chain = end, []
        while True:
            used[at] = True
            chain.append(places[at])
            if back[at] < 0 or used[back[at]]:
                break
            at = back[at]
        out.append(chain[::-1])
    return out


def runs(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """A chain's matches as runs (first a, end a, first b) on one diagonal without a wide gap; runs don't overlap."""
    breaks = np.flatnonzero((np.diff(b - a) != 0) | (np.diff(a) > WINDOW)) + 1
    first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(a)])) - 1
    begin, end, there = a[first].tolist(), (a[last] + K).tolist(), b[first].tolist()
    for i in range(1, len(begin)):  # words that two runs claim belong to the earlier one
        over = max(0, end[i - 1] - begin[i], there[i - 1] + end[i - 1] - begin[i - 1] - there[i])
        begin[i], there[i] = min(begin[i] + over, end[i]), there[i] + over
    return begin, end, there


def aligned(x: np.ndarray, y: np.ndarray, begin: list[int], end: list[int], there: list[int]) -> np.ndarray:
    """Which words of ``x`` have an equal partner in an order-keeping alignment with ``y`` through the given runs.

    Runs are compared on their diagonals, what lies between and beyond them by longest common subsequences; the ends of
    ``x`` meet as many words of ``y`` and a quarter more.
    """
    hit = np.zeros(len(x), bool)
    for p, q, o in zip(begin, end, there):
        hit[p:q] = x[p:q] == y[o : o + q - p]
    for i in range(len(begin) - 1):
        _between(hit, x, y, end[i], begin[i + 1], there[i] + end[i] - begin[i], there[i + 1])
    if p := begin[0]:
        _between(hit, x, y, 0, p, max(0, there[0] - p - p // 4), there[0])
    if (rest := len(x) - end[-1]) > 0:
        at = there[-1] + end[-1] - begin[-1]
        _between(hit, x, y, end[-1], len(x), at, min(len(y), at + rest + rest // 4))
    return hit


def _between(hit: np.ndarray, x: np.ndarray, y: np.ndarray, p: int, q: int, s: int, t: int) -> None:
    """Marks what x[p:q] has in common with y[s:t]."""
    if p < q and s < t:
        if q - p == t - s and (same := x[p:q] == y[s:t]).sum() >= 0.9 * (q - p):  # little is left to gain
            hit[p:q] = same
        else:
            hit[[p + i for i in _common(x[p:q].tolist(), y[s:t].tolist())]] = True


def _common(x: list[int], y: list[int]) -> list[int]:
    """Places in ``x`` of a longest common subsequence, by bit-parallel rows.

    Bit i of row j is 0 where x[:i+1] has one word more in common with y[:j] than x[:i] has.
    """
    where: dict[int, int] = {}
    for i, word in enumerate(x):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = [full]
    for word in y:
        row = rows[-1]
        if both := row & where.get(word, 0):
            row = (row + both | row - both) & full
        rows.append(row)
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
        elif rows[j - 1] is rows[j] or ((1 << i) - 1 & rows[j - 1]).bit_count() == ((1 << i) - 1 & rows[j]).bit_count():
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out


def stretches(hit: np.ndarray, similarity: float = SIMILARITY, least: int = STRETCH) -> list[tuple[int, int]]:
    """Disjoint stretches of at least ``least`` places with ``similarity`` or more hits, best first scoring, in order.

    A hit scores 1 - similarity and a miss -similarity, so the best-scoring stretch has the share; the rest on both sides
    is searched again.
    """
    out, todo = [], [(0, len(hit))]
    gain = np.where(hit, 1 - similarity, -similarity)
    while todo:
        begin, end = todo.pop()
        if end - begin < least:
            continue
        sums = np.concatenate(([0.0], np.cumsum(gain[begin:end])))
        low = np.minimum.accumulate(sums)
        stop = int(np.argmax(sums - low))
        start = int(np.argmin(sums[: stop + 1]))
        if stop <= start:
            continue
        if stop - start >= least:
            out.append((begin + start, begin + stop))
            todo += [(begin, begin + start), (begin + stop, end)]
    return sorted(out)


def merged(spans: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _sized(frame: DataFrame, size: str) -> DataFrame:
    """The written table with a broadcast hint if the sum of its rows' bytes, an SQL expression, allows it."""
    total = frame.agg(F.coalesce(F.sum(F.expr(size)), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(frame) if total <= BROADCAST_BYTES else frame


def _seed_rows(docs: DataFrame) -> DataFrame:
    def fn(c: dict[str, list]) -> dict[str, list]:
        d, r, at, nth, seed, near = [], [], [], [], [], []
        for doc, row, text in zip(c["d"], c["r"], c["t"], strict=True):
            p, h, n = seeds(coded(words(text)))
            nth.append(turns(h))
            d.append(np.full(len(p), doc, np.int64))
            r.append(np.full(len(p), row, np.int64))
            at.append(p)
            seed.append(h)
            near.append(n)
        return {"d": np.concatenate(d), "r": np.concatenate(r), "at": np.concatenate(at), "nth": np.concatenate(nth), "seed": np.concatenate(seed).view(np.int64), "near": np.concatenate(near)}

    return map_rows(docs, fn, "d long, r long, at int, nth int, seed long, near long")


def _by_document(frame: DataFrame, fn: Callable[[list[np.ndarray]], list[tuple]], schema: str, key: list[str], order: list[str]) -> DataFrame:
    """Rows of each key, whole and in order, to ``fn`` as arrays of the columns, which gives rows of ``schema``.

    A key's rows come in one task, in batches of which only an unfinished key's rows are held.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows: list[tuple] = []

        def flush() -> None:
            if held:
                rows.extend(fn([np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]))
                held.clear()

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            keys = columns[: len(key)]
            if held and any(k[0] != h[-1] for k, h in zip(keys, held[-1])):
                flush()
            edges = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
            bounds = [0, *edges.tolist(), batch.num_rows]
            for begin, end in zip(bounds, bounds[1:]):
                if begin:
                    flush()
                held.append([c[begin:end] for c in columns])
            if len(rows) > 4096:
                yield _batch(rows, arrow)
                rows.clear()
        flush()
        if rows:
            yield _batch(rows, arrow)

    return frame.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


CHAIN = "d long, r long, hub long, hub_r long, begin array<int>, end array<int>, there array<int>"


def _chain_rows(columns: list[np.ndarray]) -> list[tuple]:
    """The chains of a document's matches, as runs; those of one seed without support are left out."""
    d, r, hub, hub_r, at, hub_at, mine, theirs = columns
    edges = np.flatnonzero((np.diff(hub) != 0) | (np.diff(hub_r) != 0)) + 1
    bounds = np.concatenate(([0], edges, [len(hub)]))
    sizes = np.diff(bounds)
    good = support(mine, theirs) >= LEAST_SUPPORT
    a, b = at.astype(np.int64), hub_at.astype(np.int64)
    out = []
    for begin, size in zip(bounds[:-1][(sizes > 1) | good[bounds[:-1]]].tolist(), sizes[(sizes > 1) | good[bounds[:-1]]].tolist()):
        here, there = a[begin : begin + size], b[begin : begin + size]
        for chain in chains(here, there) if size > 1 else [[0]]:
            if len(chain) > 1 or good[begin + chain[0]]:
                out.append((int(d[0]), int(r[0]), int(hub[begin]), int(hub_r[begin]), *runs(here[chain], there[chain])))
    return out


def _worded(rows: DataFrame) -> DataFrame:
    """Rows for the alignment, of texts ``t`` with their chains ``own`` and the part that chains to them as hub need.

    kind 0: a hub's words from ``low``, one row a tile; kind 1: a chain and its document's words from ``low``.
    """

    def fn(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("hub", "hub_r", "tile", "kind", "d", "r", "low", "begin", "end", "there", "words")}

        def put(*row) -> None:
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)

        for d, r, text, own, tiles, low, high in zip(*(c[k] for k in ("d", "r", "t", "own", "tiles", "low", "high")), strict=True):
            codes = coded(words(text)).astype(np.uint32)
            if tiles:
                first = max(0, low)
                piece = codes[first:high].tobytes()
                for tile in range(tiles):
                    put(d, r, tile, 0, d, r, first, [], [], [], piece)
            for s in own or []:
                first = max(0, s["begin"][0] - MARGIN)
                put(s["hub"], s["hub_r"], s["tile"], 1, d, r, first, s["begin"], s["end"], s["there"], codes[first : s["end"][-1] + MARGIN].tobytes())
        return out

    ints = "begin array<int>, end array<int>, there array<int>"
    return map_rows(rows, fn, f"hub long, hub_r long, tile int, kind int, d long, r long, low int, {ints}, words binary")


def _spans(rows: DataFrame) -> DataFrame:
    """d, r, start, stop and hub of the stretches of all chains; a task holds one hub's words and one batch at a time."""
    arrow = to_arrow_schema(StructType.fromDDL("d long, r long, start int, stop int, hub long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, y_low = np.zeros(0, np.uint32), 0
        for batch in batches:
            hub, kind, d, r, low = (batch.column(n).to_pylist() for n in ("hub", "kind", "d", "r", "low"))
            begin, end, there, data = (batch.column(n) for n in ("begin", "end", "there", "words"))
            found: list[tuple] = []
            for i in range(batch.num_rows):
                x = np.frombuffer(data[i].as_buffer(), np.uint32)
                if kind[i] == 0:
                    y, y_low = x.copy(), low[i]
                    continue
                p, q, o = ([v - by for v in column[i].as_py()] for column, by in ((begin, low[i]), (end, low[i]), (there, y_low)))
                found += [(d[i], r[i], low[i] + s, low[i] + e, hub[i]) for s, e in stretches(aligned(x, y, p, q, o))]
            if found:
                yield _batch(found, arrow)

    key = ["hub", "hub_r", "tile"]
    return rows.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(run, "d long, r long, start int, stop int, hub long")


def _passage_rows(columns: list[np.ndarray]) -> list[tuple]:
    """(d, r, start, stop, sources) of each passage of a document."""
    d, r, start, stop, hub = columns
    out = []
    for a, b in merged(list(zip(start.tolist(), stop.tolist()))):
        if b - a >= LEAST:
            first, last = np.searchsorted(start, [a, b])  # rows come by start; spans of other passages don't overlap this one
            out.append((int(d[0]), int(r[0]), a, b, np.unique(hub[first:last]).tolist()))
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop (word positions, end exclusive) and sources (doc_ids) of passages that earlier documents have.

    Words are runs without ASCII white space, A-Z lower-cased.  Documents come in the order of doc_id.  A document whose
    text equals an earlier one's is reported whole, with the class's smallest doc_id as source, if it has LEAST words.  Every
    other passage names the earliest documents that hold its seeds; those and all that name them are linked.  Null and short
    texts and rows without doc_id have no passages; rows that repeat both doc_id and text count once; different texts that
    share a doc_id are searched each by itself, and matches within one doc_id do not count.  Texts of any length are
    searched whole, with memory for the words of one of them; an empty table has no passages; other columns are not read.
    """
    return _passages(docs).select("doc_id", "start", "stop", "sources")


def _passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), start, stop and sources of each passage."""
    base = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("d"), utf8("text").alias("t"))
    texts = materialize(base.select("d", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), word_count(F.col("t").cast("string")).cast("int").alias("n")), "passage-texts")
    # tables of minima are written before they are joined: both sides of a join are then plain shuffles, and hot keys can be split
    classes = materialize(texts.groupBy("h1", "h2").agg(F.min("d").alias("rep"), F.count("*").alias("rows")).filter("rows > 1").select("h1", "h2", "rep"), "passage-classes")
    members = texts.join(classes, ["h1", "h2"])
    copies = materialize(members.filter("d <> rep").select("d", "rep", "h1", "n").distinct(), "passage-copies")
    gone = copies.select(F.col("d").alias("c_d"), F.col("h1").alias("c_h1"))
    # of rows that repeat both doc_id and text one is left
    again = materialize(members.filter("d = rep").groupBy("d", "h1").count().filter("count > 1").select(F.col("d").alias("a_d"), F.col("h1").alias("a_h1")), "passage-again")
    keyed = base.withColumn("r", F.xxhash64("t")).join(_sized(gone, "16"), (F.col("d") == F.col("c_d")) & (F.col("r") == F.col("c_h1")), "left_anti")
    repeats = _sized(again, "16")
    same = (F.col("d") == F.col("a_d")) & (F.col("r") == F.col("a_h1"))
    single = keyed.join(repeats, same, "left_anti").unionByName(keyed.join(repeats, same, "left_semi").dropDuplicates(["d", "r"]))

    made = materialize(_seed_rows(single), "passage-seeds")
    shared = made.groupBy("seed").agg(F.min("d").alias("hub"), F.max("d").alias("last")).filter("hub < last").select(F.col("seed").alias("s_seed"), "hub")
    shared = materialize(shared, "passage-shared")
    met = materialize(made.join(shared, F.col("seed") == F.col("s_seed")).select("seed", "hub", "d", "r", "at", "nth", "near"), "passage-met")
    one = Window.partitionBy("seed")  # one document's places of one seed
    placed = met.filter("d = hub").withColumns({"i": F.row_number().over(one.orderBy("r", "at")) - 1, "m": F.count("*").over(one)})
    hubs = materialize(placed.select(F.col("seed").alias("h_seed"), "i", "m", F.col("r").alias("hub_r"), F.col("at").alias("hub_at"), F.col("near").alias("hub_near")), "passage-hubs")
    joined = met.filter("d <> hub").join(hubs.filter("i = 0"), F.col("seed") == F.col("h_seed"))
    several = joined.filter("m > 1").select("d", "r", "hub", "at", "near", F.col("seed").alias("m_seed"), (F.col("nth") % F.col("m")).alias("turn"))
    columns = ["d", "r", "hub", "hub_r", "at", "hub_at", "near", "hub_near"]
    matches = joined.filter("m = 1").select(columns).unionByName(several.join(hubs.filter("m > 1"), (F.col("m_seed") == F.col("h_seed")) & (F.col("turn") == F.col("i"))).select(columns))
    chained = materialize(_by_document(matches, _chain_rows, CHAIN, ["d", "r"], ["hub", "hub_r", "at", "hub_at"]), "passage-chains")

    # a hub's words go to each of its tiles once; each document's text is read once, for its chains and as a hub
    last = lambda c: F.element_at(c, -1)
    reach = chained.select("hub", "hub_r", F.element_at("there", 1).alias("from"), (last("there") + last("end") - last("begin")).alias("to"))
    spread = MARGIN + MARGIN // 4
    hub_parts = reach.groupBy("hub", "hub_r").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), (F.min("from") - spread).alias("low"), (F.max("to") + spread).alias("high"))
    hub_parts = materialize(hub_parts, "passage-hub-parts")
    tiled = chained.join(_sized(hub_parts.select("hub", "hub_r", "tiles"), "20"), ["hub", "hub_r"])
    own = tiled.select("d", "r", F.struct("hub", "hub_r", F.pmod(F.xxhash64("d", "r", "begin"), F.col("tiles")).cast("int").alias("tile"), "begin", "end", "there").alias("c"))
    none = [F.lit(None).cast("int").alias(n) for n in ("tiles", "low", "high")]
    parts = own.select("d", "r", "c", *none).unionByName(hub_parts.select(F.col("hub").alias("d"), F.col("hub_r").alias("r"), F.lit(None).cast(own.schema["c"].dataType).alias("c"), "tiles", "low", "high"))
    wanted = parts.groupBy(F.col("d").alias("w_d"), F.col("r").alias("w_r")).agg(F.collect_list("c").alias("own"), F.max("tiles").alias("tiles"), F.max("low").alias("low"), F.max("high").alias("high"))
    wanted = materialize(wanted, "passage-wanted")
    # texts that nobody wants are left out before the shuffle, as far as the ids of the others may be broadcast
    there = (F.col("d") == F.col("w_d")) & (F.col("r") == F.col("w_r"))
    texts_wanted = single.join(_sized(wanted.select("w_d", "w_r"), "16"), there, "left_semi")
    worded = _worded(texts_wanted.join(wanted.hint("shuffle_hash"), there).select("d", "r", "t", "own", "tiles", "low", "high"))
    spans = materialize(_spans(worded), "passage-spans")
    found = _by_document(spans, _passage_rows, "doc_id long, text_hash long, start int, stop int, sources array<long>", ["d", "r"], ["start", "stop", "hub"])
    whole = copies.filter(F.col("n") >= LEAST).select(F.col("d").alias("doc_id"), F.col("h1").alias("text_hash"), F.lit(0).alias("start"), F.col("n").alias("stop"), F.array("rep").alias("sources"))
    return found.unionByName(whole)


def drop_passages(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, columns as given; a document without other words goes.

    Null and empty texts, rows without doc_id and rows that only repeat an earlier row stay as they are; n_chars, where
    present, follows the text.
    """
    spans, d, r = safe(docs, "cut_spans", "cut_d", "cut_r")
    cut = _passages(docs).groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(r)).agg(F.collect_set(F.struct("start", "stop")).alias(spans))
    joined = docs.join(cut, (F.col("doc_id") == F.col(d)) & (F.xxhash64(utf8("text")) == F.col(r)), "left").drop(d, r)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def fn(c: dict[str, list]) -> dict[str, list]:
        keep = []
        for i, (text, own) in enumerate(zip(c["text"], c[spans], strict=True)):
            if own and text:
                data = text.encode()
                tokens, starts, stops, at = data.split(), [], [], 0
                for t in tokens:
                    at = data.index(t, at)
                    starts.append(at)
                    at += len(t)
                    stops.append(at)
                pieces, begin = [], 0
                for a, b in merged([(s["start"], min(s["stop"], len(tokens))) for s in own]):
                    pieces.append(data[begin : starts[a]])
                    begin = stops[b - 1]
                left = b"".join([*pieces, data[begin:]])
                if not left.split():
                    continue
                c["text"][i] = left.decode()
                if "n_chars" in names:
                    c["n_chars"][i] = len(c["text"][i])
            keep.append(i)
        return {n: [c[n][i] for i in keep] for n in names}

    return map_rows(joined, fn, schema)

"""SimHash near-duplicates with exact Hamming search in vantage-point trees.

Fingerprints are made in tasks; equal ones collapse to one row before anything else.  Pairs within ``bits`` differing bits
are found exactly, in two steps of vantage-point trees:

1. Trees over bands deal fingerprints to shards.  Two fingerprints within ``bits`` bits agree wholly in at least one of
   ``bits + 1`` disjoint bands, so the query ball in that band has radius 0 and overlaps one leaf of the band's tree: the
   fingerprint's own.  A leaf holds as many of the band's values as make shards of about SHARD points.
2. In a shard a tree over all 64 bits, down to LEAF points, is joined with itself: a branch is paired with another only as
   far as the triangle bound allows, that is with the points near the boundary of both.

Why bands come first: in a tree over 64 bits the ball of radius 4 overlaps nearly every shard, as unrelated fingerprints lie
32 bits from a vantage point, give or take 4.  Bands with a ball of radius 1 are no way out either: in a tree over 16 bits
with leaves of 64 values such a ball overlaps 26 of 1754 leaves by the triangle bound.  A shard yields a spanning forest of
its links, never all pairs, and components are joined by label propagation.

Four bits hold copies with few edits only: texts that share 0.8 of their shingles differ by 5 to 17 bits, a ball that no
exact Hamming search prunes.  Where a ``similarity`` is asked for, links between texts that share so many shingles are
therefore added to those of the trees: texts that agree in a band of a MinHash signature meet in a group, whose links by
the whole signature are all followed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import grouped, map_rows, materialize, safe, utf8
from tidewell.llm.components import connected_components

SEED = 42
#: Points that shards should have, about; leaves of a band's tree hold values accordingly, one at least.
SHARD = 64
#: Points of a shard beyond which it is cut into tiles.
TILE = 16_384
#: Points in a leaf of a shard's tree, which are compared with each other directly.
LEAF = 16
#: Hashes of a signature, a byte each; bands of it, and hashes in each, by which texts meet.  Texts that share 0.8 of their
#: shingles meet with a probability of 0.9996.
HASHES, BANDS, ROWS = 512, 20, 5
FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A signature's share of agreeing hashes has a standard error of 0.018 about 0.8; this much below the similarity still links.
SLACK = 0.03
#: Members of a band's group beyond which it is cut into tiles.
BAND_TILE = 4096


def shingles(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the text's shingles.

    A-Z are lower-cased; words are runs without ASCII white space; shingles are joined by one space, repeats included; fewer
    words make one shingle, no words none.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    stops = (starts + sizes)[size - 1 :]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash: bit b is set where over half of the hashes have it; zero without hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def fingerprint(text: bytes, shingle: int = 4) -> int:
    return majority(shingles(text, shingle))


def signature(hashes: np.ndarray) -> bytes:
    """MinHash signature: of each of HASHES multiples of the hashes eight bits of the smallest."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, np.multiply.outer(FACTORS, hashes[at : at + 2048]).min(axis=1), out=least)
    return (least >> np.uint64(20)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, signed: bool = False, keyed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and, if asked for, sig (the signature) and key of every row.

    Null and empty texts have no words: their fingerprint is zero.  Texts of any length are read whole, in time that grows with their
    words; repeated rows give equal rows, an empty table none, and other columns are not read.
    """

    def fn(c: dict[str, list]) -> dict[str, list]:
        hashes = [shingles(t, shingle) for t in c["text"]]
        made = np.array([majority(h) for h in hashes], np.uint64)
        out = {"doc_id": c["doc_id"], "fp": made.view(np.int64)} | ({"key": c["key"]} if keyed else {})
        return out | ({"sig": [signature(h) for h in hashes]} if signed else {})

    rows = docs.select("doc_id", utf8("text").alias("text"), *([_key().alias("key")] if keyed else []))
    schema = "doc_id long, fp long" + ", key struct<no_id: boolean, id: bigint, digest: binary>" * keyed + ", sig binary" * signed
    return map_rows(rows, fn, schema)


@lru_cache(maxsize=8)
def band_leaves(width: int, leaf: int = 1) -> np.ndarray:
    """Leaf of each value of a ``width``-bit band in a vantage-point tree over all of them, a table of 2**width entries.

    Each node takes its first value as vantage point and splits by the median distance to it; a leaf has ``leaf`` values at
    most.
    """
    out = np.zeros(1 << width, np.int32)
    stack, made = [np.arange(1 << width, dtype=np.uint32)], 0
    while stack:
        values = stack.pop()
        if len(values) > leaf:
            d = np.bitwise_count(values ^ values[0])
            near = d <= np.median(d)
            if near.all():
                near = d < d.max()
            stack += [values[near], values[~near]]
        else:
            out[values] = made
            made += 1
    return out


def bands(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of ``bits + 1`` disjoint bands that cover the 64 bits."""
    n = bits + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def roots(self, some: np.ndarray) -> np.ndarray:
        at = self.parent[some]
        while ((up := self.parent[at]) != at).any():
            at = up
        return at

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def link_shard(points: np.ndarray, bits: int, tally: list[int] | None = None) -> np.ndarray:
    """Root position of each point in the forest of all links within ``bits`` among ``points`` (uint64).

    A vantage-point tree joined with itself: the points of a node are cut by the median distance to its first point, each
    side is joined with itself, and both with each other as far as triangle bounds allow.  ``tally`` gets the number of
    distances that were computed.
    """
    forest, seen = Forest(len(points)), 0
    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(points)), None)]
    while stack:
        a, b = stack.pop()
        if b is None:
            if len(a) <= LEAF:
                _link(forest, points, a, a, bits)
                seen += len(a) * (len(a) - 1) // 2
                continue
            d = np.bitwise_count(points[a] ^ points[a[0]]).astype(np.int16)
            seen += len(a)
            mid = np.median(d)
            inner = d <= mid
            if inner.all():
                inner = d < mid
            if not inner.any():  # all at one distance from the first, so it is equal to the others
                half = len(a) // 2
                stack += [(a[:half], None), (a[half:], None), (a[:half], a[half:])]
                continue
            stack += [(a[inner], None), (a[~inner], None), (a[inner & (d >= d[~inner].min() - bits)], a[~inner & (d <= d[inner].max() + bits)])]
        else:
            if not len(a) or not len(b):
                continue
            if len(a) * len(b) <= LEAF * LEAF:
                _link(forest, points, a, b, bits)
                seen += len(a) * len(b)
                continue
            if len(a) < len(b):
                a, b = b, a
            da = np.bitwise_count(points[a] ^ points[a[0]]).astype(np.int16)
            db = np.bitwise_count(points[b] ^ points[a[0]]).astype(np.int16)
            seen += len(a) + len(b)
            mid = np.median(da)
            near = da <= mid
            if near.all():
                near = da < mid
            if not near.any():
                half = len(a) // 2
                stack += [(a[:half], b), (a[half:], b)]
                continue
            stack += [(a[near], b[db <= da[near].max() + bits]), (a[~near], b[db >= da[~near].min() - bits])]
    if tally is not None:
        tally.append(seen)
    return forest.roots(np.arange(len(points)))


def _link(forest: Forest, points: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> None:
    """Joins what lies within ``bits`` between ``a`` and ``b``; pairs already in one tree are passed over at once."""
    near = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= bits
    if a is b:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    ra, rb = forest.roots(a), forest.roots(b)
    while (open_ := near & (ra[:, None] != rb[None, :])).any():
        x, y = np.unravel_index(int(open_.argmax()), open_.shape)
        row = open_[x]
        for root in np.unique(rb[row]).tolist():
            forest.join(int(ra[x]), root)
        ra, rb = forest.roots(a), forest.roots(b)


def hamming_links(distinct: DataFrame, bits: int = 4, spare: int | None = None, tile: int = TILE) -> DataFrame:
    """A spanning set of links (a, b) among the distinct fingerprints ``fp`` that lie within ``bits`` of each other.

    Two such fingerprints agree in ``spare + 1`` of ``bits + 1 + spare`` bands at least, so each choice of that many bands
    deals all fingerprints to shards once.  More spare bands make smaller shards and more copies; by default their number and
    the values of a leaf follow from the count of fingerprints, and the links are the same whatever they are.  A shard of
    more than ``tile`` points is cut into tiles, and each pair of tiles is a group of its own, so no group holds more than
    about two tiles.
    """
    count = distinct.count()
    if spare is None:
        spare = next((s for s in range(4) if count >> (s + 1) * (64 // (bits + 1 + s)) <= tile // 4), 3)
    cut = bands(bits + spare)
    values = max(1, round((SHARD * 2 ** sum(w for _, w in cut[: spare + 1]) / max(1, count)) ** (1 / (spare + 1))))
    chosen = list(combinations(range(len(cut)), spare + 1))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0), dtype=np.int64)
            u = fp.view(np.uint64)
            leaf = [band_leaves(w, values)[((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64)].astype(np.int64) for s, w in cut]
            shard = [sum((leaf[k] << (16 * i) for i, k in enumerate(some)), np.zeros(len(fp), np.int64)) for some in chosen]
            band = np.repeat(np.arange(len(chosen), dtype=np.int32), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.concatenate(shard)), pa.array(np.tile(fp, len(chosen)))], names=["band", "shard", "fp"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped(batches, lambda b: (np.asarray(b.column(0), dtype=np.int64), np.asarray(b.column(1), dtype=np.int64))):
            out = []
            for (fp,) in groups:
                if len(fp) > 1:
                    root = link_shard(fp.view(np.uint64), bits)
                    linked = np.flatnonzero(root != np.arange(len(fp)))
                    out.append((fp[linked], fp[root[linked]]))
            yield _links(out)

    sharded = distinct.select("fp").mapInArrow(leaves, "band int, shard long, fp long")
    large = sharded.groupBy("band", "shard").count().filter(F.col("count") > tile).select("band", "shard", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    groups = _tiles(sharded.join(large, ["band", "shard"], "left"), "band", "shard")
    return groups.repartition("group").sortWithinPartitions("group", "fp").mapInArrow(pairs, "a long, b long")


def _tiles(rows: DataFrame, *key: str, member: str = "fp") -> DataFrame:
    """group and ``member``: the rows of a key are one group, or, where ``tiles`` is set, one for each pair of tiles.

    Groups are told apart by hash: two that fall together are compared needlessly, but only true links are kept.
    """
    mine = F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64(member), F.col("tiles"))).cast("int")
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0))))).withColumn("mine", mine)
    return paired.select(F.xxhash64(*key, F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), member)


def _links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *(x[i] for x in found)])) for i in (0, 1)], names=["a", "b"])


def similar_links(signed: DataFrame, similarity: float = 0.8, tile: int = BAND_TILE) -> DataFrame:
    """Links (a, b) between fingerprints ``fp`` whose signatures ``sig`` tell of that share of common shingles.

    Of a fingerprint all signatures take part.  A group gives a spanning forest of all its links, a link a member at most:
    every member, once it is reached, is compared with all that are not reached yet, so copies that are like one common
    text but unlike each other are joined too.  A group of more than ``tile`` members is cut into tiles as in hamming_links.
    """
    # hashes of different shingles agree in one case of 256
    least = (similarity - SLACK) * 255 / 256 + 1 / 256

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, HASHES)
            return np.asarray(b.column(0), dtype=np.int64), np.asarray(b.column(1), dtype=np.int64), sig

        for groups in grouped(batches, arrays):
            out = []
            for fp, sig in groups:
                rest, reached = np.arange(len(fp)), []
                while len(rest):
                    if not reached:
                        reached, rest = [int(rest[0])], rest[1:]
                    lead = reached.pop()
                    like = (sig[rest] == sig[lead]).mean(axis=1) >= least
                    if like.any():
                        out.append((fp[rest[like]], np.full(int(like.sum()), fp[lead])))
                        reached += rest[like].tolist()
                        rest = rest[~like]
            yield _links(out)

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr("sig", i * ROWS + 1, F.lit(ROWS))))
    signed = signed.withColumn("member", F.xxhash64("fp", "sig"))
    keyed = signed.select("member", F.explode(band).alias("key"))
    # written before it is joined: both sides are then plain shuffles, and a hot key can be split
    met = materialize(keyed.groupBy("key").count().filter("count > 1").select("key", F.when(F.col("count") > tile, F.ceil(F.col("count") / tile)).cast("int").alias("tiles")), "bands-met")
    groups = _tiles(keyed.join(met, "key"), "key", member="member").select("group", F.col("member").alias("g_member"))
    rows = groups.join(signed, F.col("g_member") == F.col("member")).select("group", "fp", "sig")
    return rows.repartition("group").sortWithinPartitions("group", F.xxhash64("group", "fp"), "fp", "sig").mapInArrow(pairs, "a long, b long")


def _components(made: DataFrame, bits: int, spare: int | None, similarity: float | None, *least: Column) -> DataFrame:
    """fp, root and the minima ``least`` over the rows ``made`` (fp and, with a ``similarity``, sig) of each fingerprint."""
    distinct = materialize(made.groupBy("fp").agg(*least), "distinct")
    links = hamming_links(distinct, bits, spare)
    if similarity is not None:
        links = links.unionByName(similar_links(materialize(made.select("fp", "sig").distinct(), "signed"), similarity))
    groups = connected_components(links)
    # few fingerprints have links; the others are components of their own
    rooted = distinct.join(groups, F.col("fp") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("component", "fp")).drop("component")
    # tables that are joined are written first: both sides are then plain shuffles, and a hot component can be split
    return materialize(rooted, "rooted")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4, spare: int | None = None, similarity: float | None = None) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable over links within ``bits`` differing bits.

    With a ``similarity``, texts that share so many of their shingles (intersection over union, by signature) are linked
    as well.  Documents without words share fingerprint zero and are linked like any other; repeated rows fall together;
    null doc_ids count as largest, so a component has a null id only if all its ids are null; an empty table gives no rows.
    """
    made = materialize(fingerprints(docs, shingle, similarity is not None), "fingerprints")
    rooted = _components(made, bits, spare, similarity, F.min("doc_id").alias("first_id"))
    ids = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    named = materialize(rooted.join(ids, "root").select(F.col("fp").alias("d_fp"), "component_id"), "components")
    return made.join(named, F.col("fp") == F.col("d_fp")).select("doc_id", "fp", "component_id")


def _key() -> Column:
    """What tells a document from others: doc_id, null last, and the text's MD5; null texts count as empty."""
    id_ = F.col("doc_id")
    return F.struct(id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id"), F.unhex(F.md5(utf8("text"))).alias("digest"))


def drop_near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """The documents with one row of each near-duplicate component: of its smallest doc_id, null last, that with the least MD5.

    Different texts that share a doc_id, or have none, are documents of their own; of rows that share both doc_id and text
    one stays.  Null, empty and wordless texts are copies of each other; texts of any length are compared whole, and an empty table gives
    no rows.  Columns as given, whatever their names.  Only ids and digests travel to the join, texts are shuffled once.
    """
    made = materialize(fingerprints(docs, shingle, similarity is not None, keyed=True), "fingerprints")
    rooted = _components(made, bits, None, similarity, F.min("key").alias("first"))
    keep = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "kept-keys")
    key, row = safe(docs, "near_key", "near_row")
    keyed = docs.withColumn(key, _key())
    same = [F.col(f"{key}.{c}") == keep[c] for c in keep.columns]
    one = Window.partitionBy(key).orderBy(F.xxhash64(key))
    return keyed.join(keep, same, "left_semi").withColumn(row, F.row_number().over(one)).filter(F.col(row) == 1).select(*docs.columns)

"""Tables of the newest row of each key, kept in buckets: a batch rewrites only the buckets of its keys.

A table is a folder of Parquet folders and numbered manifests.  A manifest names the folder of each bucket, of the rows and of a
count by group that is kept beside them, so one rename commits both; readers see one manifest's state.  What a batch wrote before
it broke off is named by no manifest and changes nothing.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, LongType, StructField, StructType

from tidewell.operators.merge import newest

#: Rows of which a task lists equal ones at a time.
LISTED = 2_000_000


@dataclass
class Manifest:
    version: int
    count: int
    keys: list[str]
    by: str | None = None
    #: The keys that tell a row's bucket.
    place: list[str] = field(default_factory=list)
    schemas: dict[str, dict] = field(default_factory=dict)
    #: Part (rows, counts) to bucket number (as text) to folder.
    folders: dict[str, dict[str, str]] = field(default_factory=lambda: {"rows": {}, "counts": {}})


def _store(spark: SparkSession, path: str) -> tuple[JavaObject, type]:
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    store, at = _store(spark, path)
    place = at(f"{path}/_manifests")
    names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The latest manifest, or that of a version; None where there is no table."""
    versions = _versions(spark, path)
    if not versions:
        return None
    number = versions[-1] if version is None else version
    return Manifest(**json.loads(spark.read.text(f"{path}/_manifests/{number:010}.json", wholetext=True).first()[0]))


def _commit(spark: SparkSession, path: str, made: Manifest) -> None:
    store, at = _store(spark, path)
    final, draft = at(f"{path}/_manifests/{made.version:010}.json"), at(f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = store.create(draft, True)
    out.write(json.dumps(made.__dict__).encode())
    out.close()
    if store.exists(final) or not store.rename(draft, final):
        store.delete(draft, False)
        raise OSError(f"version {made.version} of {path} was committed by another writer")


def _part(spark: SparkSession, path: str, known: Manifest, part: str, buckets: list[int] | None = None) -> DataFrame:
    own = known.folders[part]
    found = [f"{path}/{own[b]}" for b in (own if buckets is None else map(str, buckets)) if b in own]
    schema = StructType.fromJson(known.schemas[part])
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the table."""
    return _part(spark, path, _known(spark, path, version), "rows")


def read_bucket(spark: SparkSession, path: str, bucket: int) -> DataFrame:
    """The rows of one bucket, that is of keys whose ``pmod(xxhash64(keys), count)`` is its number."""
    return _part(spark, path, _known(spark, path), "rows", [bucket])


def read_counts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that each group has, (``by``, n), as kept beside the table; a null group is one of its own."""
    known = _known(spark, path, version)
    if known.by is None:
        raise ValueError(f"{path} keeps no counts")
    return _part(spark, path, known, "counts")


def counts_of(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """The kept counts of some groups, out of their buckets alone."""
    known = _known(spark, path)
    asked = spark.createDataFrame([(g,) for g in groups], StructType([StructType.fromJson(known.schemas["counts"])[known.by]]))
    return _part(spark, path, known, "counts", _touched(asked, [known.by], known.count)).filter(F.col(known.by).isin(groups))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows with one of the ``keys`` (all columns of the key, or those of its place), out of their buckets alone."""
    known = _known(spark, path)
    on = [c for c in known.keys if c in keys.columns]
    return _part(spark, path, known, "rows", _touched(keys, known.place, known.count)).join(keys.select(*on).distinct(), on, "left_semi")


def _known(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    known = manifest(spark, path, version)
    if known is None:
        raise FileNotFoundError(path)
    return known


def _bucket(columns: list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def _touched(frame: DataFrame, columns: list[str], count: int) -> list[int]:
    return sorted(r[0] for r in frame.select(_bucket(columns, count)).distinct().collect())  # at most ``count`` numbers


def _unused(frame: DataFrame, name: str) -> str:
    return next(f"{name}{'_' * i}" for i in range(99) if f"{name}{'_' * i}" not in {c.lower() for c in frame.columns})


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists the last column of rows that agree in all others, ``LISTED`` rows at a time."""

    def listed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        *others, last = rows.column_names
        made = rows.group_by(others).aggregate([(last, "list")]).select([*others, f"{last}_list"]).rename_columns(rows.column_names)
        yield from made.combine_chunks().to_batches(max_chunksize=10_000)

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= LISTED:
            yield from listed(held)
            held, count = [], 0
    if count:
        yield from listed(held)


def _merged(rows: DataFrame, known: Manifest, order: str, name: str, tasks: int) -> DataFrame:
    """The newest row of each key with its bucket ``name``, a bucket in several tasks: rows are shuffled once, whole buckets at that.

    Rows that are nothing but their key are shuffled as lists of its last column, so what they agree in goes along once for many.
    """
    names, share = rows.columns, _unused(rows, "share")
    keys = [*known.place, *(k for k in known.keys if k not in known.place)]
    plain = set(names) == set(keys) and keys[-1] not in known.place and all(isinstance(f.dataType, AtomicType) for f in rows.schema)
    by = F.pmod(F.xxhash64(F.lit(1), *(keys[:-1] if plain else keys)), F.lit(tasks)).cast("int")
    dealt = rows.withColumns({name: _bucket(known.place, known.count), share: by})
    if not plain:
        return newest(dealt.repartition(name, share), known.keys, order, name, share).drop(share)
    dealt = dealt.select(name, share, *keys)
    long_ = isinstance(dealt.schema[keys[-1]].dataType, LongType)
    if long_:  # lists hold the lower 31 bits, their rows the rest
        high = _unused(dealt, "high")
        dealt = dealt.select(name, share, *keys[:-1], F.shiftright(keys[-1], 31).alias(high), F.col(keys[-1]).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias(keys[-1]))
    *others, last = dealt.schema.fields
    lists = dealt.mapInArrow(_lists, StructType([*others, StructField(last.name, ArrayType(last.dataType))])).repartition(name, share)
    each = lists.select(*(f.name for f in others), F.explode(last.name).alias(last.name))
    if long_:
        each = each.withColumn(last.name, F.shiftleft(high, 31).bitwiseOR(F.col(last.name).cast("long"))).drop(high)
    return each.distinct().sortWithinPartitions(name, *keys).select(*names, name)


def _write(frame: DataFrame, path: str, part: str, name: str, known: Manifest, buckets: list[int]) -> None:
    """Writes whole buckets by their column ``name`` and names them in the manifest; a bucket without rows leaves it."""
    folder = f"{part}-{known.version:010}-{uuid.uuid4().hex[:8]}"
    frame.write.partitionBy(name).parquet(f"{path}/{folder}")
    store, at = _store(frame.sparkSession, path)
    own = known.folders[part]
    for b in buckets:
        place = f"{folder}/{name}={b}"
        own.pop(str(b), None)
        if store.exists(at(f"{path}/{place}")):
            own[str(b)] = place


def merge(batch: DataFrame, path: str, keys: list[str], order: str, by: str | None = None, count: int = 64, place: list[str] | None = None) -> list[int]:
    """Merges a batch into the table, newest row of a key by ``order``, and returns the buckets that it rewrote.

    ``by`` names the column whose groups are counted beside the rows: a batch adds what its own keys' rows have changed, read
    from their buckets alone.  ``count`` buckets (with ``by`` and ``keys``) are fixed when the table is made: choose as many as
    make a bucket one task's work.  Rows that agree in ``place``, some of the keys (all by default), share a bucket.  The same batch again leaves rows and counts as they are; an empty one changes nothing.
    Null keys are keys like any other; the batch's columns are those of the table.
    """
    spark = batch.sparkSession
    known = manifest(spark, path)
    if known is None:
        known = Manifest(-1, count, keys, by, place or keys, {"rows": json.loads(batch.schema.json())})
        if by is not None:
            known.schemas["counts"] = json.loads(batch.groupBy(by).agg(F.count("*").alias("n")).schema.json())
    elif (known.keys, known.by) != (keys, by):
        raise ValueError(f"{path} is kept by {known.keys} and counted by {known.by}")
    names = StructType.fromJson(known.schemas["rows"]).names
    buckets = _touched(batch, known.place, known.count)
    if not buckets:
        return []
    known.version += 1
    old = _part(spark, path, known, "rows", buckets)
    rows, before = old.unionByName(batch.select(*names)), dict(known.folders["rows"])
    name = _unused(rows, "bucket")
    tasks = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // len(buckets))  # several shares for a task, so tasks are alike
    _write(_merged(rows, known, order, name, tasks), path, "rows", name, known, buckets)
    if by is not None:
        was = _part(spark, path, Manifest(0, known.count, keys, by, known.place, known.schemas, {"rows": before}), "rows", buckets)
        now = _part(spark, path, known, "rows", buckets)
        # keys that are not in the batch have the same row before and after, so they cancel out
        tally = lambda rows, one: rows.groupBy(by).agg((F.count("*") * one).alias("n"))
        change = tally(now, 1).unionByName(tally(was, -1)).groupBy(by).agg(F.sum("n").alias("n")).filter("n <> 0")
        groups = _touched(change, [by], known.count)
        if groups:
            whole = _part(spark, path, known, "counts", groups).unionByName(change).groupBy(by).agg(F.sum("n").alias("n")).filter("n <> 0")
            name = _unused(whole, "bucket")
            _write(whole.withColumn(name, _bucket([by], known.count)).hint("rebalance", name), path, "counts", name, known, groups)
    _commit(spark, path, known)
    return buckets


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes manifests but the last ``keep`` and the folders that no kept manifest names; returns how many folders went.

    Not while a batch is being merged: what it has written is named by no manifest yet.
    """
    store, at = _store(spark, path)
    versions = _versions(spark, path)
    for v in versions[:-keep]:
        store.delete(at(f"{path}/_manifests/{v:010}.json"), False)
    named = {f for v in versions[-keep:] for own in manifest(spark, path, v).folders.values() for f in own.values()}
    tops = {n.split("/")[0] for n in named}
    gone = 0
    for top in (s.getPath() for s in store.listStatus(at(path)) if s.getPath().getName().startswith(("rows-", "counts-"))):
        if top.getName() not in tops:
            gone += bool(store.delete(top, True))
            continue
        for sub in (s.getPath() for s in store.listStatus(top) if s.isDirectory()):
            if f"{top.getName()}/{sub.getName()}" not in named:
                gone += bool(store.delete(sub, True))
    return gone

"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page_id: a histogram of payload bytes over ranges of ids, refined where ids lie close, is cut into
shards of about equal bytes.  Every task sorts and writes one shard, one gzip member a
record, and rolls to a new file by compressed size.  Headers and digests are made anew from the payload.  Files are written
under temporary names; the names that successful tasks report form the manifest, whose files alone get their final names
and count as written.  A task that is run again writes other temporary names, so lost executors leave nothing behind but
files that the last step removes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewell.llm.common import materialize, n_partitions, utf8

#: Cells of the histogram from which shards are cut, at least, and bits by which a heavy cell is cut further.
RANGES, FINER = 1 << 13, 6
SHARD_BYTES = 512 << 20
ROLL_BYTES = 1 << 30
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 1000
#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_UUID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidewell:warc")
MANIFEST = "shard int, seq int, name string, temporary string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_UUID, f'{page}/{digest}')}>"


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(page: int | None, url: str | None, payload: bytes, date: str, response: int | None, revisit: bool) -> bytes:
    """One record, uncompressed.  ``response``: of a revisit, the page that holds the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    # a header value holds no line breaks and no blanks at its ends
    target = "".join(f"%{b:02X}" if b <= 32 or b == 37 or b >= 127 else chr(b) for b in (url or "").encode())
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target if target else "urn:none"),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).hexdigest())}"),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if url is None:
        fields.append(("X-No-Url", "1"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(response, digest)), ("X-Refers-To-Page-Id", str(response))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one at a time."""
    data = b""
    while True:
        if not data and not (data := stream.read(piece)):
            return
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data and not (data := stream.read(piece)):
                raise ValueError("a record is cut off")
            out.append(unpacker.decompress(data))
            data = unpacker.unused_data
        yield b"".join(out)


def parse(data: bytes) -> dict | None:
    """A record's fields as in RECORD, its digests checked; None for a record of another type."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    fields = {k.lower(): v for k, _, v in (x.decode().partition(": ") for x in lines)}
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{base32(hashlib.sha1(block).hexdigest())}" != fields["warc-block-digest"]:
        raise ValueError(f"a damaged block in {fields['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"a damaged payload in {fields['warc-record-id']}")
    target = fields["warc-target-uri"]
    url = None if "x-no-url" in fields else "" if target == "urn:none" else _unquoted(target)
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "url": url,
        "record_type": kind,
        "refers_to": int(fields["x-refers-to-page-id"]) if kind == "revisit" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _unquoted(target: str) -> str:
    from urllib.parse import unquote_to_bytes

    return unquote_to_bytes(target).decode()


class Ranges:
    """The shard of each row: ranges of page_id of about equal bytes, found by a histogram that is refined where it is heavy.

    A cell is the ids that agree but for their lowest ``shift`` bits.  Cells heavier than a shard are cut into FINER cells
    each, until none is or a cell is a single id (or the rows without one), which is cut into parts by hash of its rows.  So
    no shard is much heavier than the others, however ids are spread, and shards are in the order of ids.  The driver holds
    some RANGES or FINER cells for each shard.
    """

    def __init__(self, info: DataFrame, shards: int | None, shard_bytes: int, least: int) -> None:
        spark = info.sparkSession
        ends = info.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.coalesce(F.sum(F.col("size") + 500), F.lit(0)).alias("b")).first()
        self.count = shards or max(least, -(-ends["b"] // shard_bytes))
        share = max(1, -(-ends["b"] // self.count))
        most = max(RANGES, 4 * self.count)
        shift = next(k for k in range(64) if ((ends["hi"] or 0) >> k) - ((ends["lo"] or 0) >> k) < most)
        self.levels: list[tuple[int, DataFrame]] = []  # of each shift, the cells that are cut further
        cells: list[tuple[int, int, int, int]] = []  # least id, shift, cell, bytes; shift -1: rows without an id
        rows = info.withColumn("cell", F.call_function("shiftright", F.col("page_id"), F.lit(shift)))
        for r in rows.groupBy("cell").agg(F.sum(F.col("size") + 500).alias("b")).collect():
            cells.append((-(1 << 63) - 1, -1, 0, r["b"]) if r["cell"] is None else (r["cell"] << shift, shift, r["cell"], r["b"]))
        while heavy := [c for c in cells if c[1] == shift and shift > 0 and c[3] > share]:
            cut = spark.createDataFrame([(c[2],) for c in heavy], "heavy long")
            self.levels.append((shift, cut))
            gone = set(heavy)
            cells = [c for c in cells if c not in gone]
            rows = info.join(F.broadcast(cut), F.call_function("shiftright", F.col("page_id"), F.lit(shift)) == F.col("heavy"), "left_semi")
            shift = max(0, shift - FINER)
            for r in rows.groupBy(F.call_function("shiftright", F.col("page_id"), F.lit(shift)).alias("cell")).agg(F.sum(F.col("size") + 500).alias("b")).collect():
                cells.append((r["cell"] << shift, shift, r["cell"], r["b"]))
        self.last = shift
        placed, seen = [], 0
        for _, k, cell, size in sorted(cells):
            parts = -(-size // share) if k <= 0 and size > share else 1
            placed.append((k, cell, min(self.count - 1, seen // share), parts))
            seen += size
        self.split = any(p[3] > 1 for p in placed)
        self.table = spark.createDataFrame(placed, "r_shift int, r_cell long, first int, parts int")

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` (page_id, kind, url, payload, ...) with ``shard``; rows of kind 0 come to each part of their id."""
        levels = [*(k for k, _ in self.levels), self.last]
        shift = F.lit(levels[0])
        for i, (k, cut) in enumerate(self.levels):
            flag = F.broadcast(cut.select(F.col("heavy").alias(f"heavy{i}")))
            rows = rows.join(flag, F.call_function("shiftright", F.col("page_id"), F.lit(k)) == F.col(f"heavy{i}"), "left")
            shift = F.when(F.col(f"heavy{i}").isNotNull(), levels[i + 1]).otherwise(shift)
        shift = F.when(F.col("page_id").isNull(), -1).otherwise(shift).cast("int")
        keyed = rows.withColumn("shift", shift).withColumn("cell", F.when(F.col("shift") < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("page_id"), F.greatest("shift", F.lit(0)))))
        # cells: some RANGES, or FINER for each shard
        found = keyed.join(F.broadcast(self.table), (F.col("shift") == F.col("r_shift")) & (F.col("cell") == F.col("r_cell")))
        if not self.split:
            return found.withColumn("shard", F.col("first"))
        own = F.array(F.pmod(F.xxhash64("url", "payload"), F.col("parts")).cast("int"))
        part = F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own))
        return found.withColumn("part", part).withColumn("shard", F.least(F.col("first") + F.col("part"), F.lit(self.count - 1)))


def write_warc(
    pages: DataFrame,
    path: str,
    shards: int | None = None,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    date: str = "2024-01-01T00:00:00Z",
    prefix: str = "pages",
) -> DataFrame:
    """Writes a record for each row (page_id, url, html) under ``path`` and returns the manifest.

    Null html is an empty payload; null and empty urls are told apart.  Of rows with equal payloads of LEAST_REVISIT bytes
    or more, those with the largest page_id are responses and the others revisit it; rows without page_id count as
    smallest, and stay responses where no row of the payload has an id.  Rows that repeat wholly give as many records.
    Other columns are not read; an empty table gives an empty manifest.  For given rows, shards and limits all files are the
    same bytes whatever the order of the input.  A record is made in memory whole, so a task needs some times its longest payload.
    """
    spark = pages.sparkSession
    path = qualified(spark, path)
    info = materialize(pages.select("page_id", F.length(utf8("html")).cast("long").alias("size"), F.sha1(utf8("html")).alias("digest")), "warc-info")
    ranges = Ranges(info, shards, shard_bytes, n_partitions(spark))
    count = ranges.count
    large = info.filter(F.col("size") >= LEAST_REVISIT)
    copies = large.groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("keep").isNotNull())
    # written before it is joined: both sides are then plain shuffles, and a hot digest can be split
    copies = materialize(copies, "warc-copies")
    revisits = (
        large.join(copies.drop("n"), ["digest", "size"])
        .filter(~F.col("page_id").eqNullSafe(F.col("keep")))
        .select("page_id", "digest", "keep")
        .distinct()
    )
    # a revisit's target travels to the page's shard as a row of its own, so pages are shuffled once
    rows = revisits.select("page_id", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(b"").alias("payload"), "keep").unionByName(
        pages.select("page_id", F.lit(1).alias("kind"), "url", utf8("html").alias("payload"), F.lit(None).cast("long").alias("keep"))
    )
    sorted_ = (
        ranges.assign(rows)
        .repartitionById(count, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "kind", F.asc_nulls_first("url"), F.sha1("payload"))
        .select("shard", "page_id", "kind", "url", "payload", "keep")
    )
    work = f"{path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"
    _mkdirs(spark, work)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(work)
        roll: Roll | None = None
        targets: dict[str, int] = {}
        last: tuple = ()
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                shard, page_id, kind, url, payload, keep = (c[i].as_py() for c in columns)
                if roll is None or roll.shard != shard:
                    if roll:
                        yield from roll.close()
                    roll, last = Roll(folder, prefix, shard, roll_bytes), ()
                if (page_id,) != last:
                    last, targets = (page_id,), {}
                if kind == 0:
                    targets[url] = keep
                    continue
                response = targets.get(hashlib.sha1(payload).hexdigest()) if targets and len(payload) >= LEAST_REVISIT else None
                yield from roll.add(member(record(page_id, url, payload, date, response, response is not None)))
        if roll:
            yield from roll.close()

    written = materialize(sorted_.mapInArrow(write, MANIFEST), "warc-written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, target = Folder(work), Folder(path)
        for batch in batches:
            for r in batch.to_pylist():
                source.move(r["temporary"], target, r["name"], r["bytes"])
            yield batch

    parts = min(count, n_partitions(spark))
    committed = written.repartition(parts, "name").mapInArrow(commit, MANIFEST).drop("temporary")
    committed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")
    _delete(spark, work)
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


class Folder:
    """A folder of any store that pyarrow reaches, opened in the task; ``uri`` is qualified, see ``qualified``."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///", 1))

    def create(self, name: str):
        return self.store.open_output_stream(f"{self.path}/{name}", compression=None)

    def open(self, name: str):
        return self.store.open_input_stream(f"{self.path}/{name}", compression=None)

    def move(self, name: str, to: Folder, new: str, size: int) -> None:
        """Renames a file; one that an earlier attempt renamed is left."""
        info = self.store.get_file_info(f"{self.path}/{name}")
        if info.type == pafs.FileType.File:
            self.store.move(info.path, f"{to.path}/{new}")
        elif to.store.get_file_info(f"{to.path}/{new}").size != size:
            raise FileNotFoundError(f"{name} is gone and {new} isn't whole")


class Roll:
    """The files of one shard: a new one begins where a record would lead beyond ``limit`` bytes."""

    def __init__(self, folder: Folder, prefix: str, shard: int, limit: int) -> None:
        self.folder, self.prefix, self.shard, self.limit, self.seq, self.out = folder, prefix, shard, limit, 0, None

    def add(self, data: bytes) -> Iterator[pa.RecordBatch]:
        if self.out is not None and self.bytes + len(data) > self.limit:
            yield from self.close()
            self.seq += 1
        if self.out is None:
            self.name = f"{self.prefix}-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.name}.{uuid.uuid4().hex}"
            self.out, self.records, self.bytes, self.digest = self.folder.create(self.temporary), 0, 0, hashlib.sha1()
            info = VERSION + b"\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id(None, self.name).encode()
            body = b"format: WARC File Format 1.1\r\n"
            self._put(member(info + f"\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.out is not None:
            self.out.close()
            self.out = None
            row = {"shard": self.shard, "seq": self.seq, "name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha1": self.digest.hexdigest()}
            kinds = {"shard": pa.int32(), "seq": pa.int32(), "records": pa.int64(), "bytes": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.string())) for k, v in row.items()})


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, by the cluster's default file system, so that driver and tasks mean one place."""
    store, target = _hadoop(spark, path.rstrip("/"))
    return store.makeQualified(target).toString()


def _mkdirs(spark: SparkSession, path: str) -> None:
    store, target = _hadoop(spark, path)
    store.mkdirs(target)


def _delete(spark: SparkSession, path: str) -> None:
    store, target = _hadoop(spark, path)
    store.delete(target, True)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the manifest's files; damaged blocks, payloads and record counts raise an error."""
    path = qualified(spark, path)
    files = spark.read.parquet(f"{path.rstrip('/')}/manifest").select("name", "records")
    schema = RECORD if payloads else RECORD.replace(", payload binary", "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(path)
        for batch in batches:
            for f in batch.to_pylist():
                seen, held, rows = 0, 0, []
                with folder.open(f["name"]) as stream:
                    for data in members(stream):
                        if (row := parse(data)) is None:
                            continue
                        seen += 1
                        rows.append(row)
                        held += len(row["payload"] or b"") if payloads else 0
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist([{k.name: r[k.name] for k in arrow} for r in rows], schema=arrow)
                            rows, held = [], 0
                if seen != f["records"]:
                    raise ValueError(f"{f['name']} has {seen} records; the manifest says {f['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist([{k.name: r[k.name] for k in arrow} for r in rows], schema=arrow)

    return files.repartition(n_partitions(spark), "name").mapInArrow(read, schema)

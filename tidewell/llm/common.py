"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.scratch import materialize, scratch  # noqa: F401

#: Java regular expression of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(
    frame: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, *, limit_bytes: int = 8 << 20
) -> DataFrame:
    """mapInArrow over column lists; a batch is cut into pieces of about ``limit_bytes`` so that long texts stay bounded."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            pieces = max(1, min(rows, -(-batch.nbytes // limit_bytes)))
            step = max(1, -(-rows // pieces))
            for at in range(0, rows, step):
                part = batch.slice(at, step)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                made = fn(columns)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return frame.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The groups of rows that come sorted by the first of ``arrays``, each whole, as tuples of the other arrays; a list a batch."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        now = arrays(batch)
        held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        edges = [0, *(np.flatnonzero(np.diff(held[0])) + 1).tolist()]
        yield [tuple(x[a:b] for x in held[1:]) for a, b in zip(edges, edges[1:])]
        held = tuple(x[edges[-1] :] for x in held)
    if held is not None:
        yield [held[1:]]


def safe(frame: DataFrame, *names: str) -> list[str]:
    """Fresh column names with the given stems that clash with no column of ``frame``."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: str) -> Column:
    """The column's UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))

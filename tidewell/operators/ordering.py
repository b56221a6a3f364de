"""Places in an order over data of any size: no group, and not the whole table, is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.scratch import materialize


def numbered(frame: DataFrame, by: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """``frame`` with each row's place (long, from 1) in its group of ``by`` (all rows if empty) in ascending ``order``.

    Rows are dealt out by range over group and order, sorted, numbered and written; a row's place is its number in its
    partition plus the group's rows in the partitions before.  Only counts per group and partition are summed up in order.
    Nulls come first and are a group of their own; rows equal in ``order`` are numbered in any order.  Other columns stay.
    """
    taken = {c.lower() for c in frame.columns}
    at, part, shift, *keys = (next(f"{'_' * i}{n}" for i in range(99) if f"{'_' * i}{n}".lower() not in taken) for n in ("at", "part", "shift", *(f"of_{c}" for c in by)))
    count = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(count, *by, *order).sortWithinPartitions(*by, *order).withColumn(at, F.monotonically_increasing_id())
    dealt = materialize(dealt, "ordered").withColumn(part, F.shiftright(at, 33))
    runs = dealt.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), part).agg(F.min(at).alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, F.col(part).alias(f"{part}_"), (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias(shift))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)] + [F.col(part) == F.col(f"{part}_")]
    return dealt.join(runs, same).select(*frame.columns, (F.col(at) + F.col(shift)).alias(name))

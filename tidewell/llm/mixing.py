"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  ``target / size`` is the number of copies that each of its documents should
have on average.  The whole part is allocated for certain; the fraction is an inclusion probability ``p``, and documents
are ranked by random odds over inclusion odds, ``(u / (1-u)) / (p / (1-p))``, lowest first, until the source's remaining
words are used up.  A per-document ``weight`` makes the probabilities unequal.

The prefix of a ranking is found without sorting a source in one task: ranks fall into ``BUCKETS`` buckets, the words of
each (source, bucket) are summed with map-side combine, and only documents of the bucket where the words run out, and a few
behind it, meet in one group, where a greedy pass fills the gap with documents that still fit.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, materialize, safe

BUCKETS = 1 << 16
#: Documents behind the boundary bucket that may fill the gap left by a document that does not fit.
FILL = 256
#: Equal rows that one task spreads again.
PIECE = 10_000
#: Sources listed in one mixture; more raise an error, as targets are computed on the driver.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: Iterable[tuple[str | None, int]], weights: Iterable[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0
) -> list[tuple[str | None, int, float]]:
    """(source, size, target) for each source, in code point order with null last.

    Weights repeat along that order and share ``total`` times all words.  A target stops at ``cap`` times its source's
    size; what is above is shared again by weight among the others until none is above.
    """
    cycle = list(weights)
    ranked = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [cycle[i % len(cycle)] for i in range(len(ranked))]
    target = [0.0] * len(ranked)
    left, open_ = total * sum(s for _, s in ranked), set(range(len(ranked)))
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if share * weight[i] > cap * ranked[i][1]}
        for i in full or open_:
            target[i] = float(cap * ranked[i][1]) if full else share * weight[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ -= full
    return [(name, size, t) for (name, size), t in zip(ranked, target, strict=True)]


def mix(
    docs: DataFrame,
    weights: Iterable[float] = (5, 2, 1),
    total: float = 1.5,
    cap: float = 2.0,
    weight: Column | None = None,
    seed: int = 11,
) -> DataFrame:
    """Copies to take of every document: doc_id, source, row_hash, size, source_size, target,
    copies, taken.

    One row for each row of ``docs``.  ``weight`` scales the copies expected of a document (null or negative: 0); without
    it all documents of a source are alike.  Copies lie between 0 and ``cap`` rounded up; a document without words is
    never taken.  The draw depends on the seed, doc_id and text alone, so reruns agree and equal rows, being
    interchangeable, yield the same multiset.  Null texts have no words; null sources form one source; an empty table
    gives an empty result; texts of any length are counted whole; further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.xxhash64("doc_id", "source", "text").alias("row_hash"),
            word_count(F.col("text")).alias("size"),
            (F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("w"),
            # 53 random bits, strictly between 0 and 1
            ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), 11) + 0.5) / float(1 << 53)).alias("u"),
        ),
        "mix",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("s"), F.sum(F.col("w") * F.col("size")).alias("ws")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weighed = {r["source"]: r["ws"] for r in sources}
    rows = [(n, s, t, t / weighed[n] if weighed[n] else 0.0) for n, s, t in source_targets([(r["source"], r["s"]) for r in sources], weights, total, cap)]
    targets = F.broadcast(spark.createDataFrame(rows, "t_source string, source_size long, target double, ratio double"))

    wanted = F.least(F.col("ratio") * F.col("w"), F.lit(float(cap)))
    p = F.col("want") - F.col("certain")
    keyed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
        .withColumn("want", F.when(F.col("size") > 0, wanted).otherwise(0.0))
        .withColumn("certain", F.floor("want").cast("int"))
        .withColumn("p", p)
        # odds ratio q mapped to q / (1 + q), which is monotone and lies in [0, 1]
        .withColumn("rank", F.when(F.col("p") > 0, F.expr("u * (1 - p) / (u * (1 - p) + (1 - u) * p)")))
        .withColumn("bucket", F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1))).cast("int"))
        .drop("w", "u")
    )
    upto = Window.partitionBy("source").orderBy("bucket")
    counts = (
        keyed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target"))
        .withColumn("room", F.col("target") - F.sum("sure").over(Window.partitionBy("source")))
        .filter(F.col("bucket").isNotNull())
        .withColumn("upto", F.sum("words").over(upto))
        .withColumn("seen", F.sum("n").over(upto))
    )
    # of each source: the bucket in which the room ends, the room left at its start, and the last bucket that may fill gaps
    last = (
        counts.filter(F.col("upto") > F.col("room"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("room") - F.col("upto") + F.col("words")).alias("room"), "seen")).alias("b"))
        .select(F.col("source").alias("b_source"), F.col("b.bucket").alias("edge"), F.col("b.room").alias("room"), F.col("b.seen").alias("edge_seen"))
    )
    fill = (
        counts.select("source", "bucket", "seen", "n")
        .join(last, F.col("source").eqNullSafe(F.col("b_source")))
        .filter((F.col("bucket") >= F.col("edge")) & ((F.col("bucket") == F.col("edge")) | (F.col("seen") - F.col("n") < F.col("edge_seen") + FILL)))
        .groupBy("b_source", "edge", "room")
        .agg(F.max("bucket").alias("fill_to"))
    )
    # at most one row a source, so at most MAX_SOURCES rows
    placed = keyed.join(F.broadcast(fill), F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
    near = F.col("bucket").isNotNull() & F.col("edge").isNotNull() & (F.col("bucket") >= F.col("edge")) & (F.col("bucket") <= F.col("fill_to"))
    out = ["doc_id", "source", "row_hash", "size", "source_size", "target", "copies"]
    extra = F.when(F.col("bucket").isNotNull() & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))), 1).otherwise(0)
    clear = placed.filter(~near).withColumn("copies", F.col("certain") + extra).select(*out)
    # rows that repeat wholly share a rank: they come to the draw as one row with their number, and are spread again behind it
    key = ["doc_id", "source", "row_hash", "size", "source_size", "target", "certain", "room", "rank"]
    counted = placed.filter(near).groupBy(key).agg(F.count("*").alias("n"))
    drawn = counted.groupBy("source").applyInPandas(_fill, "doc_id long, source string, row_hash long, size long, source_size long, target double, copies int, n long")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))
    pieces = drawn.select("*", piece.alias("piece")).repartition("doc_id", "piece")
    spread = pieces.select(*out, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE))))
    return clear.unionByName(spread.select(*out)).withColumn("taken", F.col("copies") * F.col("size"))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Take documents in rank order while they fit; at the end one that overshoots by less than the gap may still go in.

    A row stands for ``n`` equal ones; what comes back are rows of those taken and of those left, with their numbers.
    """
    rows = rows.sort_values(["rank", "doc_id", "size"], kind="stable", ignore_index=True)
    room, took = float(rows["room"].iloc[0]), []
    for size, n in zip(rows["size"].tolist(), rows["n"].tolist()):
        took.append(min(n, int(max(room, 0.0) // size)))
        room -= took[-1] * size
    best = min(((abs(room - s), i) for i, (s, n) in enumerate(zip(rows["size"], rows["n"])) if took[i] < n), default=(room, -1))
    if best[0] < room:
        took[best[1]] += 1
    took = pd.Series(took, dtype="int64")
    out = pd.concat([rows.assign(copies=rows["certain"] + 1, n=took), rows.assign(copies=rows["certain"], n=rows["n"] - took)])
    return out[out["n"] > 0][["doc_id", "source", "row_hash", "size", "source_size", "target", "copies", "n"]].astype({"copies": "int32"})


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it (not at all, once or more), columns as given.

    Rows that agree in doc_id, source and text get together what the mix gives them.
    """
    id_, hash_, total, rows, n, row, m_id, m_hash = safe(docs, "mix_id", "mix_hash", "mix_total", "mix_rows", "mix_n", "mix_row", "m_id", "m_hash")
    counts = (
        mix(docs, **options)
        .groupBy(F.coalesce("doc_id", F.lit(0)).alias(m_id), F.col("row_hash").alias(m_hash))
        .agg(F.sum("copies").alias(total), F.count("*").alias(rows))
        .filter(F.col(total) > 0)
    )
    keyed = docs.withColumns({id_: F.coalesce("doc_id", F.lit(0)), hash_: F.xxhash64("doc_id", "source", "text")})

    def joined(some: DataFrame) -> DataFrame:
        return keyed.join(some, (F.col(id_) == F.col(m_id)) & (F.col(hash_) == F.col(m_hash)))

    one = joined(counts.filter(F.col(rows) == 1)).withColumn(n, F.col(total))
    several = joined(counts.filter(F.col(rows) > 1)).withColumn(row, F.row_number().over(Window.partitionBy(id_, hash_).orderBy(id_)))
    shared = F.floor(F.col(total) / F.col(rows)) + (F.col(row) <= F.col(total) % F.col(rows)).cast("int")
    both = one.select(*docs.columns, n).unionByName(several.withColumn(n, shared).select(*docs.columns, n))
    return both.filter(F.col(n) > 0).withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)

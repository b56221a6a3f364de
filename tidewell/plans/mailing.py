"""A digest run: who is due, what each gets, and the ledger that makes a rerun harmless."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import browse, digest, merge
from tidewell.sources import keyed as tables


def pool(events: DataFrame, now: datetime, hidden: tuple[str, ...] = (), umbrella: str = "umbrella", days: int = 30) -> DataFrame:
    """Published events of the next ``days`` without hidden festival children."""
    soon = F.col("start_at").between(F.lit(now), F.lit(now) + F.expr(f"INTERVAL {days} DAYS"))
    return events.filter((F.col("status") == "published") & soon & browse.visible(F.col("tags"), hidden, umbrella))


def keyed(subscribers: DataFrame, now: datetime, session: str = "all") -> DataFrame:
    """Subscribers with the key under which this day's mail is recorded."""
    return subscribers.withColumn("key", F.concat(F.lit(f"digest-{now:%Y-%m-%d}/"), F.col("sub_id").cast("string"), F.lit(f"/{session}")))


def run(events: DataFrame, subscribers: DataFrame, ledger: DataFrame, now: datetime) -> DataFrame:
    """(key, sub_id, id, place) of the mails to send: due subscribers that the ledger (key) has not, with their picks.

    One job does what a chain of small invocations would; started again after a failure it plans only what was not recorded.
    """
    due = merge.due(subscribers.withColumn("id", F.col("sub_id")), (now.weekday() + 1) % 7, now.day).drop("id")
    todo = keyed(due, now).join(ledger.select("key"), "key", "left_anti")
    kinds, members = digest.profiles(todo)
    base = digest.base_score(F.col("price_min"), F.col("price_max"), F.col("description"), F.col("ticket_url"))
    found = digest.matches(events, kinds, now).join(events, "id").select("profile", "id", "start_at", "org", "featured", F.col("image_url").isNotNull().alias("image"), base.alias("base"))
    return digest.digest(found, members, now.date()).join(todo.select("sub_id", "key"), "sub_id").select("key", "sub_id", "id", "place")


def recorded(ledger: DataFrame, sent: DataFrame, now: datetime) -> DataFrame:
    """The ledger with each sent key once."""
    new = sent.select("key").distinct().join(ledger.select("key"), "key", "left_anti").withColumn("sent_at", F.lit(now))
    return ledger.unionByName(new)


def send_slices(mails: DataFrame, path: str, send: Callable[[DataFrame], DataFrame], slices: int = 16) -> None:
    """Sends each mail (key, body, both text) once, slice by slice, with a ledger at ``path`` that a later run goes on from.

    A slice is a bucket of the ledger.  Its mails that the ledger has not are claimed, bodies and all, in one commit; those
    claimed are sent, and their outcome is one more commit.  ``send`` takes (key, body) and returns (key, status) of what it knows of;
    a mail without an outcome counts as failed.  A run that breaks off leaves slices that are done, a claimed one, or untouched
    ones: the next run hands what was claimed to ``send`` again with the same keys and bodies, by which a receiver knows
    repeats, plans the rest, and leaves finished mails alone.  Mails without a key go nowhere; of equal keys one is sent.
    ``slices`` is fixed by the first run.
    """
    spark = mails.sparkSession
    known = tables.manifest(spark, path)
    count = known.count if known else slices
    mine: Column = F.pmod(F.xxhash64("key"), F.lit(count))
    wanted = mails.filter("key IS NOT NULL").select("key", "body").groupBy("key").agg(F.min("body").alias("body"))

    def record(rows: DataFrame, step: int) -> None:
        tables.merge(rows.select("key", "body", "status", F.lit(step).alias("step")), path, ["key"], "step", "status", count)

    for i in range(count):
        part = wanted.filter(mine == i)
        if tables.manifest(spark, path) is not None:
            part = part.join(tables.read_bucket(spark, path, i).select("key"), "key", "left_anti")
        record(part.withColumn("status", F.lit("claimed")), 1)
        if tables.manifest(spark, path) is None:
            continue  # no mail so far
        claimed = tables.read_bucket(spark, path, i).filter("status = 'claimed'").select("key", "body")
        if not claimed.isEmpty():
            record(merge.attributed(send(claimed).select("key", "status").dropDuplicates(["key"]), claimed, "key"), 2)

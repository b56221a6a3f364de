"""Structured Streaming: the run log, request limits, ledgers and bridges as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATE_MOST, GATE_MINUTES = 120, 10


def run_windows(runs: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Runs and events found by scraper and day, with late rows accepted up to the watermark."""
    return runs.withWatermark("ran_at", late).groupBy(F.window("ran_at", width), "scraper").agg(F.count("*").alias("runs"), F.sum("found").alias("found"), F.count_if(F.col("status") == "error").alias("errors")).select(F.col("window.start").alias("day"), "scraper", "runs", "found", "errors")


def bursts(runs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of runs without a pause longer than ``gap``."""
    return runs.withWatermark("ran_at", late).groupBy(F.session_window("ran_at", gap), "scraper").agg(F.count("*").alias("runs")).select(F.col("session_window.start").alias("start"), "scraper", "runs")


def once(notices: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once, kept only as long as the watermark needs."""
    return notices.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def _gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    began, count = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["at", "call"], kind="stable")
    allowed = []
    for at in rows["at"]:
        micros = int(at.value // 1000)
        if began is None or micros - began > GATE_MINUTES * 60_000_000:
            began, count = micros, 1
            allowed.append(True)
        elif count >= GATE_MOST:
            allowed.append(False)
        else:
            count += 1
            allowed.append(True)
    state.update((began, count))
    yield pd.DataFrame({"plan_id": key[0], "call": rows["call"].to_numpy(), "allowed": allowed})


def mutation_gate(calls: DataFrame) -> DataFrame:
    """Calls (plan_id, call, at) with whether they are allowed: at most 120 in a window that restarts ten minutes after it began."""
    return calls.groupBy("plan_id").applyInPandasWithState(_gate, "plan_id long, call long, allowed boolean", "began long, count long", "append", GroupStateTimeout.NoTimeout)


def gated(calls: DataFrame) -> DataFrame:
    """The same gate over a finished set of calls."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        class Once:
            exists = False

            def update(self, value: tuple) -> None:
                pass

        return next(_gate((rows["plan_id"].iloc[0],), iter([rows]), Once()))

    return calls.groupBy("plan_id").applyInPandas(run, "plan_id long, call long, allowed boolean")


def draft(actions: DataFrame, most: int = 30) -> DataFrame:
    """Plan drafts from actions (plan_id, seq, action, event_id, at): adding again keeps the first time, at most ``most`` items."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items: dict[int, pd.Timestamp] = {}
        first: dict[int, pd.Timestamp] = {}
        for r in rows.sort_values("seq").itertuples():
            if r.action == "remove":
                items.pop(r.event_id, None)
            elif r.event_id in items or len(items) < most:
                items[r.event_id] = first.setdefault(r.event_id, r.at)
        return pd.DataFrame({"plan_id": rows["plan_id"].iloc[0], "event_id": list(items), "added_at": list(items.values())})

    return actions.groupBy("plan_id").applyInPandas(run, "plan_id long, event_id long, added_at timestamp")


def upsert_each(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, by: str | None = None, count: int = 64) -> StreamingQuery:
    """Keeps a table (``tidewell.sources.keyed``) of the newest row of each key, and counts of the groups of ``by``.

    A batch rewrites only the buckets of its keys; one that is run again gives the same table.
    """
    from tidewell.sources.keyed import merge

    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch, path, keys, order, by, count)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

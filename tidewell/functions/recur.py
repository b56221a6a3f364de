"""Recurring calendar entries: rules to dates, one row for each occurrence.

Dates come from calendar arithmetic on the driver-free side of a ``mapInPandas``; instants come from Spark's zone rules afterwards.
"""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import times

WEEKDAYS = {"MO": 0, "TU": 1, "WE": 2, "TH": 3, "FR": 4, "SA": 5, "SU": 6}
WINDOW_DAYS, MOST = 120, 200


def parse_rule(rule: str | None) -> dict[str, str]:
    return {k.strip().upper(): v.strip() for k, _, v in (p.partition("=") for p in (rule or "").split(";")) if v}


def nth(year: int, month: int, weekday: int, n: int) -> date | None:
    """n-th weekday (0 = Monday) of a month, negative from its end."""
    days = monthrange(year, month)[1]
    if n > 0:
        day = 1 + (weekday - date(year, month, 1).weekday()) % 7 + 7 * (n - 1)
    else:
        day = days - (date(year, month, days).weekday() - weekday) % 7 + 7 * (n + 1)
    return date(year, month, day) if 1 <= day <= days else None


def series(rule: dict[str, str], first: date, last: date) -> Iterator[date]:
    """Dates of DAILY, WEEKLY (BYDAY) and MONTHLY (n-th weekdays, or the day of the first date) rules up to ``last``."""
    every = max(1, int(rule.get("INTERVAL") or 1))
    days = [d.strip() for d in rule.get("BYDAY", "").split(",") if d.strip()]
    match rule.get("FREQ", "").upper():
        case "DAILY":
            while first <= last:
                yield first
                first += timedelta(every)
        case "WEEKLY":
            wanted = {WEEKDAYS[d[-2:]] for d in days if d[-2:] in WEEKDAYS} or {first.weekday()}
            monday, day = first - timedelta(first.weekday()), first
            while day <= last:
                if day.weekday() in wanted and (day - monday).days // 7 % every == 0:
                    yield day
                day += timedelta(1)
        case "MONTHLY":
            year, month = first.year, first.month
            while date(year, month, 1) <= last:
                if days:
                    made = [nth(year, month, WEEKDAYS[d[-2:]], int(d[:-2] or 1)) for d in days if d[-2:] in WEEKDAYS]
                else:
                    made = [date(year, month, first.day)] if first.day <= monthrange(year, month)[1] else []
                yield from (d for d in made if d)
                month += every
                year, month = year + (month - 1) // 12, (month - 1) % 12 + 1


def occurrences(rule: str, start: str, until: date | None, since: datetime, days: int = WINDOW_DAYS) -> list[date]:
    """Civil dates of a rule up to a day past the window; COUNT counts every date, also those outside the window."""
    parsed = parse_rule(rule)
    first = datetime.strptime(start[:8], "%Y%m%d").date()
    end = (since + timedelta(days=days + 1)).date()
    out = []
    for i, d in enumerate(series(parsed, first, min(end, until) if until else end)):
        if parsed.get("COUNT") and i >= int(parsed["COUNT"]):
            break
        out.append(d)
    return out


def expand(entries: DataFrame, since: datetime, days: int = WINDOW_DAYS, most: int = MOST) -> DataFrame:
    """Entries (uid, summary, dtstart, tzid, rrule, exdates, minutes) as (uid, summary, start_at, end_at), one row an occurrence.

    Entries without a rule or of another frequency stay one row.  UNTIL is an instant or a day; exceptions are dropped after COUNT
    has counted them; at most ``most`` occurrences of an entry inside the window are kept, earliest first.
    """
    schema = "uid string, summary string, dtstart string, tzid string, exdates array<string>, minutes int, rule string, series_uid string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                rule = parse_rule(r["rrule"])
                start = r["dtstart"] or ""
                if rule.get("FREQ", "").upper() not in ("DAILY", "WEEKLY", "MONTHLY") or not start[:8].isdigit():
                    rows.append((r["uid"], r["summary"], start, r["tzid"], r["exdates"], r["minutes"], None, r["uid"]))
                    continue
                last = datetime.strptime(rule["UNTIL"][:8], "%Y%m%d").date() + timedelta(1) if rule.get("UNTIL", "")[:8].isdigit() else None
                for d in occurrences(r["rrule"], start, last, since, days):
                    rows.append((f"{r['uid']}_{d:%Y%m%d}", r["summary"], f"{d:%Y%m%d}{start[8:]}", r["tzid"], r["exdates"], r["minutes"], r["rrule"], r["uid"]))
            yield pd.DataFrame(rows, columns=["uid", "summary", "dtstart", "tzid", "exdates", "minutes", "rule", "series_uid"])

    made = entries.select("uid", "summary", "dtstart", "tzid", "rrule", "exdates", "minutes").mapInPandas(run, schema)
    at = times.ics_instant(F.col("dtstart"), F.col("tzid"))
    until = times.ics_instant(F.regexp_extract("rule", r"UNTIL=([0-9TZ]+)", 1), F.lit(None).cast("string"))
    skipped = F.transform("exdates", lambda x: times.ics_instant(x, F.col("tzid")))
    placed = made.withColumn("start_at", at)
    window = F.col("start_at").between(F.lit(since), F.lit(since + timedelta(days=days)))
    kept = placed.filter(
        F.col("rule").isNull() | (window & (until.isNull() | (F.col("start_at") <= until)) & ~F.coalesce(F.array_contains(skipped, F.col("start_at")), F.lit(False)))
    )
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("series_uid", "rule").orderBy("start_at", "uid"))
    first = kept.withColumn("rn", rn).filter(F.col("rule").isNull() | (F.col("rn") <= most))
    return first.select("uid", "series_uid", "summary", "start_at", (F.col("start_at") + F.make_dt_interval(F.lit(0), F.lit(0), "minutes")).alias("end_at"))


def with_overrides(expanded: DataFrame, overrides: DataFrame) -> DataFrame:
    """Occurrences with edited ones (uid, recurrence_id, tzid, summary, dtstart, minutes) in place of what they replace.

    An override takes the identity of the occurrence it names; of several for one instant the last (ord) counts; one that
    replaces nothing is emitted all the same.
    """
    named = overrides.withColumn("replaces", times.ics_instant(F.col("recurrence_id"), F.col("tzid")))
    last = named.groupBy("uid", "replaces").agg(F.max_by(F.struct("recurrence_id", "summary", "dtstart", "tzid", "minutes"), "ord").alias("o")).select("uid", "replaces", "o.*")
    gone = last.select(F.col("uid").alias("g_uid"), F.col("replaces").alias("g_at"))
    kept = expanded.join(gone, (F.col("series_uid") == F.col("g_uid")) & (F.col("start_at") == F.col("g_at")), "left_anti")
    start = times.ics_instant(F.col("dtstart"), F.col("tzid"))
    edited = last.select(
        F.concat_ws("_", "uid", F.left("recurrence_id", F.lit(8))).alias("uid"), F.col("uid").alias("series_uid"), "summary", start.alias("start_at"), (start + F.make_dt_interval(F.lit(0), F.lit(0), "minutes")).alias("end_at")
    )
    return kept.unionByName(edited)

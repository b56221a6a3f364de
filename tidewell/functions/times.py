"""Times in a named zone (New York by default), presets, and parsers of feed timestamps.

Wall times become instants by Spark's zone rules: a wall time in the spring gap moves forward with it, and an ambiguous
one in autumn takes the first.  Timestamps are instants in UTC sessions.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def local(ts: Column, zone: str = EASTERN) -> Column:
    """The wall-clock timestamp of an instant."""
    return F.from_utc_timestamp(ts, zone)


def instant(wall: Column, zone: str | Column = EASTERN) -> Column:
    """The instant of a wall-clock timestamp; ``zone`` may be a column."""
    return F.to_utc_timestamp(wall, zone)


def day_key(ts: Column, zone: str = EASTERN) -> Column:
    """yyyy-MM-dd in the zone."""
    return F.date_format(local(ts, zone), "yyyy-MM-dd")


def day_key_or(ts: Column, default: str = "invalid", zone: str = EASTERN) -> Column:
    """The day key, or a last-sorting default for a missing time."""
    return F.coalesce(day_key(ts, zone), F.lit(default))


def start_hour(ts: Column, zone: str = EASTERN) -> Column:
    return F.hour(local(ts, zone)).cast("short")


def time_of_day(ts: Column, zone: str = EASTERN) -> Column:
    """morning 5-11, afternoon 12-16, evening 17-23; null for the night hours before 5."""
    hour = F.hour(local(ts, zone))
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon").when(hour.between(17, 23), "evening")


def second_key(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def iso_week(ts: Column) -> Column:
    """yyyy-Www by ISO weeks."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def day_of_week(day: Column) -> Column:
    """0 = Sunday to 6 = Saturday."""
    return F.dayofweek(day) - 1


def days_between(a: Column, b: Column) -> Column:
    """Days from key a to key b."""
    return F.datediff(F.to_date(b), F.to_date(a))


def minutes_between(a: Column, b: Column) -> Column:
    """Rounded minutes from a to b, halves upward."""
    return F.floor((F.unix_micros(b) - F.unix_micros(a)) / 60e6 + 0.5).cast("long")


def parse_clock(s: Column) -> Column:
    """struct<hour, minute, second> of "7:30 PM", "19:30:15" or "7 a.m."; null without a number."""
    found = r"(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?"
    part = lambda i: F.nullif(F.regexp_extract(s, found, i), F.lit("")).cast("int")
    half = F.lower(F.regexp_extract(s, r"(?i)(a\.?m\.?|p\.?m\.?)", 1))
    hour = F.when(half.startswith("p") & (part(1) != 12), part(1) + 12).when(half.startswith("a") & (part(1) == 12), 0).otherwise(part(1))
    return F.when(part(1).isNotNull(), F.struct(hour.alias("hour"), F.coalesce(part(2), F.lit(0)).alias("minute"), F.coalesce(part(3), F.lit(0)).alias("second")))


def parse_local(day: Column, clock: Column | None = None, zone: str = EASTERN) -> Column:
    """The instant of "2024-05-01" with a clock token, or of "2024-05-01 7:30 PM" in one; no clock means midnight."""
    text = F.trim(day)
    date_part = F.regexp_extract(text, r"^([^ T]*)", 1)
    rest = F.regexp_extract(text, r"^[^ T]*[ T](.*)$", 1)
    token = rest if clock is None else F.coalesce(F.nullif(F.trim(clock), F.lit("")), rest)
    c = parse_clock(token)
    number = lambda i: F.regexp_extract(date_part, r"^(\d{1,4})-(\d{1,2})-(\d{1,2})$", i).try_cast("int")
    wall = F.try_make_timestamp(number(1), number(2), number(3), F.coalesce(c["hour"], F.lit(0)), F.coalesce(c["minute"], F.lit(0)), F.coalesce(c["second"], F.lit(0)).cast("decimal(8,6)"))
    return instant(wall, zone)


def ics_instant(value: Column, tzid: Column, zone: str = EASTERN) -> Column:
    """Instant of a calendar value: 8 digits (a day), a trailing Z (UTC), a TZID, or floating in the default zone."""
    day = F.try_to_timestamp(F.regexp_extract(value, r"^(\d{8})$", 1), F.lit("yyyyMMdd"))
    wall = F.try_to_timestamp(F.regexp_extract(value, r"^(\d{8}T\d{6})Z?$", 1), F.lit("yyyyMMdd'T'HHmmss"))
    return (
        F.when(value.rlike(r"^\d{8}$"), instant(day, zone))
        .when(value.rlike(r"^\d{8}T\d{6}Z$"), wall)
        .when(value.rlike(r"^\d{8}T\d{6}$"), F.to_utc_timestamp(wall, F.coalesce(F.nullif(tzid, F.lit("")), F.lit(zone))))
    )


def us_date_instant(s: Column, zone: str = EASTERN) -> Column:
    """Instant of "M/D/YYYY HH:MM" wall time."""
    return instant(F.try_to_timestamp(F.trim(s), F.lit("M/d/yyyy H:mm")), zone)


def iso_or_local(s: Column, zone: str = EASTERN) -> Column:
    """Instant of an ISO text: with Z or an offset as such, without as wall time of the zone."""
    aware = s.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(aware, F.try_to_timestamp(s)).otherwise(instant(F.try_to_timestamp(s), zone))


def iso_duration_minutes(s: Column) -> Column:
    """Whole minutes of "PT1H30M" or "P1DT2H"; seconds are floored; null where nothing is given."""
    part = lambda unit: F.coalesce(F.regexp_extract(s, unit, 1).try_cast("double"), F.lit(0.0))
    valid = s.rlike(r"^P(?=\d|T\d)(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$")
    total = part(r"(\d+)D") * 1440 + part(r"(\d+)H") * 60 + part(r"T(?:\d+H)?(\d+)M") + part(r"(\d+(?:\.\d+)?)S") / 60
    return F.when(valid, F.floor(total).cast("int"))


def nth_weekday(month: Column, weekday: Column, n: Column) -> Column:
    """Date of the n-th weekday (0 = Sunday) of the month that holds a date; negative n counts from its end; else null."""
    first, last = F.trunc(month, "MM"), F.last_day(month)
    ahead = F.date_add(first, F.pmod(weekday - day_of_week(first), F.lit(7)).cast("int") + (n - 1) * 7)
    behind = F.date_add(last, -F.pmod(day_of_week(last) - weekday, F.lit(7)).cast("int") + (n + 1) * 7)
    found = F.when(n > 0, ahead).when(n < 0, behind)
    return F.when(F.trunc(found, "MM") == first, found)


def next_weekly(today: Column, weekday: int, k: int) -> Column:
    """Array of the next k dates on a weekday (0 = Sunday), today included."""
    first = F.date_add(today, F.pmod(F.lit(weekday) - day_of_week(today), F.lit(7)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.date_add(first, (i * 7).cast("int")))


def month_grid(month: Column) -> Column:
    """Array of the dates of a month, padded to whole weeks from Sunday."""
    first, last = F.trunc(month, "MM"), F.last_day(month)
    return F.sequence(F.date_sub(first, day_of_week(first)), F.date_add(last, 6 - day_of_week(last)))


def _at(day: date, hour: int, minute: int, second: int, micro: int, zone: str) -> datetime:
    wall = datetime(day.year, day.month, day.day, hour, minute, second, micro, ZoneInfo(zone))
    return wall.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def preset_bounds(preset: str, as_of: datetime, zone: str = EASTERN) -> tuple[datetime, datetime]:
    """UTC bounds (both included) of today, tomorrow, this_weekend, next_7_days, this_week or this_month.

    They are worked out once on the driver, so that a query holds literals that reach the scan.  A weekend begins on Friday
    at 16:00; on Saturday and Sunday it is the one under way.  An unknown preset is the moment itself.
    """
    today = as_of.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).date()
    sunday0 = (today.weekday() + 1) % 7
    friday = today + timedelta(days={6: -1, 0: -2}.get(sunday0, 5 - sunday0))
    first, last, hour = {
        "today": (today, today, 0),
        "tomorrow": (today + timedelta(1), today + timedelta(1), 0),
        "this_weekend": (friday, friday + timedelta(2), 16),
        "next_7_days": (today, today + timedelta(6), 0),
        "this_week": (today, today + timedelta((7 - sunday0) % 7), 0),
        "this_month": (today, today.replace(day=monthrange(today.year, today.month)[1]), 0),
    }.get(preset, (None, None, 0))
    if first is None:
        return as_of, as_of
    return _at(first, hour, 0, 0, 0, zone), _at(last, 23, 59, 59, 999_000, zone)

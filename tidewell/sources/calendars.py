"""Calendar feeds: landed iCalendar texts to one row for each component, and rows back to calendars."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

from tidewell.functions import text, times

#: Said of events whose feed gave a day only.
NOON_NOTE = "The source lists a date without a start time; noon is shown as a placeholder."


HEAD = re.compile(r'((?:[^":]|"[^"]*")*):')
PART = re.compile(r'(?:[^";]|"[^"]*")+')
PROPERTY = StructType().add("at", IntegerType()).add("name", StringType()).add("params", MapType(StringType(), StringType())).add("value", StringType())
COMPONENTS = ArrayType(StructType().add("component", IntegerType()).add("lines", ArrayType(PROPERTY)))


def _read(body: str) -> Iterator[tuple[int, int, str, str]]:
    """(event, at, head, value) of each property line inside an event of a calendar text; each line is read once."""
    event, depth, at = 0, -1, -1
    for line in re.split(r"\r?\n", re.sub(r"\r?\n[ \t]", "", body)):
        line = line.strip(" ")
        if line == "BEGIN:VEVENT":
            event, depth = event + 1, 0
        elif line == "END:VEVENT":
            depth = -1
        elif line and depth >= 0 and line.startswith(("BEGIN:", "END:")):
            depth = depth + 1 if line.startswith("BEGIN:") else max(depth - 1, 0)
        elif line and depth == 0:
            at += 1
            # a colon or semicolon inside quotes does not end a name or parameter
            head = HEAD.match(line)
            if head and head[1]:
                yield event, at, head[1], line[head.end() :]


@F.arrow_udf(COMPONENTS)
def _components(bodies: pa.Array) -> pa.Array:
    feeds, events, params, numbers = [0], [], [0], []
    at, names, values, keys, items = [], [], [], [], []
    for body in bodies.to_pylist():
        last = 0
        for event, place, head, value in _read(body or ""):
            if event != last:
                numbers.append(event)
                events.append(len(at))
                last = event
            parts = PART.findall(head)
            pairs = {k.upper(): re.sub('^"|"$', "", v) for k, _, v in (p.partition("=") for p in parts[1:65] if "=" in p)} if len(parts) > 1 else {}
            keys += pairs
            items += pairs.values()
            params.append(len(keys))
            at.append(place)
            names.append(parts[0].upper() if parts else None)
            values.append(value)
        feeds.append(len(numbers))
    events.append(len(at))
    maps = pa.MapArray.from_arrays(pa.array(params, pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()))
    lines = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(names, pa.string()), maps, pa.array(values, pa.string())], ["at", "name", "params", "value"])
    made = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(pa.array(events, pa.int32()), lines)], ["component", "lines"])
    return pa.ListArray.from_arrays(pa.array(feeds, pa.int32()), made)


def _each(feeds: DataFrame, feed: str, body: str) -> DataFrame:
    """(feed, component, lines) of each event of the feeds: a text is read once, in order, and no line is a row of its own."""
    found = feeds.filter(F.contains(F.col(body), F.lit("BEGIN:VCALENDAR"))).select(feed, F.explode(_components(F.col(body))).alias("c"))
    return found.select(feed, "c.component", "c.lines")


def properties(feeds: DataFrame, feed: str = "feed_id", body: str = "body") -> DataFrame:
    """(feed, component, at, name, params, value) of each property line inside an event, nested blocks left out."""
    rows = _each(feeds, feed, body).select(feed, "component", F.explode("lines").alias("p"))
    return rows.select(feed, "component", "p.at", "p.name", "p.params", "p.value")


def events(feeds: DataFrame, feed: str = "feed_id", body: str = "body") -> DataFrame:
    """One row for each event of the feeds: the properties below, dates with their parameters, repeated dates as arrays.

    A feed is one row, so its events come from its own lines, without a shuffle.
    """
    named = lambda name: F.filter("lines", lambda p: p["name"] == name)
    value = lambda name: F.try_element_at(named(name), F.lit(-1))["value"]
    last = lambda name: F.try_element_at(F.transform(named(name), lambda p: F.struct(p["value"].alias("value"), p["params"].alias("params"))), F.lit(-1))
    plain = lambda name: text.unescape_ics(value(name))
    all_of = lambda name: F.transform(named(name), lambda p: F.struct(p["at"].alias("at"), p["value"].alias("value"), F.try_element_at(p["params"], F.lit("TZID")).alias("tzid")))
    return _each(feeds, feed, body).select(
        feed, "component", plain("UID").alias("uid"), plain("SUMMARY").alias("summary"), plain("DESCRIPTION").alias("description"), plain("LOCATION").alias("location"), plain("URL").alias("url"),
        plain("CATEGORIES").alias("categories"), value("RRULE").alias("rrule"), last("DTSTART").alias("dtstart"), last("DTEND").alias("dtend"), last("RECURRENCE-ID").alias("recurrence_id"),
        all_of("EXDATE").alias("exdate"), all_of("RDATE").alias("rdate"), F.coalesce(plain("X-ALT-IMAGE"), plain("X-IMAGE"), F.when(value("ATTACH").rlike(r"(?i)\.(png|jpe?g|gif|webp)(\?|$)"), value("ATTACH"))).alias("image_url"),
    )


def instant_of(value: Column) -> Column:
    return times.ics_instant(value["value"], F.try_element_at(value["params"], F.lit("TZID")))


def normalised(rows: DataFrame, source: str, description_most: int = 5000, link_base: str | None = None) -> DataFrame:
    """Event rows of calendar components; a day without a time stands at noon with a note, and an end not after it is dropped."""
    bare = F.col("dtstart.value").rlike(r"^\d{8}$")
    start = F.when(bare, instant_of(F.col("dtstart")) + F.expr("INTERVAL 12 HOURS")).otherwise(instant_of(F.col("dtstart")))
    end = instant_of(F.col("dtend"))
    about = F.nullif(text.clamp(text.strip_html(F.coalesce("description", F.lit(""))), description_most), F.lit(""))
    noted = F.when(bare, F.concat_ws(" ", about, F.lit(NOON_NOTE))).otherwise(about)
    out = rows.select(
        text.strip_html(F.trim(F.col("summary"))).alias("title"), noted.alias("description"), start.alias("start_at"), F.when(~bare | (end > start), end).alias("end_at"), "image_url",
        (text.absolute_url(F.col("url"), F.lit(link_base)) if link_base else F.col("url")).alias("ticket_url"), F.lit(source).alias("source"), F.nullif(F.trim("uid"), F.lit("")).alias("source_id"), F.lit("published").alias("status"), F.lit(False).alias("featured"), bare.alias("needs_review"), "location",
    )
    return out.filter((F.col("title") != "") & F.col("start_at").isNotNull())


def challenged(body: Column) -> Column:
    """Whether a landed page is a bot check instead of a feed."""
    return ~F.contains(body, F.lit("BEGIN:VCALENDAR")) & body.rlike(r"(?i)captcha|checking your browser|just a moment|access denied")


def feed_links(html: Column) -> Column:
    """Calendar feeds that a page links to."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']*(?:\.ics|ical=1|outlook-ical)[^"']*)["']"""), F.lit(1)))


def escaped(s: Column) -> Column:
    return F.replace(F.regexp_replace(F.replace(F.coalesce(s, F.lit("")), F.lit("\\"), F.lit("\\\\")), r"([,;])", r"\\$1"), F.lit("\n"), F.lit("\\n"))


def folded(line: Column, width: int = 75) -> Column:
    """A content line cut into pieces of at most ``width`` characters, continued by a blank."""
    pieces = F.regexp_extract_all(line, F.lit(rf"(?s).{{1,{width - 1}}}"), F.lit(0))
    return F.array_join(pieces, "\r\n ")


def components(rows: DataFrame, stamp: str = "20240101T000000Z") -> DataFrame:
    """Each row (id, title, description, start_at, end_at, updates) as calendar text; gone and doubled ones are left out."""
    utc = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    kept = rows.filter(~F.coalesce(F.col("status").isin("gone", "merged_duplicate"), F.lit(False))) if "status" in rows.columns else rows
    lines = F.array_compact(
        F.array(
            F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id").cast("string")), F.lit(f"DTSTAMP:{stamp}"), F.concat(F.lit("SEQUENCE:"), F.coalesce("updates", F.lit(0)).cast("string")),
            F.concat(F.lit("DTSTART:"), utc("start_at")), F.concat(F.lit("DTEND:"), utc("end_at")), folded(F.concat(F.lit("SUMMARY:"), escaped(F.col("title")))), F.when(F.col("description").isNotNull(), folded(F.concat(F.lit("DESCRIPTION:"), escaped(F.col("description"))))),
            F.lit("END:VEVENT"),
        )
    )
    return kept.select("id", F.array_join(lines, "\r\n").alias("component"))


def calendar_text(parts: list[str]) -> str:
    return "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//tidewell//EN", *parts, "END:VCALENDAR", ""])


def wholetext(spark, path: str) -> DataFrame:
    """Landed feeds, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("feed_id"), F.col("value").alias("body"))


"""Adapters of landed JSON and HTML pages: one function for each kind of feed, a raw text column to event rows.

Each parses with a declared schema, so a malformed page gives nulls and not a failed job, and returns the columns of EVENT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import prices, text, times

EVENT = ("title", "description", "start_at", "end_at", "category", "tags", "price_min", "price_max", "age_restriction", "image_url", "ticket_url", "source", "source_id", "venue_name", "venue_address")
TRIBE = (
    "struct<total_pages:int,events:array<struct<id:string,title:string,description:string,start_date:string,end_date:string,cost:string,cost_details:struct<values:array<string>>,url:string,"
    "image:struct<url:string>,categories:array<struct<name:string>>,tags:array<struct<name:string>>,venue:struct<venue:string,address:string,city:string>>>>"
)
SQUARE = "struct<id:string,urlId:string,title:string,body:string,excerpt:string,startDate:bigint,endDate:bigint,assetUrl:string,fullUrl:string,sourceUrl:string,location:struct<addressTitle:string,addressLine1:string>>"
WIX = "struct<id:string,slug:string,title:string,description:string,about:string,scheduling:struct<config:struct<startDate:string,endDate:string,scheduleTbd:boolean,endDateHidden:boolean>>,location:struct<name:string,address:struct<formatted:string>>>"
DICE = "struct<id:string,perm_name:string,name:string,title:string,description:string,raw_description:string,date:string,date_end:string,url:string,external_url:string,age_limit:string,event_images:struct<landscape:string,portrait:string,square:string>,venue:string,address:string>"
RACE = "struct<race_id:string,name:string,description:string,url:string,logo_url:string,address:struct<street:string,city:string,state:string,zipcode:string>,events:array<struct<start_time:string,registration_periods:array<struct<race_fee:string>>>>>"
TICKETS = (
    "struct<page:struct<number:int,totalPages:int>,_embedded:struct<events:array<struct<id:string,name:string,info:string,url:string,dates:struct<start:struct<dateTime:string,localDate:string>,end:struct<dateTime:string>>,"
    "priceRanges:array<struct<min:double,max:double>>,classifications:array<struct<segment:struct<name:string>,genre:struct<name:string>,subGenre:struct<name:string>>>,images:array<struct<url:string,width:int>>,_embedded:struct<venues:array<struct<name:string,address:struct<line1:string>>>>>>>>"
)
BRITE = "struct<id:string,name:struct<text:string>,description:struct<html:string>,start:struct<utc:string>,end:struct<utc:string>,is_free:boolean,url:string,logo:struct<url:string>,category_id:string,organizer:struct<name:string>,venue:struct<name:string,address:struct<address_1:string>>,ticket_classes:array<struct<free:boolean,cost:struct<major_value:string>>>>"
SCHEMA_EVENT = "struct<`@type`:string,name:string,description:string,startDate:string,endDate:string,duration:string,url:string,image:string,location:struct<name:string,address:struct<streetAddress:string>>,offers:struct<price:string,lowPrice:string,highPrice:string>>"
GENRES = {"comedy": "comedy", "theatre": "theater", "musical": "theater", "film": "film", "family": "other", "fairs & festivals": "festival", "fine art": "visual-art"}
SEGMENTS = {"music": "music", "sports": "sports", "arts & theatre": "theater", "film": "film"}


def event_row(rows: DataFrame, source: str, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The EVENT columns, null where a feed has none; rows without title or start are dropped."""
    columns = {"source": F.lit(source), "tags": F.array().cast("array<string>"), "age_restriction": F.lit("not_specified")} | columns
    kinds = {"start_at": "timestamp", "end_at": "timestamp", "price_min": "double", "price_max": "double", "tags": "array<string>"}
    made = rows.select(*keep, *(columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in EVENT))
    return made.filter((F.trim("title") != "") & F.col("start_at").isNotNull())


def tribe(pages: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Pages of a WordPress events calendar."""
    e = pages.select(F.explode(F.from_json(body, TRIBE)["events"]).alias("e"))
    names = lambda a: F.transform(F.col(a), lambda x: x["name"])
    cost = prices.from_text(F.col("e.cost"), F.coalesce(F.col("e.cost_details.values"), F.array().cast("array<string>")))
    return event_row(
        e, source, title=text.clean_title(F.col("e.title")), description=text.clean_description(F.col("e.description")), start_at=times.parse_local(F.col("e.start_date")), end_at=times.parse_local(F.col("e.end_date")),
        tags=text.tag_union(names("e.categories"), names("e.tags")), price_min=cost["price_min"], price_max=cost["price_max"], image_url=F.col("e.image.url"), ticket_url=F.col("e.url"), source_id=F.col("e.id"),
        venue_name=F.col("e.venue.venue"), venue_address=F.col("e.venue.address"),
    )


def squarespace(pages: DataFrame, source: str, body: str = "body", past: bool = False) -> DataFrame:
    """Collections as JSON; times are milliseconds, cut to whole seconds."""
    top = F.from_json(body, f"struct<upcoming:array<{SQUARE}>,past:array<{SQUARE}>>")
    none = F.array().cast(f"array<{SQUARE}>")
    items = F.concat(F.coalesce(top["upcoming"], none), F.coalesce(top["past"], none)) if past else F.coalesce(top["upcoming"], none)
    e = pages.select(F.explode(items).alias("e"))
    at = lambda c: F.timestamp_seconds(F.floor(F.col(c) / 1000))
    return event_row(
        e, source, title=text.decode_entities(F.trim("e.title")), description=F.coalesce(F.nullif(text.strip_html(F.col("e.body")), F.lit("")), F.trim("e.excerpt")), start_at=at("e.startDate"), end_at=at("e.endDate"), image_url=F.col("e.assetUrl"),
        ticket_url=F.coalesce("e.sourceUrl", "e.fullUrl"), source_id=F.coalesce("e.id", "e.urlId"), venue_name=F.col("e.location.addressTitle"), venue_address=F.col("e.location.addressLine1"),
    )


def wix(pages: DataFrame, source: str, body: str = "body", site: str = "") -> DataFrame:
    """Events of the JSON that a site embeds in its pages; of several with one slug the first."""
    blob = F.regexp_extract(body, r'(?is)<script[^>]*id="wix-warmup-data"[^>]*>(.*?)</script>', 1)
    lists = F.regexp_extract_all(blob, F.lit(r'(?s)"events"\s*:\s*(\[\{.*?\}\])\s*(?=[,}])'), F.lit(1))
    e = pages.select(F.explode(F.flatten(F.transform(lists, lambda j: F.coalesce(F.from_json(j, f"array<{WIX}>"), F.array().cast(f"array<{WIX}>"))))).alias("e"))
    e = e.filter(F.col("e.slug").isNotNull() & F.col("e.scheduling").isNotNull()).groupBy("e.slug").agg(F.first("e").alias("e"))
    c = "e.scheduling.config"
    return event_row(
        e, source, title=F.trim("e.title"), description=text.clamp(text.strip_html(F.coalesce("e.description", "e.about")), 5000), start_at=F.when(~F.coalesce(F.col(f"{c}.scheduleTbd"), F.lit(False)), F.try_to_timestamp(f"{c}.startDate")),
        end_at=F.when(~F.coalesce(F.col(f"{c}.endDateHidden"), F.lit(False)), F.try_to_timestamp(f"{c}.endDate")), ticket_url=F.concat(F.lit(f"{site}/event-details/"), F.col("e.slug")), source_id=F.coalesce("e.slug", "e.id"), venue_name=F.col("e.location.name"), venue_address=F.col("e.location.address.formatted"),
    )


def dice(pages: DataFrame, source: str, body: str = "body") -> DataFrame:
    e = pages.select(F.explode(F.from_json(body, f"struct<data:array<{DICE}>>")["data"]).alias("e"))
    return event_row(
        e, source, title=F.trim(F.coalesce("e.name", "e.title")), description=text.clamp(text.strip_html(F.coalesce(F.nullif("e.description", F.lit("")), "e.raw_description")), 5000), start_at=times.iso_or_local(F.col("e.date")), end_at=times.iso_or_local(F.col("e.date_end")),
        category=F.lit("music"), age_restriction=F.when(F.lower("e.age_limit").rlike("all[ -]ages|family"), "all_ages").otherwise("not_specified"), image_url=F.coalesce("e.event_images.landscape", "e.event_images.portrait", "e.event_images.square"),
        ticket_url=F.coalesce("e.url", "e.external_url"), source_id=F.coalesce("e.id", "e.perm_name"), venue_name=F.col("e.venue"), venue_address=F.col("e.address"),
    )


def races(pages: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Race calendars: the earliest start and the range of fees of a race's events."""
    e = pages.select(F.explode(F.transform(F.from_json(body, f"struct<races:array<struct<race:{RACE}>>>")["races"], lambda r: r["race"])).alias("e"))
    start = F.array_min(F.transform("e.events", lambda x: times.us_date_instant(x["start_time"])))
    fees = prices.from_fees(F.transform("e.events", lambda x: F.transform(x["registration_periods"], lambda p: p["race_fee"])))
    street = F.nullif(F.trim("e.address.street"), F.lit(""))
    return event_row(
        e, source, title=F.trim("e.name"), description=text.clamp(text.html_to_text(F.col("e.description")), 3000), start_at=start, category=F.lit("fitness"), price_min=fees["price_min"], price_max=fees["price_max"], image_url=F.when(F.col("e.logo_url").rlike("(?i)^https?://"), F.col("e.logo_url")),
        ticket_url=F.col("e.url"), source_id=F.col("e.race_id"), venue_name=street, venue_address=F.when(text.is_address(street), street),
    )


def ticketing(pages: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Pages of a ticket seller's discovery API; genre, then subgenre, then segment tells the category."""
    e = pages.select(F.explode(F.from_json(body, TICKETS)["_embedded"]["events"]).alias("e"))
    price = prices.from_ranges(F.col("e.priceRanges"))
    first = F.get("e.classifications", F.lit(0))
    known = lambda table, c: F.try_element_at(text.lookup(table), F.lower(c))
    category = F.coalesce(known(GENRES, first["genre"]["name"]), known(GENRES, first["subGenre"]["name"]), known(SEGMENTS, first["segment"]["name"]))
    venue = F.get("e._embedded.venues", F.lit(0))
    image = F.get(F.array_sort(F.transform("e.images", lambda i: F.struct((-i["width"]).alias("w"), i["url"].alias("url")))), F.lit(0))["url"]
    return event_row(
        e, source, title=F.trim("e.name"), description=F.col("e.info"), start_at=F.coalesce(F.try_to_timestamp("e.dates.start.dateTime"), times.parse_local(F.col("e.dates.start.localDate"))), end_at=F.try_to_timestamp("e.dates.end.dateTime"), category=category, price_min=price["price_min"],
        price_max=F.when(price["price_max"] > price["price_min"], price["price_max"]), image_url=image, ticket_url=F.col("e.url"), source_id=F.col("e.id"), venue_name=venue["name"], venue_address=venue["address"]["line1"],
    )


def eventbrite(pages: DataFrame, source: str, categories: dict[str, str] | None = None, body: str = "body") -> DataFrame:
    e = pages.select(F.explode(F.from_json(body, f"struct<events:array<{BRITE}>>")["events"]).alias("e"))
    price = prices.from_ticket_classes(F.transform("e.ticket_classes", lambda c: F.struct(c["free"].alias("free"), c["cost"]["major_value"].alias("value"))), F.coalesce("e.is_free", F.lit(False)))
    return event_row(
        e, source, title=text.clean_title(F.col("e.name.text")), description=text.clean_description(F.col("e.description.html")), start_at=F.try_to_timestamp("e.start.utc"), end_at=F.try_to_timestamp("e.end.utc"), category=F.try_element_at(text.lookup(categories or {"103": "music"}), F.col("e.category_id")),
        price_min=price["price_min"], price_max=price["price_max"], image_url=F.col("e.logo.url"), ticket_url=F.col("e.url"), source_id=F.col("e.id"), venue_name=F.col("e.venue.name"), venue_address=F.col("e.venue.address.address_1"),
    )


def json_ld(html: Column) -> Column:
    """Array of the JSON objects in a page's ld+json blocks: lists and graphs flattened, malformed blocks left out."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))

    def objects(v: Column) -> Column:
        graph, whole = F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$", "array<variant>")
        each = F.coalesce(graph, whole, F.array(v))
        return F.filter(F.transform(each, lambda x: F.to_json(x)), lambda j: j.startswith("{"))

    # each block is parsed once
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())
    return F.flatten(F.transform(parsed, objects))


def schema_objects(objects: Column, *types: str) -> Column:
    """Objects whose @type is, or has, one of the types."""
    wanted = F.array(*map(F.lit, types))

    def has(j: Column) -> Column:
        kind = F.get_json_object(j, "$['@type']")
        # only lists are parsed: a plain name is no JSON, and each failed parse costs an exception
        listed = F.when(kind.rlike(r"^\s*\["), F.from_json(kind, "array<string>"))
        return F.arrays_overlap(F.coalesce(listed, F.array(kind)), wanted)

    return F.filter(objects, lambda j: F.coalesce(has(j), F.lit(False)))


def schema_events(pages: DataFrame, source: str, html: str = "html") -> DataFrame:
    """Events that pages describe in ld+json."""
    e = pages.select(F.explode(schema_objects(json_ld(F.col(html)), "Event", "MusicEvent", "TheaterEvent", "SportsEvent", "Festival")).alias("j")).select(F.from_json("j", SCHEMA_EVENT).alias("e"))
    start = times.iso_or_local(F.col("e.startDate"))
    end = F.coalesce(times.iso_or_local(F.col("e.endDate")), start + F.make_dt_interval(F.lit(0), F.lit(0), times.iso_duration_minutes(F.col("e.duration"))))
    price = prices.from_text(F.coalesce("e.offers.price", F.concat_ws(" ", "e.offers.lowPrice", "e.offers.highPrice")))
    return event_row(
        e, source, title=text.clean_title(F.col("e.name")), description=text.clean_description(F.col("e.description")), start_at=start, end_at=end, price_min=price["price_min"], price_max=price["price_max"], image_url=F.col("e.image"), ticket_url=F.col("e.url"),
        source_id=F.coalesce("e.url", F.sha2(F.concat_ws("|", "e.name", "e.startDate"), 256)), venue_name=F.col("e.location.name"), venue_address=F.col("e.location.address.streetAddress"),
    )


def polygons(spark, path: str, name: str = "slug") -> DataFrame:
    """Polygons of a GeoJSON file: slug, ordinal and rings; the polygons of a multipolygon are put together."""
    schema = f"features array<struct<properties:struct<{name}:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("ordinal", "f"))
    ring = "array<array<array<double>>>"
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", ring)).otherwise(F.flatten(F.from_json("f.geometry.coordinates", f"array<{ring}>")))
    return f.select(F.col(f"f.properties.{name}").alias("slug"), "ordinal", rings.alias("rings"))


def merged_regions(shapes: DataFrame) -> DataFrame:
    """Polygons (region, rings) rolled up to one set of rings for each region."""
    return shapes.groupBy("region").agg(F.flatten(F.collect_list("rings")).alias("rings"))


def lineup(files: DataFrame, body: str = "body") -> DataFrame:
    """Planned slots of a festival's JSON line-up: one row for each act of each column."""
    shape = "struct<tag:string,day:string,slots:array<struct<start:string,end:string,acts:array<struct<title:string,venue:string,column:string>>>>>"
    s = files.select(F.from_json(body, shape).alias("l")).select("l.tag", "l.day", F.explode("l.slots").alias("s")).select("tag", "day", "s.start", "s.end", F.explode("s.acts").alias("a"))
    at = lambda c: times.parse_local(F.col("day"), F.col(c))
    return s.select("a.title", at("start").alias("start_at"), at("end").alias("end_at"), F.col("a.venue").alias("venue_name"), F.array("tag", F.col("a.column")).alias("tags")).filter((F.trim("title") != "") & F.col("start_at").isNotNull())

"""Text functions: HTML, titles, addresses, names, URLs, slugs, search and set similarity.

All are Catalyst expressions but for the few that need Unicode tables or URL resolution, which are Arrow pandas UDFs.
"""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache, reduce
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words and abbreviations that matching and addresses go by.
STOPWORDS = (
    "a an the and or of in at to for with by on is are be was were has have had from as its it this that their our your his her we they you i my no not so if but do get all more up out "
    "music live presents featuring ft feat event events show shows night evening morning afternoon day sunday monday tuesday wednesday thursday friday saturday am pm annual first second third special "
    "doors open free admission tickets register rsvp"
).split()
STREETS = {
    "boulevard": "blvd", "street": "st", "str": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "lane": "ln", "court": "ct",
    "place": "pl", "parkway": "pkwy", "highway": "hwy", "terrace": "ter", "circle": "cir", "square": "sq", "trail": "trl",
}
STREET_SUFFIXES = ("blvd", "st", "ave", "rd", "dr", "ln", "ct", "pl", "pkwy", "hwy", "ter", "cir", "sq", "trl", "way")
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
STATES = (
    "alabama,alaska,arizona,arkansas,california,colorado,connecticut,delaware,florida,georgia,hawaii,idaho,illinois,indiana,iowa,kansas,kentucky,louisiana,maine,maryland,massachusetts,michigan,"
    "minnesota,mississippi,missouri,montana,nebraska,nevada,new hampshire,new jersey,new mexico,new york,north carolina,north dakota,ohio,oklahoma,oregon,pennsylvania,rhode island,"
    "south carolina,south dakota,tennessee,texas,utah,vermont,virginia,washington,west virginia,wisconsin,wyoming"
).split(",")
VIRTUAL = ("virtual", "online", "virtual event", "online event", "webinar", "zoom", "livestream", "tbd", "tba")
KEEP_UPPER = frozenset("DJ DJS MC BBQ VIP EDM TV CD USA OH NYE LGBTQ LGBTQ+ Q&A ASL ID".split())
MINOR_WORDS = frozenset("a an the and but or nor for of in on at to by with from as vs via".split())
RESERVED_SLUGS = ("submit", "new", "edit", "featured")


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def fold(s: Column) -> Column:
    """Lower case, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


# HTML ---------------------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """Decimal, hexadecimal and named character references; references to no character stay."""
    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


COMMON_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def decode_common(s: Column) -> Column:
    """The most common references only, without leaving the JVM; the ampersand last."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), COMMON_ENTITIES.items(), s)


def drop_blocks(s: Column) -> Column:
    """Without comments, styles and scripts."""
    return F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", ""), r"(?is)<(style|script|noscript)\b[^>]*>.*?</\1>", "")


def straight_quotes(s: Column) -> Column:
    return F.translate(s, "‘’“”", "''\"\"")


def strip_html(s: Column, decode=decode_entities) -> Column:
    """One line of text: tags to blanks, references decoded, quotes straightened, white space folded."""
    return F.trim(F.regexp_replace(straight_quotes(decode(F.regexp_replace(drop_blocks(s), r"<[^>]*>", " "))), r"[\s\p{Z}\x{FEFF}]+", " "))


def html_to_text(s: Column, decode=decode_entities) -> Column:
    """Text with line breaks for breaks, paragraphs, headings and list items, and bullets."""
    steps = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</h[1-6]>", "\n\n"), (r"(?i)</li>", "\n"), (r"(?i)<li[^>]*>", "\n• "), (r"(?i)</[uo]l>", "\n"), (r"<[^>]*>", "")]
    plain = straight_quotes(decode(reduce(lambda c, step: F.regexp_replace(c, *step), steps, drop_blocks(s))))
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"(?m)^ +| +$", "")
    return F.regexp_replace(folded, r"^\s+|\s+$", "")


def clamp(s: Column, most: int) -> Column:
    """At most ``most`` UTF-16 units without splitting a character."""
    cut = F.left(s, F.lit(most))
    wide = F.length(F.regexp_replace(cut, r"[\x{0}-\x{FFFF}]", ""))
    return F.when(wide == 0, cut).otherwise(_clamp_units(s, F.lit(most)))


@F.pandas_udf(StringType())
def _clamp_units(s: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else x.encode("utf-16-le")[: 2 * m].decode("utf-16-le", "ignore") for x, m in zip(s, most, strict=True)])


def strip_replacement(s: Column) -> Column:
    """U+FFFD to a blank, runs of blanks to one."""
    return F.regexp_replace(F.replace(s, F.lit("�"), F.lit(" ")), r"[ \t]{2,}", " ")


@F.pandas_udf(StringType())
def _title_case(s: pd.Series) -> pd.Series:
    import re

    def part(word: str, edge: bool) -> str:
        low = word.lower()
        if word in KEEP_UPPER or (low in MINOR_WORDS and not edge):
            return word if word in KEEP_UPPER else low
        return re.sub(r"^([^a-z0-9]*)([a-z])", lambda m: m[1] + m[2].upper(), low)

    def title(text: str) -> str:
        words = text.split(" ")
        made = []
        for i, word in enumerate(words):
            parts = word.split("-")
            made.append("-".join(part(p, (i == 0 and j == 0) or (i == len(words) - 1 and j == len(parts) - 1)) for j, p in enumerate(parts)))
        return " ".join(made)

    return s.map(lambda x: x if x is None else title(x))


def title_case_if_shouting(s: Column, least: int = 25) -> Column:
    """Title case where a title of more than ``least`` characters has capitals and no lower-case letter."""
    return F.when((F.length(s) > least) & ~s.rlike("[a-z]") & s.rlike("[A-Z]"), _title_case(s)).otherwise(s)


def clean_title(s: Column) -> Column:
    return title_case_if_shouting(strip_replacement(strip_html(s)))


def clean_description(s: Column) -> Column:
    return strip_replacement(html_to_text(s))


def clean_tags(tags: Column) -> Column:
    """Trimmed tags without empty ones, common references decoded; a tag list never leaves the JVM."""
    return F.filter(F.transform(tags, lambda t: F.trim(decode_common(t))), lambda t: t != "")


# Titles ---------------------------------------------------------------------------------------------------------------


def title_key(s: Column) -> Column:
    """Lower case without ASCII apostrophes, all else than letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(s, F.lit(""))), F.lit("'"), F.lit("")), r"[^a-z0-9]+", " "))


def squashed(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit(""))


def title_tokens(s: Column) -> Column:
    """Words of a title that tell events apart: two or more characters, no stop word, no ordinal."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9 ]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS) & ~w.rlike(r"^\d+(st|nd|rd|th)$"))


def by_length(a: Column, b: Column) -> tuple[Column, Column]:
    """The shorter and the longer of two arrays; of equal ones the first is the shorter."""
    first = F.size(a) <= F.size(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the shorter list's tokens, repeats counted, that the longer has; 0 if either is empty."""
    short, long_ = by_length(a, b)
    hits = F.size(F.filter(short, lambda t: F.array_contains(long_, t)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), hits / F.size(short)).otherwise(0.0)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def tolerant_overlap(a: Column, b: Column) -> Column:
    """Like token_overlap; a token also counts that equals two adjacent ones joined, or is one edit off if both have 5 letters."""
    short, long_ = by_length(a, b)
    joined = F.transform(F.slice(long_, 1, F.greatest(F.size(long_) - 1, F.lit(0))), lambda t, i: F.concat(t, F.get(long_, i + 1)))
    near = lambda t: (F.length(t) >= 5) & F.exists(long_, lambda u: (F.length(u) >= 5) & within_one_edit(t, u))
    hits = F.size(F.filter(short, lambda t: F.array_contains(long_, t) | F.array_contains(joined, t) | near(t)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), hits / F.size(short)).otherwise(0.0)


def _rich(a: Column, b: Column) -> Column:
    return (F.size(a) >= 2) & (F.size(b) >= 2)


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The shorter and longer of two keys."""
    return F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)


def _phrase_in(a: Column, b: Column) -> Column:
    short, long_ = _ordered(a, b)
    return F.contains(F.concat(F.lit(" "), long_, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" "))) & (short != long_)


def same_key(a: Column, b: Column) -> Column:
    """Equal keys, or equal but for blanks."""
    return (a == b) | (squashed(a) == squashed(b))


def prefix_match(a: Column, b: Column) -> Column:
    """Keys that agree, or where the longer begins with the shorter, or ends in it after one or two more words."""
    short, long_ = _ordered(a, b)
    rest = F.regexp_replace(long_, r"^[^ ]* ", "")
    has = F.contains(long_, F.lit(" "))
    again = has & F.contains(rest, F.lit(" "))
    return same_key(a, b) | F.startswith(long_, F.concat(short, F.lit(" "))) | (has & (rest == short)) | (again & (F.regexp_replace(rest, r"^[^ ]* ", "") == short))


def fuzzy_match(ta: Column, tb: Column) -> Column:
    return _rich(ta, tb) & (token_overlap(ta, tb) >= 0.75)


def strong_match(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Equal or contained keys, an overlap of 0.9, or the same first two tokens."""
    lead = (F.get(ta, F.lit(0)) == F.get(tb, F.lit(0))) & (F.get(ta, F.lit(1)) == F.get(tb, F.lit(1)))
    return (a != "") & (b != "") & (same_key(a, b) | _phrase_in(a, b) | (_rich(ta, tb) & ((token_overlap(ta, tb) >= 0.9) | lead)))


def umbrella_pair(raw_a: Column, raw_b: Column) -> Column:
    """Whether one title is what stands before the other's colon or dash, with something behind it."""

    def one(short: Column, long_: Column) -> Column:
        pattern = r"^(.+?)(?::|\s[—–-]\s)(.+)$"
        head, tail = F.regexp_extract(long_, pattern, 1), F.regexp_extract(long_, pattern, 2)
        return long_.rlike(pattern) & (title_key(head) == title_key(short)) & (title_key(tail) != "")

    return one(raw_a, raw_b) | one(raw_b, raw_a)


def venueless_match(raw_a: Column, raw_b: Column, a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Like strong_match without the first-two-tokens arm, and never an umbrella with its part."""
    loose = ~umbrella_pair(raw_a, raw_b) & (_phrase_in(a, b) | (_rich(ta, tb) & (token_overlap(ta, tb) >= 0.9)))
    return (a != "") & (b != "") & (same_key(a, b) | loose)


def shared_lead(ta: Column, tb: Column) -> Column:
    """Number of equal tokens at the start of both lists."""
    pairs = F.zip_with(ta, tb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_miss = F.array_position(pairs, F.lit(False))
    return F.when(first_miss == 0, F.size(pairs)).otherwise(first_miss - 1).cast("int")


def shared_name(ta: Column, tb: Column) -> Column:
    return shared_lead(ta, tb) >= 3


def tolerant_match(ta: Column, tb: Column) -> Column:
    return _rich(ta, tb) & (tolerant_overlap(ta, tb) >= 0.9)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / F.nullif(total, F.lit(0)))


# Places and names -----------------------------------------------------------------------------------------------------


def address_key(s: Column) -> Column:
    """The street line with suffixes and directions abbreviated; null if nothing is left."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.split_part(decode_common(s), F.lit(","), F.lit(1))), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    known = lookup(STREETS | DIRECTIONS)
    return F.nullif(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " "), F.lit(""))


def is_address(s: Column) -> Column:
    """A house number first and a street suffix somewhere."""
    words = F.split(address_key(s), " ")
    found = (F.size(words) >= 2) & F.get(words, F.lit(0)).rlike(r"^\d+[a-z]?$") & F.exists(words, lambda w: w.isin(*STREET_SUFFIXES))
    return F.coalesce(found, F.lit(False))


def is_junk_venue(s: Column) -> Column:
    """A state, a marker of online events, or a bare street of up to three words without a number."""
    key = fold(decode_common(s))
    words = F.filter(F.split(F.regexp_replace(key, r"[^a-z\s]", " "), r"\s+"), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    street = ~key.rlike(r"\d") & F.size(words).between(1, 3) & F.coalesce(F.try_element_at(lookup(STREETS), last), last).isin(*STREET_SUFFIXES)
    return F.coalesce((key != "") & (key.isin(*STATES) | key.isin(*VIRTUAL) | street), F.lit(False))


def venue_key(s: Column, decode=decode_common) -> Column:
    """Venue name without tags, final point or comma, modifier apostrophes straightened."""
    return fold(F.regexp_replace(F.lower(F.translate(strip_html(F.coalesce(s, F.lit("")), decode), "ʼ", "'")), r"[.,]$", ""))


def canonical_name(s: Column, aliases: dict[str, str]) -> Column:
    """The name an alias stands for, else the name."""
    return F.coalesce(F.try_element_at(lookup(aliases), fold(s)), s) if aliases else s


def comma_location(s: Column) -> Column:
    """struct<name, address, city> of "Name, 12 Main St, City"; null for another shape."""
    parts = F.filter(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: p != "")
    fits = (F.size(parts) >= 3) & F.get(parts, F.lit(1)).rlike(r"^\d+\s+\S") & ~F.get(parts, F.lit(0)).rlike(r"^\d")
    city = F.when(~F.get(parts, F.lit(2)).rlike(r"^\d"), F.get(parts, F.lit(2)))
    return F.when(fits, F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("address"), city.alias("city")))


def municipal_location(s: Column, decode=decode_entities, state: str = "OH") -> Column:
    """struct<name, address> of a town's location, mostly "Name - 12 Main St  City OH 12345"; nulls for what is no place.

    Of several HTML blocks the first with text counts.  What follows the first dash is taken from the name if it begins with a number
    or holds a postcode; the address is then what follows the last dash, up to two blanks or the city, if it looks like a street's.
    A name that is empty, a number, a time, a sentence (over 80 characters) or has no letter is none, and then there is no address.
    """
    dash, post = r"\s[-–—]\s", r"\b[A-Za-z]{2}\s+\d{5}\b"
    blocks = F.transform(F.split(s, r"(?i)</(?:p|div)>|<br\s*/?>"), lambda b: F.regexp_replace(b, r"<[^>]*>", " "))
    first = F.get(F.filter(blocks, lambda b: F.regexp_replace(b, r"\s|&nbsp;", "") != ""), F.lit(0))
    kept = F.trim(F.translate(decode(first), "\u00a0", " "))
    line = F.regexp_replace(kept, r"\s+", " ")
    after, tail = F.regexp_extract(line, rf"{dash}(.*)$", 1), F.regexp_extract(kept, rf"(?s)^.*{dash}\s*(.*)$", 1)
    located = lambda c: c.rlike(r"^\d") | c.rlike(post)
    bare = F.when(located(after), F.regexp_replace(line, rf"{dash}.*$", "")).otherwise(line)
    street = F.trim(F.when(tail.rlike(r"\s{2,}"), F.regexp_replace(tail, r"(?s)\s{2,}.*$", "")).otherwise(F.regexp_replace(tail, rf"(?i)\s+[a-z][a-z .]*\s+{state}\s+\d{{5}}.*$", "")))
    sound = street.rlike(r"^\d+[A-Za-z]?\s+\S") & F.length(street).between(6, 60) & ~street.rlike(post)
    name = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s*>\s*", " - "), rf"(?i)\s+{state}\s+\d{{5}}.*$", ""))
    place = name.rlike("[A-Za-z]") & ~name.rlike(r"^[-–—\d]") & F.length(name).between(3, 80) & ~name.rlike(r"(?i)\b\d{1,2}(:\d{2})?\s*[ap]\.?m\b")
    return F.struct(F.when(place, name).alias("name"), F.when(place & located(after) & located(tail) & sound, street).alias("address"))


def organization_key(s: Column) -> Column:
    """Folded name without a leading "the"."""
    return F.regexp_replace(fold(s), r"^the ", "")


def compatible_names(a: Column, b: Column) -> Column:
    """Names of one place: either is an address, they are equal, or one holds the other as whole words."""
    ka, kb = title_key(a), title_key(b)
    return is_address(a) | is_address(b) | (ka == kb) | _phrase_in(ka, kb)


# URLs -----------------------------------------------------------------------------------------------------------------


def website(s: Column) -> Column:
    """A URL with a scheme and a plausible host, else null."""
    t = F.trim(s)
    full = F.when(t.rlike(r"(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.try_parse_url(full, F.lit("HOST"))
    return F.when((t != "") & ~t.rlike(r"\s") & host.rlike(r"(?i)^[a-z0-9.-]+$") & F.contains(host, F.lit(".")), full)


@F.pandas_udf(StringType())
def _resolved(s: pd.Series, base: pd.Series) -> pd.Series:
    def one(x: str | None, b: str | None) -> str | None:
        try:
            made = urljoin(b or "", x or "")
            return made if urlsplit(made).scheme and urlsplit(made).netloc else None
        except ValueError:
            return None

    return pd.Series([one(x, b) for x, b in zip(s, base, strict=True)], dtype=object)


def absolute_url(s: Column, base: Column) -> Column:
    """A URL resolved against a base; only relative ones leave the JVM."""
    t = F.trim(s)
    return F.when(t == "", None).when(t.rlike(r"(?i)^https?://"), t).when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(_resolved(t, base))


def rewrite_image(url: Column, source: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """Image URLs with each source's (pattern, replacement) applied."""
    for name, (pattern, new) in rules.items():
        url = F.when(source == name, F.regexp_replace(url, pattern, new)).otherwise(url)
    return url


def usable_image(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://") & ~url.rlike(r"(?i)placeholder"), F.lit(False))


def image_of(*urls: Column) -> Column:
    """The first usable image."""
    return F.coalesce(*(F.when(usable_image(u), u) for u in urls))


def urls_in(s: Column) -> Column:
    """URLs in a text, trailing punctuation and unmatched closing brackets cut."""
    found = F.regexp_extract_all(s, F.lit(r"https?://[^\s<>\"]+"), F.lit(0))
    bare = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?'\"]+$", ""))
    count = lambda u, c: F.length(u) - F.length(F.replace(u, F.lit(c), F.lit("")))
    return F.transform(bare, lambda u: F.when(u.endswith(")") & (count(u, ")") > count(u, "(")), F.regexp_replace(u, r"\)+$", "")).otherwise(u))


def path_slug(path: Column) -> Column:
    """The slug of an event page's path, without prefix and trailing uuid."""
    return F.regexp_replace(F.regexp_replace(path, r"^/events/", ""), r"/[0-9a-fA-F-]{36}/?$", "")


# Slugs and search -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Letters that are one base letter with diacritics, and diacritics; the base letters of the former, by canonical decomposition."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    parts = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0xFFFF) if not 0xD800 <= c < 0xE000)
    plain = {c: d[0] for c, d in parts if len(d) > 1 and all(m in marks for m in d[1:])}
    return "".join(plain) + marks, "".join(plain.values())


def unaccent(s: Column) -> Column:
    """Without diacritics, in the JVM."""
    return F.translate(s, *_accented())


def search_key(s: Column) -> Column:
    return F.lower(unaccent(s))


def search_document(title: Column, description: Column, tags: Column) -> Column:
    """What a search looks in: title, then description and tags."""
    return F.struct(search_key(F.coalesce(title, F.lit(""))).alias("title"), search_key(F.concat_ws(" ", description, F.array_join(tags, " "))).alias("body"))


def quoted(term: str) -> str:
    import re

    return re.sub(r"([.*+?^${}()|\[\]\\/-])", r"\\\1", term)


def has_word(s: Column, term: str) -> Column:
    """Whether a lower-case text has a term at word bounds."""
    return s.rlike(rf"(?<![\w]){quoted(term)}(?![\w])")


def has_text(s: Column, part: str) -> Column:
    """Case-blind substring search; nothing in ``part`` is special."""
    return F.contains(F.lower(s), F.lit(part.lower()))


def slug(title: Column, start_at: Column | None = None, zone: str = "America/New_York", fold_accents: bool = True) -> Column:
    """At most 80 characters of a hyphenated title, with "evt-" before a reserved word and the day behind."""
    plain = search_key(F.coalesce(title, F.lit("event"))) if fold_accents else F.lower(F.coalesce(title, F.lit("event")))
    words = F.regexp_replace(F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s-]", " ")), r"[\s-]+", "-")
    cut = F.regexp_replace(F.left(F.regexp_replace(words, r"^-+|-+$", ""), F.lit(80)), r"-+$", "")
    part = F.when(cut == "", "event").when(cut.isin(*RESERVED_SLUGS), F.concat(F.lit("evt-"), cut)).otherwise(cut)
    if start_at is None:
        return part
    return F.concat_ws("-", part, F.lower(F.date_format(F.from_utc_timestamp(start_at, zone), "MMM-d")))


def slug_path(id_: Column, title: Column, start_at: Column) -> Column:
    return F.when(id_.isNull(), "/").otherwise(F.concat(F.lit("/events/"), slug(title, start_at), F.lit("/"), id_.cast("string")))


# Festivals, mail and calendar keys --------------------------------------------------------------------------------------


def query_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[\s_-]", "")


def spelled(s: Column) -> Column:
    """Like query_key, with one blank between words."""
    return F.trim(F.regexp_replace(F.lower(s), r"[\s_-]+", " "))


def festival_names(slug_: Column, name: Column, generic: tuple[str, ...] = ("festival", "fest", "day", "days")) -> Column:
    """Texts that name a festival: slug, slug without a year, name, name without a generic last word."""
    return F.array(slug_, F.regexp_replace(slug_, r"-\d{4}$", ""), name, F.regexp_replace(F.lower(name), rf"\s+({'|'.join(generic)})$", ""))


def festival_candidates(slug_: Column, name: Column, generic: tuple[str, ...] = ("festival", "fest", "day", "days")) -> Column:
    """Keys by which a festival is found, of its names; four letters at least."""
    return F.filter(F.array_distinct(F.transform(festival_names(slug_, name, generic), query_key)), lambda k: F.length(k) >= 4)


def column_tag(tags: Column) -> Column:
    """struct<kind, number, name> of the first porch-N or stage-x tag."""
    tag = F.get(F.filter(tags, lambda t: t.rlike(r"^(porch-\d+|stage-.+)$")), F.lit(0))
    porch = F.regexp_extract(tag, r"^porch-(\d+)$", 1).try_cast("int")
    return F.when(tag.isNotNull(), F.struct(F.when(porch.isNotNull(), "porch").otherwise("stage").alias("kind"), porch.alias("number"), F.regexp_extract(tag, r"^stage-(.+)$", 1).alias("name")))


def batch_key(key: Column) -> Column:
    """struct<day, session> of "digest-2024-05-01/abc/7"."""
    pattern = r"^digest-(\d{4}-\d{2}-\d{2})/[^/]*/(.+)$"
    return F.when(key.rlike(pattern), F.struct(F.to_date(F.regexp_extract(key, pattern, 1)).alias("day"), F.regexp_extract(key, pattern, 2).alias("session")))


def without_notes(s: Column, notes: tuple[str, ...]) -> Column:
    """A description without the fixed sentences that tell of default times."""
    return reduce(lambda c, n: F.replace(c, F.lit(n), F.lit("")), notes, s)


def unescape_ics(s: Column) -> Column:
    r"""Calendar text with \n, \, \; and \\ undone."""
    return F.replace(F.regexp_replace(F.regexp_replace(s, r"\\[nN]", "\n"), r"\\([,;])", "$1"), F.lit("\\\\"), F.lit("\\"))


def unfold_ics(s: Column) -> Column:
    return F.regexp_replace(s, r"\r?\n[ \t]", "")


def rule_map(s: Column) -> Column:
    """Upper-case keys to values of "k=v;k=v"."""
    pairs = F.filter(F.split(s, ";"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.upper(F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    return F.map_from_entries(entries)


def tag_union(*lists: Column) -> Column:
    """Lower-case tags of all lists in order, each once."""
    return F.filter(F.array_distinct(F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), F.lower)), lambda t: t.isNotNull() & (t != ""))


def override_locked(overrides: Column, name: str) -> Column:
    """Whether a JSON object of manual overrides has a key."""
    return F.coalesce(F.array_contains(F.json_object_keys(overrides), name), F.lit(False))

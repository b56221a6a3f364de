"""Personal digests: which events match a subscriber, and which of them a mail shows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidewell.functions import geo, prices, times
from tidewell.scratch import materialize

MOST, PER_ORG = 14, 2
FREE, DESCRIBED, TICKETED, JITTER = 8, 3, 2, 4


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII text."""
    return F.aggregate(F.split(s, ""), F.lit(2166136261).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(4294967295)))


def _mixed() -> list[Callable[[Column], Column]]:
    """The steps of mulberry32, each of which uses what the one before gives several times."""
    mask = 0xFFFFFFFF
    shifted = lambda c, n: c.bitwiseXOR(F.shiftrightunsigned(c, n))
    # by halves of the second factor, as a product of 64 bits would overflow
    product = lambda x, y: (x * y.bitwiseAND(0xFFFF) + F.shiftleft((x * F.shiftrightunsigned(y, 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)
    return [
        lambda seed: (seed + 0x6D2B79F5).bitwiseAND(mask),
        lambda a: product(shifted(a, 15), a.bitwiseOR(1)),
        lambda t: (t + product(shifted(t, 7), t.bitwiseOR(61))).bitwiseAND(mask).bitwiseXOR(t),
        lambda u: shifted(u, 14) / F.lit(4294967296.0),
    ]


def mulberry32(seed: Column) -> Column:
    """One number in [0, 1) of the mulberry32 generator for each 32-bit seed, whose products wrap at 32 bits."""
    for step in _mixed():
        seed = F.transform(F.array(seed), step)[0]
    return seed


def jitters(mailed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """JITTER times mulberry32 of each member's seed (rows) with each event's (columns), both 32-bit."""
    a = (mailed[:, None] ^ seeds[None, :]) + np.uint32(0x6D2B79F5)
    t = (a ^ (a >> 15)) * (a | 1)
    t = (t + (t ^ (t >> 7)) * (t | 61)) ^ t
    return JITTER * ((t ^ (t >> 14)) / 4294967296.0)


#: Members of a profile whose mails one task chooses together, and events that they meet at a time.
MEMBERS, AT_ONCE = 512, 2048


def base_score(low: Column, high: Column, description: Column, ticket_url: Column) -> Column:
    return F.when(prices.is_free(low, high), FREE).otherwise(0) + F.when(F.length(F.trim(description)) > 40, DESCRIBED).otherwise(0) + F.when(ticket_url.isNotNull(), TICKETED).otherwise(0)


def window_end(frequency: Column, lookahead_days: Column, now: datetime) -> Column:
    """End of a subscriber's window: the month's last second for monthly mails, else so many days on."""
    month_end = (now.replace(day=1) + timedelta(days=32)).replace(day=1, hour=0, minute=0, second=0, microsecond=0) - timedelta(seconds=1)
    return F.when(frequency == "monthly", F.lit(month_end)).otherwise(F.lit(now) + F.make_dt_interval(lookahead_days))


PREFERENCES = ("frequency", "lookahead_days", "event_days", "categories", "price_max", "areas", "miles", "keywords")


def profiles(subscribers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct preferences, named by the smallest sub_id that has them, and (sub_id, profile, mailed) of each subscriber.

    ``mailed`` is the first half of the seed of a subscriber's jitter.
    """
    keyed_ = subscribers.select("sub_id", F.to_json(F.struct(*PREFERENCES)).alias("key"), *PREFERENCES)
    made = materialize(keyed_.groupBy("key").agg(F.min("sub_id").alias("profile"), *(F.min_by(c, "sub_id").alias(c) for c in PREFERENCES)), "profiles")
    return made.drop("key"), keyed_.select("sub_id", "key").join(made.select("key", "profile"), "key").drop("key")


def cells(lat: Column, lng: Column) -> Column:
    """The cell of one degree that holds a point."""
    return F.concat(F.floor(lat).cast("string"), F.lit("/"), F.pmod(F.floor(lng), F.lit(360)).cast("string"))


def wanted_terms(profiles_: DataFrame, now: datetime) -> DataFrame:
    """The index of preferences: (profile, until, day, term, phrase) for each day that a profile wants and each term that leads there.

    Terms are a category, or any, with the place: a cell of a degree within reach, or none where the profile names no area
    (everywhere) or the event has no place; and, on all days of the window, the longest token of a keyword (its phrase is
    verified later).
    """
    end = window_end(F.col("frequency"), F.col("lookahead_days"), now)
    days = F.sequence(F.lit(now).cast("date"), F.to_date(end))
    named = profiles_.withColumn("until", end).withColumn("day", F.explode(days))
    on_days = named.filter(F.array_contains("event_days", times.day_of_week(F.col("day"))))
    # a reach of so many degrees at least, more in the direction of the poles
    reach = F.col("miles") / (geo.MILES_DIGEST * 3.141592653589793 / 180) + 0.01
    wide = lambda a: reach / F.greatest(F.cos(F.radians(F.least(F.abs(a["lat"]) + reach, F.lit(89.9)))), F.lit(1e-3))
    rows = lambda a: F.sequence(F.floor(a["lat"] - reach).cast("int"), F.floor(a["lat"] + reach).cast("int"))
    columns = lambda a: F.sequence(F.floor(a["lng"] - F.least(wide(a), F.lit(180.0))).cast("int"), F.floor(a["lng"] + F.least(wide(a), F.lit(180.0))).cast("int"))
    around = F.flatten(F.transform("areas", lambda a: F.flatten(F.transform(rows(a), lambda y: F.transform(columns(a), lambda x: cells(y.cast("double"), x.cast("double")))))))
    places = F.when(F.size("areas") == 0, F.array(F.lit("*"))).otherwise(F.concat(F.array(F.lit("-")), F.array_distinct(around)))
    kinds = F.when(F.size("categories") == 0, F.array(F.lit("*"))).otherwise(F.array_distinct("categories"))
    by_kind = on_days.select("profile", "until", "day", F.explode(kinds).alias("kind"), places.alias("places")).withColumn("place", F.explode("places")).select("profile", "until", "day", F.concat_ws("|", F.lit("c"), "kind", "place").alias("term"), F.lit(None).cast("string").alias("phrase"))
    longest = lambda k: F.element_at(F.array_sort(F.transform(F.split(k, " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)
    by_word = named.select("profile", "until", "day", F.explode(F.array_distinct("keywords")).alias("k")).select("profile", "until", "day", F.lower("k").alias("phrase")).withColumn("l", longest(F.col("phrase"))).filter("l.n > 0")
    return by_kind.unionByName(by_word.select("profile", "until", "day", F.concat(F.lit("k|"), "l.w").alias("term"), "phrase"))


def matches(events: DataFrame, profiles_: DataFrame, now: datetime) -> DataFrame:
    """(profile, id): events in each profile's window that meet its preferences or hold a keyword.

    Events say which terms they would be wanted by, profiles which they want (``wanted_terms``); these meet by equality on day and
    term, so an event is compared only with profiles of its day that share a term, and price, distance and phrase are verified.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", " "), F.lit(" "))
    place = F.when(F.col("lat").isNull() | F.col("lng").isNull(), "-").otherwise(cells(F.col("lat"), F.col("lng")))
    kinds = F.flatten(F.transform(F.array(F.coalesce("category", F.lit("")), F.lit("*")), lambda k: F.transform(F.array(F.lit("*"), place), lambda p: F.concat_ws("|", F.lit("c"), k, p))))
    words = F.transform(F.filter(F.array_distinct(F.split("words", " ")), lambda w: w != ""), lambda w: F.concat(F.lit("k|"), w))
    pool = events.filter(F.col("start_at") >= F.lit(now)).select("id", "start_at", "price_min", "lat", "lng", "category", plain.alias("words"))
    offered = pool.select("id", "start_at", "price_min", "lat", "lng", "words", F.to_date("start_at").alias("day"), F.explode(F.concat(kinds, words)).alias("term"))
    met = offered.join(wanted_terms(profiles_, now), ["day", "term"]).filter(F.col("start_at") <= F.col("until"))
    limits = profiles_.select(F.col("profile").alias("p"), "price_max", "areas", "miles")
    met = met.join(limits, F.col("profile") == F.col("p"))
    located = F.col("lat").isNull() | F.col("lng").isNull() | (F.size("areas") == 0) | geo.any_within(F.col("lat"), F.col("lng"), F.col("areas"), F.col("miles"))
    wanted = F.col("phrase").isNull() & (F.col("price_max").isNull() | (F.coalesce("price_min", F.lit(0)) <= F.col("price_max"))) & located
    hit = F.coalesce(F.contains(F.col("words"), F.concat(F.lit(" "), "phrase", F.lit(" "))), F.lit(False))
    return met.filter(wanted | hit).select("profile", "id").distinct()


def matched(events: DataFrame, subscribers: DataFrame, now: datetime) -> DataFrame:
    """(sub_id, id, start_at, ...): events in each subscriber's window that meet their preferences or hold a keyword.

    Subscribers with the same preferences are matched once.  Subscriber columns: sub_id, frequency, lookahead_days, event_days
    (0 = Sunday), categories, price_max, areas (array of lat, lng), miles, keywords.
    """
    kinds, members = profiles(subscribers)
    return matches(events, kinds, now).join(members, "profile").join(events, "id").select("sub_id", *events.columns)


def bounds(most: int, per_org: int) -> tuple[int, int]:
    """How many of an organizer's events on a day, and of a day's events that are left, a mail's choice can reach.

    At most ``most`` are taken; what is skipped belongs to one of the ``most // per_org`` organizers that may be full, or is featured.
    """
    of_org = per_org + 1
    return of_org, most + (most // per_org) * of_org + 1


def reachable(pool: DataFrame, most: int, reach: int) -> DataFrame:
    """Those of ``pool`` that a mail may come to, with ``queued`` (for a day's turn), ``starred`` (as the featured one) and ``soon`` (to fill up).

    Scores lie less than JITTER above their base, so a base is out of reach where ``reach`` organizers have events JITTER above it
    on that day; and no fill goes beyond the first day with so many.  Organizers are counted by hash, so never too many.
    """
    enough = max(reach, 2 * most)
    orgs = F.size(F.collect_set(F.pmod(F.xxhash64("org"), F.lit(4 * enough))))
    full = materialize(pool.groupBy("profile", "day", "base").agg(orgs.alias("orgs")).filter(F.col("orgs") >= enough), "full")
    floors = full.groupBy("profile", "day").agg(F.max("base").alias("floor"))
    until = full.groupBy("profile").agg(F.min("day").alias("until"))
    tops = materialize(pool.filter("featured").groupBy("profile").agg(F.max("base").alias("top")), "tops")
    beyond = lambda c: F.col(c).isNull() | (F.col("base") + JITTER > F.col(c))
    found = pool.join(floors, ["profile", "day"], "left").join(until, "profile", "left").join(tops, "profile", "left")
    found = found.withColumns({"queued": beyond("floor"), "starred": F.col("featured") & beyond("top"), "soon": F.col("until").isNull() | (F.col("day") <= F.col("until"))})
    return found.filter(F.col("queued") | F.col("starred") | F.col("soon")).select(*pool.columns, "queued", "starred", "soon")


#: Rows that a part of a profile is read from, in this order: its members (kind 0), fills (1, 2), then events (3) by day and time.
ORDER = ("kind", "day", "at", "id")


def _limited(who: np.ndarray, score: np.ndarray, org: np.ndarray, of_org: int, reach: int) -> np.ndarray:
    """Places of each member's ``reach`` best entries with at most ``of_org`` of an organizer, by member, best first; of equals the one that comes first."""

    def rank(group: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))

    if not len(who):
        return np.empty(0, np.int64)
    best = np.lexsort((-score, who))
    same = np.lexsort((org[best], who[best]))
    of = np.empty(len(best), np.int64)
    of[same] = rank(who[best][same] * (int(org.max()) + 1) + org[best][same])
    best = best[of < of_org]
    return best[rank(who[best]) < reach]


class Part:
    """Some members of a profile: what they have of each day so far, and in the end their picks."""

    def __init__(self, most: int, per_org: int) -> None:
        self.most, self.per_org = most, per_org
        self.of_org, self.reach = bounds(most, per_org)
        self.subs: list = []
        self.fills: dict[int, list[tuple]] = {1: [], 2: []}
        self.codes: dict[str | None, int] = {}
        self.days: list[tuple[np.ndarray, ...]] = []
        self.day: str | None = None

    def join(self, subs: list, mailed: np.ndarray) -> None:
        self.subs += subs
        self.mailed = np.r_[self.mailed, mailed] if len(self.subs) > len(subs) else mailed
        self.best: list[tuple | None] = [None] * len(self.subs)
        self.score = np.full(len(self.subs), -np.inf)

    def code(self, orgs: list) -> np.ndarray:
        return np.array([self.codes.setdefault(o, len(self.codes)) for o in orgs], np.int64)

    def meet(self, day: str, ids: np.ndarray, at: np.ndarray, org: np.ndarray, base: np.ndarray, seeds: np.ndarray, queued: np.ndarray, starred: np.ndarray) -> None:
        """Events of a day in order of time, at most AT_ONCE at a time."""
        if not self.subs:
            return
        scores = base[None, :] + jitters(self.mailed, seeds)
        if starred.any():
            among = np.flatnonzero(starred)
            top = among[np.argmax(scores[:, among], axis=1)]
            found = scores[np.arange(len(top)), top]
            for m in np.flatnonzero(found > self.score):
                self.best[m] = (int(at[top[m]]), int(ids[top[m]]), int(org[top[m]]))
            self.score = np.maximum(self.score, found)
        if not queued.any():
            return
        ids, at, org, scores = ids[queued], at[queued], org[queued], scores[:, queued]
        if day != self.day:
            self.day = day
            self.days.append((np.empty(0, np.int64), np.empty(0), *(np.empty(0, np.int64) for _ in range(3))))
            self.low = np.full(len(self.subs), -np.inf)
        wide, low = 2 * self.reach, self.low
        if scores.shape[1] > wide:  # the best few first; members for whom an organizer's limit leaves too few of them look at all
            low = np.maximum(low, -np.partition(-scores, wide - 1, axis=1)[:, wide - 1])
        kept = self.merged(scores, low, ids, at, org)
        short = (np.bincount(kept[0], minlength=len(low)) < self.reach) & (low > self.low)
        if short.any():
            kept = self.merged(scores, np.where(short, self.low, low), ids, at, org)
        self.days[-1] = kept
        last = np.cumsum(sizes := np.bincount(kept[0], minlength=len(low)))
        full = sizes == self.reach
        self.low = np.where(full, kept[1][np.where(full, last - 1, 0)], -np.inf)

    def merged(self, scores: np.ndarray, low: np.ndarray, ids: np.ndarray, at: np.ndarray, org: np.ndarray) -> tuple[np.ndarray, ...]:
        who, which = np.nonzero(scores >= low[:, None])
        both = [np.r_[a, b] for a, b in zip(self.days[-1], (who, scores[who, which], ids[which], at[which], org[which]))]
        best = _limited(both[0], both[1], both[4], self.of_org, self.reach)
        return tuple(c[best] for c in both)

    def picks(self) -> Iterator[tuple]:
        """(sub_id, id, place) of all members."""
        size = len(self.subs)
        queues = [(np.r_[0, np.cumsum(np.bincount(who, minlength=size))].tolist(), list(zip(at.tolist(), ids.tolist(), org.tolist()))) for who, _, ids, at, org in self.days]
        for m, sub in enumerate(self.subs):
            for place, pick in enumerate(sorted(self.chosen(self.best[m], [q[ends[m] : ends[m + 1]] for ends, q in queues])), 1):
                yield sub, pick[1], place

    def chosen(self, best: tuple | None, queues: list[list[tuple]]) -> list[tuple]:
        """A member's picks, each (at, id, org): the featured one, turns of the days, then the two fills."""
        picks: list[tuple] = []
        seen, orgs = set(), {}

        def take(e: tuple, limited: bool = True) -> bool:
            if len(picks) >= self.most or e[1] in seen or (limited and orgs.get(e[2], 0) >= self.per_org):
                return False
            picks.append(e)
            seen.add(e[1])
            orgs[e[2]] = orgs.get(e[2], 0) + 1
            return True

        if best:
            picks.append(best)
            seen.add(best[1])
            orgs[best[2]] = 1
        # days with anything but the featured event; evenly spread ones if there are more than there is room for
        days = [q for q in queues if any(e[1] not in seen for e in q[:2])]
        room = self.most - len(picks)
        if len(days) > room > 1:
            days = [days[i] for i in dict.fromkeys(int(i * (len(days) - 1) / (room - 1) + 0.5) for i in range(room))]
        waiting = [iter(q) for q in days]
        while waiting and len(picks) < self.most:
            waiting = [q for q in waiting if any(take(e) for e in q)]
        for kind in (1, 2):
            for e in self.fills[kind]:
                take(e, kind == 1)
        return picks


def picked(batches: Iterator[pa.RecordBatch], most: int, per_org: int) -> Iterator[tuple]:
    """(sub_id, id, place) of the picks of members whose parts are read one after the other, each in ORDER."""
    part, key = None, None
    for batch in batches:
        named = dict(zip(batch.schema.names, batch.columns))
        heads = list(zip(*(named[c].to_pylist() for c in ("profile", "part", "kind", "day"))))
        starts = [i for i, h in enumerate(heads) if i == 0 or h != heads[i - 1]]
        for first, end in ((a, min(a + AT_ONCE, b)) for s, b in zip(starts, [*starts[1:], len(heads)]) for a in range(s, b, AT_ONCE)):
            profile, number, kind, day = heads[first]
            if (profile, number) != key:
                if part:
                    yield from part.picks()
                part, key = Part(most, per_org), (profile, number)
            get = lambda c: named[c].slice(first, end - first)  # noqa: B023, E731
            if kind == 0:
                part.join(get("sub_id").to_pylist(), get("seed").to_numpy(zero_copy_only=False).astype(np.uint32))
                continue
            org = part.code(get("org").to_pylist())
            values = [get(c).to_numpy(zero_copy_only=False) for c in ("id", "at", "base", "seed", "queued", "starred")]
            if kind < 3:
                part.fills[kind] += zip(values[1].tolist(), values[0].tolist(), org.tolist())
            else:
                part.meet(day, values[0], values[1], org, values[2], values[3].astype(np.uint32), values[4].astype(bool), values[5].astype(bool))
    if part:
        yield from part.picks()


def digest(found: DataFrame, members: DataFrame, now: date, most: int = MOST, per_org: int = PER_ORG) -> DataFrame:
    """(sub_id, id, place) of each subscriber's picks: ``found`` has profile, id, start_at, org, featured, image and base (score), ``members`` sub_id and profile.

    Of events with an image: the best featured one first; then one a day in turn, best first, from evenly spread days if there are
    too many; then the earliest that an organizer's limit allows; then the earliest.  Picks come in order of time.  The
    jitter depends on subscriber, day and event alone, so a rerun gives the same mail.

    Members of a profile meet its reachable events in parts of MEMBERS, which sorted partitions stream; of a day a member keeps no
    more than ``bounds``, so neither pairs of members and events nor queues are rows, and only picks leave a task.
    """
    of_org, reach = bounds(most, per_org)
    day = times.day_key(F.col("start_at")).alias("day")
    pool = found.filter("image").select("profile", "id", F.unix_micros("start_at").alias("at"), F.col("org").cast("string").alias("org"), "featured", F.col("base").cast("double").alias("base"), day)
    pool = materialize(pool, "pool")
    members = materialize(members.select("sub_id", "profile", fnv1a(F.concat(F.col("sub_id").cast("string"), F.lit(f":{now:%Y-%m-%d}"))).alias("seed")), "members")
    near = materialize(reachable(pool, most, reach), "reachable")
    in_time = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("at", "id"))
    soon = near.filter("soon")
    early = soon.withColumn("r", in_time("profile", "org")).filter(F.col("r") <= of_org).withColumn("r", in_time("profile")).filter(F.col("r") <= reach)
    first = soon.withColumn("r", in_time("profile")).filter(F.col("r") <= 2 * most)
    sizes = members.groupBy("profile").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    columns = ["profile", "part", *ORDER, "sub_id", "org", "base", "seed", "queued", "starred"]
    none = {c: F.lit(None).cast(near.schema[c].dataType) for c in ("id", "at", "org", "base", "day", "queued", "starred")}
    dealt = members.join(sizes, "profile").withColumns({"part": F.pmod(F.xxhash64("sub_id"), F.col("parts")).cast("int"), "kind": F.lit(0), **none})
    events = near.filter("queued OR starred").withColumns({"kind": F.lit(3), "seed": fnv1a(F.col("id").cast("string"))})
    fills = [rows.withColumns({"kind": F.lit(k), "seed": F.lit(0).cast("long"), "day": F.lit(None).cast("string")}) for k, rows in ((1, early), (2, first))]
    shown = [c for c in columns if c not in ("part", "sub_id")]
    offered = events.select(*shown).unionByName(fills[0].select(*shown)).unionByName(fills[1].select(*shown))
    offered = offered.join(sizes, "profile").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "sub_id": F.lit(None).cast(members.schema["sub_id"].dataType)})
    schema = StructType([members.schema["sub_id"], StructField("id", LongType()), StructField("place", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = picked(batches, most, per_org)
        while out := list(islice(made, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    both = dealt.select(*columns).unionByName(offered.select(*columns))
    return both.repartition("profile", "part").sortWithinPartitions("profile", "part", *ORDER).mapInArrow(run, schema)

"""Truth tables of the column functions and order-dependent operators."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import classify, geo, moderation, prices, recur, text, times
from tidewell.operators import browse, digest, joins, matching, merge, windows
from tidewell.sources import calendars, feeds, keyed, landing, paged, sinks
from tidewell.streaming import jobs


def table(spark, fn, *rows, columns="a"):
    """Values of a column expression over rows of strings, in order."""
    names = columns.split(",")
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r["v"] for r in frame.select("i", fn(*(F.col(n) for n in names)).alias("v")).orderBy("i").collect()]


# text -------------------------------------------------------------------------------------------------------------------------


def test_html_and_entities(spark):
    assert table(spark, text.strip_html, "<p>a&amp;b&nbsp;c</p><!-- x --><script>y</script>", "‘q’ &#8212; &#x41; &bogus;", None) == ["a&b c", "'q' — A &bogus;", None]
    assert table(spark, text.html_to_text, "<h1>T</h1><p>one<br/>two</p><ul><li>x</li><li>y</li></ul>") == ["T\n\none\ntwo\n\n• x\n\n• y"]


def test_titles(spark):
    assert table(spark, text.title_key, "Ann's — Show:  2", None, "x") == ["anns show 2", "", "x"]
    assert table(spark, lambda a: F.array_join(text.title_tokens(a), " "), "17th Annual Lantern Exhibition at the Depot", "Live Music") == ["lantern exhibition depot", ""]
    assert table(spark, text.clean_title, "SLOW FOOD AT THE OUT-OF-THE-WAY BBQ BARN", "Short CAPS", "MIXED case title stays as it is here") == ["Slow Food at the Out-of-the-Way BBQ Barn", "Short CAPS", "MIXED case title stays as it is here"]
    assert table(spark, lambda a: text.clamp(a, 3), "a😀b", "abcd", "😀😀", None) == ["a😀", "abc", "😀", None]


MATCHES = [
    ("Moonrake", "Moon Rake", "same", True),
    ("VELLUM: THE PAPER TOUR", "Vellum", "prefix", True),
    ("Harbor Lanternfish vs Otters", "Lanternfish vs Otters", "prefix", True),
    ("one two three four", "four", "prefix", False),
    ("Tuesday Poetry Supper", "Poetry Supper: Gates Open", "fuzzy", True),
    ("Poetry", "Poetry", "fuzzy", False),
    ("Copper Thimble w/ The Long Acre", "Copper Thimble Live at Quarry", "strong", True),
    ("Copper Thimble w/ The Long Acre", "Copper Thimble Live at Quarry", "venueless", False),
    ("Turnip Festival", "Turnip Festival: The Choir", "venueless", False),
    ("The Odile Brandt Show", "Turnip Festival: The Odile Brandt Show", "venueless", True),
    ("Saltmarsh Fiddle Circle", "Saltmarsh Fidle Circle: Spring", "tolerant", True),
    ("cat dog", "car dog", "tolerant", False),
    ("Orchard Reading Series at Mill Pond", "Orchard Reading Series - Iris", "shared", True),
    ("Orchard Reading at Mill", "Orchard Reading - Iris", "shared", False),
]


def test_title_matches(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(MATCHES)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    ka, kb, ta, tb = text.title_key(a), text.title_key(b), text.title_tokens(a), text.title_tokens(b)
    tests = {
        "same": text.same_key(ka, kb), "prefix": text.prefix_match(ka, kb), "fuzzy": text.fuzzy_match(ta, tb), "strong": text.strong_match(ka, kb, ta, tb), "venueless": text.venueless_match(a, b, ka, kb, ta, tb),
        "tolerant": text.tolerant_match(ta, tb), "shared": text.shared_name(ta, tb),
    }
    for r in rows.select("i", *(c.alias(n) for n, c in tests.items())).collect():
        _, _, name, expected = MATCHES[r["i"]]
        assert bool(r[name]) == expected, MATCHES[r["i"]]


def test_sets(spark):
    words = lambda a, b: (F.split(a, " "), F.split(b, " "))
    assert table(spark, lambda a, b: F.round(text.jaccard(*words(a, b)), 3), ("a b c", "b c d"), ("a", "a"), columns="a,b") == [0.5, 1.0]
    assert table(spark, lambda a, b: F.round(text.dice(*words(a, b)), 3), ("a b c", "b c d"), columns="a,b") == [0.667]
    # repeats of the shorter list count
    assert table(spark, lambda a, b: text.token_overlap(*words(a, b)), ("a a b", "a c d e"), columns="a,b") == [pytest.approx(2 / 3)]


def test_addresses_and_names(spark):
    assert table(spark, text.address_key, "134 East Main Street, Suite 2", "134 E. Main St.", ",", None) == ["134 e main st", "134 e main st", None, None]
    assert table(spark, text.is_address, "12a Oak Ave", "Pier 7", "Oak Avenue", None) == [True, False, False, False]
    assert table(spark, text.is_junk_venue, "Ohio", "TBD", "Oak Street", "Pier 7", "The Old Mill", None) == [True, True, True, False, False, False]
    assert table(spark, text.organization_key, "The  Old Mill", "Theatre") == ["old mill", "theatre"]
    assert table(spark, text.website, "example.org", "http://a.b/c", "no dots", "https://nodot", "", None) == ["https://example.org", "http://a.b/c", None, None, None, None]
    assert table(spark, lambda a: text.absolute_url(a, F.lit("https://x.org/p/q")), "/r", "//y.org/z", "s", "", "https://k.org") == ["https://x.org/r", "https://y.org/z", "https://x.org/p/s", None, "https://k.org"]
    assert [tuple(v) for v in table(spark, lambda a: text.municipal_location(a), "<p>City Hall</p><p>12 Main St</p>", "Park - 9 Elm St")] == [("City Hall", None), ("Park", "9 Elm St")]


def test_slugs_and_search(spark):
    assert table(spark, text.slug, "Café & Bar!", "submit", "", "—") == ["cafe-and-bar", "evt-submit", "event", "event"]
    assert table(spark, lambda a: text.has_word(text.search_key(a), "improv"), "Improv night", "improvement", "an ÎMPROV", "x-improv.") == [True, False, True, True]
    assert table(spark, lambda a: F.array_join(text.urls_in(a), " "), "see https://a.b/c(d), or (http://e.f/g).") == ["https://a.b/c(d) http://e.f/g"]
    assert table(spark, lambda a: F.array_join(text.festival_candidates(a, F.lit("Oak Day")), ","), "oak-day-2024") == ["oakday2024,oakday"]
    assert table(spark, text.unescape_ics, r"a\, b\; c\nd\\e") == ["a, b; c\nd\\e"]
    assert table(spark, lambda a: text.override_locked(a, "title"), '{"title": {"at": "x"}}', "{}", None) == [True, False, False]
    assert table(spark, lambda a: text.without_notes(a, ("Note one.",)), "x Note one. y") == ["x  y"]


# prices, categories, moderation ---------------------------------------------------------------------------------------------------


def test_prices(spark):
    pair = lambda a: F.to_json(prices.from_text(a))
    assert [json.loads(v) for v in table(spark, pair, "Free", "$5 - $12.50", "ask", "$7")] == [{"price_min": 0.0}, {"price_min": 5.0, "price_max": 12.5}, {}, {"price_min": 7.0}]
    n = lambda a, b: prices.label(a.cast("double"), b.cast("double"))
    assert table(spark, n, ("0", None), ("0", "0"), (None, None), ("5", "12.5"), ("20", None), ("10", "10"), columns="a,b") == ["Free", "Free", "See tickets", "$5–$12.5", "$20", "$10"]


def test_categories(spark):
    ranked = lambda a: F.array_join(classify.ranked(classify.scores(a, F.lit(""))), ",")
    assert table(spark, ranked, "Jazz brunch", "Quarterly report", "Farmers market with live band") == ["food", "other", "music,market"]
    resolve = lambda a, b: F.array_join(classify.resolve(F.filter(F.split(a, ","), lambda x: x != ""), b, F.array(F.lit("other")), F.lit("film")), ",")
    assert table(spark, resolve, ("music,food,games", None), ("", "comedy"), ("", "bogus"), columns="a,b") == ["music,food", "comedy", "film"]
    facet = lambda a: F.to_json(classify.facets(a, F.lit("")))
    got = [json.loads(v) for v in table(spark, facet, "Kids story time", "Gala to benefit children in need", "True crime: a real-life murder for all ages", "Murder mystery dinner")]
    aside = spark.createDataFrame([("Our fundraising campaign reached its goal", False), ("A fundraising dinner", True), ("Fundraising for the school roof", True)], "t string, yes boolean")
    assert all(r["got"] == r["yes"] for r in aside.select("yes", classify.facets(F.col("t"), F.lit(None).cast("string"))["fundraiser"].alias("got")).collect())
    assert [g["family"] for g in got] == [True, False, False, False] and got[1]["fundraiser"] and got[2]["veto"] == "serious-harm" and "veto" not in got[3]
    assert table(spark, classify.municipal_public, "Council meeting", "Holiday concert", "City closed") == [False, True, False]


def test_moderation(spark):
    terms = (("badword", "high"), ("mild", "contextual"), ("worst one", "extreme"), ("badword", "contextual"))
    found = lambda a: moderation.severity_of(moderation.matches(a, terms, ("mild weather",)))
    rows = ["a b4dw0rd", "baaaadword", "b a d w o r d", "badwords", "mild", "mild weather", "worst-one", "fine", "bád wörd", None]
    assert table(spark, found, *rows) == ["high", "high", "high", None, "contextual", None, "extreme", None, None, None]
    screened = table(spark, lambda a: moderation.screen([a], terms)["status"], "worst one", "mild", "ok")
    assert screened == ["cancelled", "pending_review", None]


# times ------------------------------------------------------------------------------------------------------------------------------


def test_wall_times(spark):
    at = lambda a: F.date_format(times.parse_local(a), "yyyy-MM-dd HH:mm")
    assert table(spark, at, "2026-07-04 7:30 PM", "2026-01-04T19:30", "2026-03-08 02:30", "2026-11-01 01:30", "2026-13-01", "2026-05-01", None) == ["2026-07-04 23:30", "2026-01-05 00:30", "2026-03-08 07:30", "2026-11-01 05:30", None, "2026-05-01 04:00", None]
    ics = lambda a, b: F.date_format(times.ics_instant(a, b), "yyyy-MM-dd HH:mm")
    assert table(spark, ics, ("20240101", None), ("20240101T120000Z", None), ("20240101T120000", "America/Chicago"), ("20240101T120000", None), ("x", None), columns="a,b") == ["2024-01-01 05:00", "2024-01-01 12:00", "2024-01-01 18:00", "2024-01-01 17:00", None]
    assert table(spark, times.iso_duration_minutes, "PT1H30M", "P1DT2H", "PT90S", "PT", "x") == [90, 1560, 1, None, None]
    assert table(spark, lambda a: times.iso_week(F.to_date(a)), "2024-12-30", "2021-01-03") == ["2025-W01", "2020-W53"]


def test_presets():
    now = datetime(2024, 1, 20, 15)  # a Saturday
    assert times.preset_bounds("this_weekend", now) == (datetime(2024, 1, 19, 21), datetime(2024, 1, 22, 4, 59, 59, 999000))
    assert times.preset_bounds("this_week", now)[1] == datetime(2024, 1, 22, 4, 59, 59, 999000)
    assert times.preset_bounds("bogus", now) == (now, now)
    spring = times.preset_bounds("today", datetime(2026, 3, 8, 12))
    assert (spring[1] - spring[0]).total_seconds() < 23 * 3600  # a day of 23 hours


def test_recurrence(spark):
    daily = recur.occurrences("FREQ=DAILY;COUNT=3", "20240101", None, datetime(2024, 1, 3))
    assert daily == [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)]
    weekly = recur.occurrences("FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,TH", "20240102T100000", date(2024, 1, 31), datetime(2024, 1, 1))
    assert [d.day for d in weekly] == [2, 4, 16, 18, 30]
    assert recur.nth(2024, 2, 3, 5) == date(2024, 2, 29) and recur.nth(2024, 2, 0, 5) is None and recur.nth(2024, 1, 4, -1) == date(2024, 1, 26)
    rows = [("a", "A", "20240101T190000", None, "FREQ=WEEKLY;COUNT=4", ["20240108T190000"], 60), ("b", "B", "20240105", None, None, [], None)]
    entries = spark.createDataFrame(rows, "uid string, summary string, dtstart string, tzid string, rrule string, exdates array<string>, minutes int")
    got = recur.expand(entries, datetime(2024, 1, 1))
    assert [r["uid"] for r in got.orderBy("uid").collect()] == ["a_20240101", "a_20240115", "a_20240122", "b"]
    over = spark.createDataFrame([("a", "20240115T190000", None, "moved", "20240116T200000", 30, 1), ("z", "20240101", None, "orphan", "20240101T100000", 30, 2)], "uid string, recurrence_id string, tzid string, summary string, dtstart string, minutes int, ord int")
    final = {r["uid"]: r["summary"] for r in recur.with_overrides(got, over).collect()}
    assert final == {"a_20240101": "A", "a_20240115": "moved", "a_20240122": "A", "b": "B", "z_20240101": "orphan"}


# matching -----------------------------------------------------------------------------------------------------------------------------


def event(i, title, source, start, place="addr:1", end="2024-01-01 23:00:00"):
    return (i, title, source, datetime.fromisoformat(start), end and datetime.fromisoformat(end), place)


EVENTS = "id long, title string, source string, start_at timestamp, end_at timestamp, place string"


def groups(spark, rows, placeholders=()):
    found = matching.duplicate_groups(spark.createDataFrame(rows, EVENTS), placeholders).collect()
    out = {}
    for r in found:
        out.setdefault(r["group_id"], []).append((r["position"], r["event_id"]))
    return sorted([r["pass"] for r in found if f"{r['pass']}:{v[0][1]}" == k][0:1] + [e for _, e in sorted(v)] for k, v in ((k, sorted(v)) for k, v in out.items()))


def test_passes(spark):
    ten, eleven = "2024-01-01 10:00:00", "2024-01-01 11:00:00"
    rows = [event(1, "Poetry Supper Quartet", "a", ten), event(2, "Poetry Supper Quartet", "b", ten), event(3, "Poetry Supper Quartet", "a", ten)]
    assert groups(spark, rows) == [[1, 1, 2]]  # the same source never joins, and 2 is taken
    assert groups(spark, [event(1, "Tuesday Poetry Supper", "a", ten), event(2, "Poetry Supper", "b", eleven), event(3, "Poetry Supper", "c", "2024-01-01 12:30:00")]) == [[2, 1, 2]]
    nine = "2024-01-01 14:00:00"  # 09:00 in New York
    assert groups(spark, [event(1, "Copper Thimble", "a", "2024-01-01 23:30:00"), event(2, "Copper Thimble Tour", "p", nine)], ("p",)) == [[3, 1, 2]]
    assert groups(spark, [event(1, "Turnip Festival: The Choir", "a", ten), event(2, "Turnip Festival", "b", ten, None), event(3, "The Choir", "c", ten, None)]) == [[4, 1, 3]]
    # the best pair first: the exact title takes the event, whatever comes first in order
    assert groups(spark, [event(1, "Copper Choir Night Deluxe", "a", ten), event(2, "Copper Choir Night", "b", ten, None), event(3, "Copper Choir Night Deluxe", "c", eleven, None)]) == [[4, 1, 3]]


def test_cap():
    plans = [("a", 0, "1", 3), ("b", 1, "1", 60), ("c", 1, "2", 2), ("d", 2, "1", 1)]
    assert matching.within_cap(plans, 100) == (["a", "b", "c", "d"], "uncapped")
    assert matching.within_cap(plans, 5) == (["a", "c"], "partial-drain")
    assert matching.within_cap([("d", 2, "1", 9)], 5) == ([], "stalled")
    assert matching.within_cap([("n", 0, None, 2), ("a", 0, "1", 2), ("b", 0, None, 9)], 4) == (["a", "n"], "partial-drain")


def test_frequent_words_meet(spark):
    """Names of words that are in most names are still compared."""
    names = ["Grand Hall", "Hall Grand", "Grand Hall Annex", *(f"Grand Hall Number {i} Street {i}" for i in range(200)), *(f"Hall {i}" for i in range(300))]
    v = spark.createDataFrame([(i, n, None, None, None) for i, n in enumerate(names)], "id long, name string, address string, lat double, lng double")
    found = {(r["a"], r["b"]) for r in matching.similar_venues(v).filter("signal = 'FUZZY'").collect()}
    sets = [set(n.lower().split()) for n in names]
    assert found == {(i, j) for j in range(len(names)) for i in range(j) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert (0, 1) in found
    assert matching.deletion_cap(100) == 50 and matching.deletion_cap(10_001) == 201 and matching.deletion_cap(9, 3) == 3


def test_priority(spark):
    assert table(spark, lambda a: matching.priority(a, ("x", "y"), ("p", "q")), "y", "q", "other") == [1, 1001, 900]


# digests, windows, merges -----------------------------------------------------------------------------------------------------------------


def select_picks(rows, most, per_org):
    """The plain reading of a mail's choice: rows with id, start_at, day, org, score, featured, image."""
    pool = sorted((r for r in rows if r["image"]), key=lambda r: (r["start_at"], r["id"]))
    best = lambda some: sorted(some, key=lambda r: (-r["score"], r["start_at"], r["id"]))
    picks, orgs = {}, {}

    def take(r, limited=True):
        if r["id"] in picks or (limited and orgs.get(r["org"], 0) >= per_org):
            return False
        picks[r["id"]] = r
        orgs[r["org"]] = orgs.get(r["org"], 0) + 1
        return True

    for r in best(r for r in pool if r["featured"])[:1]:
        take(r)
    by_day = {}
    for r in pool:
        if r["id"] not in picks:
            by_day.setdefault(r["day"], []).append(r)
    days, room = sorted(by_day), most - len(picks)
    if len(days) > room > 1:
        days = list(dict.fromkeys(days[int(i * (len(days) - 1) / (room - 1) + 0.5)] for i in range(room)))
    waiting = [best(by_day[d]) for d in days]
    while len(picks) < most and any(waiting):
        for q in waiting:
            while len(picks) < most and q and not take(q.pop(0)):
                pass
    for limited in (True, False):
        for r in pool:
            if len(picks) < most:
                take(r, limited)
    return [r["id"] for r in sorted(picks.values(), key=lambda r: (r["start_at"], r["id"]))]


@pytest.mark.parametrize(("orgs", "days", "count"), [(3, 4, 60), (500, 20, 900), (1, 2, 400), (90, 2, 900)])
def test_digest_equals_the_plain_choice(spark, monkeypatch, orgs, days, count):
    """Few and many organizers, more days than there is room for, days of hundreds of events, and parts of a profile."""
    import random
    from datetime import date, timedelta

    monkeypatch.setattr(digest, "MEMBERS", 2)
    rng, start = random.Random(orgs), datetime(2024, 1, 15, 17)
    rows = [(p, 1000 * p + i, start + timedelta(days=rng.randrange(days), minutes=rng.randrange(60)), f"o{rng.randrange(orgs)}", rng.random() < 0.02, rng.random() < 0.8, rng.choice([2, 10])) for p in (1, 2) for i in range(count)]
    found = spark.createDataFrame(rows, "profile long, id long, start_at timestamp, org string, featured boolean, image boolean, base int")
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1), (5, 2)], "sub_id long, profile long")
    got = {}
    for r in sorted(digest.digest(found, members, date(2024, 1, 15)).collect(), key=lambda r: r["place"]):
        got.setdefault(r["sub_id"], []).append(r["id"])
    for sub, profile in [(1, 1), (2, 2), (3, 1), (4, 1), (5, 2)]:
        score = lambda i, base: base + 4 * mulberry(fnv(f"{sub}:2024-01-15") ^ fnv(str(i)))  # noqa: B023, E731
        own = [{"id": i, "start_at": at, "day": f"{at:%Y-%m-%d}", "org": org, "featured": f, "image": im, "score": score(i, base)} for p, i, at, org, f, im, base in rows if p == profile]
        assert got[sub] == select_picks(own, digest.MOST, digest.PER_ORG)


def test_calendar_lines_stay_in_their_feed(spark):
    """A feed's events are read from its own row: quoted parts, nested blocks and repeated lines, and no shuffle."""
    from tidewell.sources import calendars

    body = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:a\r\nsummary;X=\"p:q;r\":b\r\n c\r\nBEGIN:VALARM\r\nUID:9\r\nEND:VALARM\r\n:none\r\nno colon\r\nEXDATE;TZID=\"Z\":1\r\nEXDATE:2\r\nEND:VEVENT\r\nUID:8\r\nBEGIN:VEVENT\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:3\r\nEND:VEVENT\r\n"
    feed = spark.createDataFrame([(1, body), (2, None), (3, "UID:4"), (4, "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:5")], "feed_id long, body string")
    made = calendars.events(feed)
    got = {(r["feed_id"], r["component"]): (r["uid"], r["summary"], [(x["at"], x["value"], x["tzid"]) for x in r["exdate"]]) for r in made.collect()}
    assert got == {(1, 1): ("1", "bc", [(5, "1", "Z"), (6, "2", None)]), (1, 3): ("3", None, []), (4, 1): ("5", None, [])}
    assert [(r["name"], r["params"]) for r in calendars.properties(feed).filter("at = 2").collect()] == [("SUMMARY", {"X": "p:q;r"})]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_structured_blocks_are_parsed_once(spark):
    """Lists, graphs, several types and malformed blocks, with one parse of a block in the plan."""
    from tidewell.sources import feeds

    block = lambda j: f'<script type="application/ld+json">{j}</script>'
    html = block('{"@type":"Event","n":1}') + block("{broken") + block('[{"@type":["Thing","Event"],"n":2},3]') + block('{"@graph":[{"@type":"Event","n":4},{"@type":"Place"},{"n":5}]}') + block('"Event"')
    made = spark.createDataFrame([(html,), (None,)], "html string").select(feeds.schema_objects(feeds.json_ld(F.col("html")), "Event").alias("j"))
    numbers = [[json.loads(j)["n"] for j in r["j"]] if r["j"] is not None else None for r in made.collect()]
    assert numbers == [[1, 2, 4], None]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_digest_writes_no_pairs_of_members_and_events(spark, monkeypatch):
    """Many members of a profile: what is written grows with events and with members, not with members' days."""
    from datetime import date, timedelta

    written, write = [], digest.materialize
    monkeypatch.setattr(digest, "materialize", lambda frame, tag: (written.append(write(frame, tag)), written[-1])[1])
    start = datetime(2024, 1, 15, 17)
    rows = [(1, i, start + timedelta(days=i % 5, minutes=i), f"o{i}", i % 20 == 0, True, 2 if i % 4 else 10) for i in range(100)]
    found = spark.createDataFrame(rows, "profile long, id long, start_at timestamp, org string, featured boolean, image boolean, base int")
    members = spark.range(600).selectExpr("id AS sub_id", "1L AS profile")
    assert digest.digest(found, members, date(2024, 1, 15)).count() == 600 * digest.MOST
    assert sum(f.count() for f in written) <= 600 + 3 * 100


def test_preferences_meet_by_terms(spark):
    """Keywords of several words, areas, unplaced events and unwanted days, against a plain test of every pair."""
    at = datetime(2024, 1, 16, 12)
    events = [(i, t, at, lo, c, lat, lng) for i, (t, lo, c, lat, lng) in enumerate([("Big Jazz-Band night", 5, "a", 41.0, -81.5), ("jazz", 50, "a", None, None), ("Band of big jazz", None, "b", 41.0, -81.5), ("x", 1, "b", 45.0, -81.5), ("y", 1, None, 41.0, -81.5), ("z", 1, "a", 41.02, 179.99)])]
    frame = spark.createDataFrame(events, "id long, title string, start_at timestamp, price_min int, category string, lat double, lng double")
    area, far = [(41.0, -81.5)], [(41.0, -179.99)]
    subs = [(1, ["a"], None, [], []), (2, [], 10.0, area, []), (3, ["b"], 0.0, far, ["jazz band", "BIG"]), (4, ["a", "a"], None, far, ["jazz  band", "", "ja"]), (5, [], None, [], ["jazz"])]
    rows = [(i, "weekly", 5, [0, 1, 2, 3, 4, 5, 6] if i != 5 else [0], c, p, a, 20.0, k) for i, c, p, a, k in subs]
    made = spark.createDataFrame(rows, "sub_id long, frequency string, lookahead_days int, event_days array<int>, categories array<string>, price_max double, areas array<struct<lat:double,lng:double>>, miles double, keywords array<string>")
    got = sorted((r["sub_id"], r["id"]) for r in digest.matched(frame, made, datetime(2024, 1, 15, 12)).collect())
    assert got == [(1, 0), (1, 1), (1, 5), (2, 0), (2, 2), (2, 4), (3, 0), (3, 2), (4, 1), (4, 5), (5, 0), (5, 1), (5, 2)]


def fnv(s):
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def mulberry(seed):
    m = 0xFFFFFFFF
    a = (seed + 0x6D2B79F5) & m
    t = (a ^ a >> 15) * (a | 1) & m
    t = (t + ((t ^ t >> 7) * (t | 61) & m)) & m ^ t
    return (t ^ t >> 14) / 4294967296


def test_hashes(spark):
    words = ["", "a", "hello world", "42:2024-01-15"]
    assert table(spark, digest.fnv1a, *words) == [fnv(w) for w in words]
    assert table(spark, lambda a: digest.mulberry32(digest.fnv1a(a)), *words) == [pytest.approx(mulberry(fnv(w))) for w in words]


def test_even_positions(spark):
    frame = spark.createDataFrame([(0,), (3,), (5,), (11,)], "n int")
    assert [r[0] for r in frame.select(windows.even_positions(F.col("n"), 5)).collect()] == [[], [0, 1, 2], [0, 1, 2, 3, 4], [0, 3, 5, 8, 10]]
    assert [r[0] for r in frame.select(windows.even_positions(F.col("n"), 1)).collect()] == [[], [1], [2], [5]]


def test_effective_spec():
    spec = browse.QuerySpec(datetime(2024, 1, 15), include=("view",), exclude=("view", "click"), free=True, price="under10", window="today", since=datetime(2024, 2, 1)).effective()
    assert spec.exclude == ("click",) and spec.price == "free" and spec.since == datetime(2024, 2, 1) and spec.until is None
    assert browse.QuerySpec(datetime(2024, 1, 15), include=("a",), intents=("eat",), locked=("x",)).effective().include == ("x",)


def test_plans_push_filters_and_avoid_products(spark, sf_dir):
    from tidewell.queries import QUERIES

    plan = QUERIES["browse_soonest"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "CartesianProduct" not in plan
    assert "CartesianProduct" not in QUERIES["plan_overlaps"](spark, sf_dir)._jdf.queryExecution().toString()


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a", '{"title": 1}'), (2, "b", None)], "id long, title string, locks string")
    staged = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, title string")
    once = merge.upsert(base, staged, ["id"], "locks")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, merge.upsert(once, staged, ["id"], "locks").collect())) == [(1, "a", '{"title": 1}'), (2, "B", None), (3, None, None)]


def test_swap_survives_a_break(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if it broke off between the renames
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 5


# geography -------------------------------------------------------------------------------------------------------------------------------


def test_polygons(spark):
    square, hole = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]
    shapes = spark.createDataFrame([("a", 0, [square, hole]), ("b", 1, [hole])], "slug string, ordinal int, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 1.0), (4, None, 1.0)], "id int, lat double, lng double")
    expected = {1: "a", 2: "b", 3: None, 4: None}
    for across in (1, 16):  # cells that are nearly all on a border, and cells that are mostly inside or outside
        assert {r["id"]: r["slug"] for r in geo.locate(points, shapes, across=across).collect()} == expected


# feeds ---------------------------------------------------------------------------------------------------------------------------------------

ICS = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:A long\r\n  title\\, folded\r\nDTSTART;TZID=America/Chicago:20240105T190000\r\nBEGIN:VALARM\r\nSUMMARY:no\r\nEND:VALARM\r\nEXDATE:20240112T190000Z,20240119T190000Z\r\nEXDATE:20240126T190000Z\r\nX-P;A=\"x;y:z\":v\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nSUMMARY:Day\r\nDTSTART;VALUE=DATE:20240105\r\nDTEND;VALUE=DATE:20240105\r\nEND:VEVENT\r\nEND:VCALENDAR"


def test_calendar_feed(spark):
    feed = spark.createDataFrame([("f", ICS), ("g", "nothing")], "feed_id string, body string")
    p = {(r["component"], r["name"]): r for r in calendars.properties(feed).collect()}
    assert p[(1, "X-P")]["params"] == {"A": "x;y:z"} and p[(1, "X-P")]["value"] == "v" and (1, "UID") in p
    rows = {r["uid"]: r for r in calendars.events(feed).collect()}
    assert rows["1"]["summary"] == "A long title, folded" and [x["value"] for x in rows["1"]["exdate"]] == ["20240112T190000Z,20240119T190000Z", "20240126T190000Z"]
    out = {r["source_id"]: r for r in calendars.normalised(calendars.events(feed), "s").collect()}
    assert out["1"]["start_at"] == datetime(2024, 1, 6, 1) and out["2"]["start_at"] == datetime(2024, 1, 5, 17) and out["2"]["end_at"] is None and out["2"]["description"] == calendars.NOON_NOTE


def page_of(spark, value):
    return spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "body string")


def test_adapters(spark):
    one = lambda frame: frame.collect()[0].asDict()
    r = one(feeds.squarespace(page_of(spark, {"upcoming": [{"id": "1", "title": " A &amp; B ", "startDate": 1704481200219, "body": "<p>x</p>"}], "past": [{"id": "2"}]}), "s"))
    assert (r["title"], r["start_at"], r["description"]) == ("A & B", datetime(2024, 1, 5, 19), "x")
    r = one(feeds.dice(page_of(spark, {"data": [{"id": "1", "name": "N", "date": "2024-01-05T19:00:00Z", "age_limit": "All ages", "event_images": {"square": "q"}}]}), "s"))
    assert (r["age_restriction"], r["image_url"], r["category"]) == ("all_ages", "q", "music")
    race = {"race_id": "9", "name": "Run", "address": {"street": "12 Oak St"}, "events": [{"start_time": "1/6/2024 08:30", "registration_periods": [{"race_fee": "$25.00"}, {"race_fee": "$40.00"}]}, {"start_time": "1/5/2024 19:30", "registration_periods": []}]}
    r = one(feeds.races(page_of(spark, {"races": [{"race": race}]}), "s"))
    assert (r["start_at"], r["price_min"], r["price_max"], r["venue_address"]) == (datetime(2024, 1, 6, 0, 30), 25.0, 40.0, "12 Oak St")
    tm = {"_embedded": {"events": [{"id": "1", "name": "T", "dates": {"start": {"dateTime": "2024-01-05T19:00:00Z"}}, "priceRanges": [{"min": 10.0, "max": 10.0}, {"min": 5.0, "max": 9.0}], "classifications": [{"genre": {"name": "Comedy"}}], "images": [{"url": "s", "width": 1}, {"url": "l", "width": 9}]}]}}
    r = one(feeds.ticketing(page_of(spark, tm), "s"))
    assert (r["price_min"], r["price_max"], r["category"], r["image_url"]) == (5.0, 10.0, "comedy", "l")
    eb = {"events": [{"id": "1", "name": {"text": "E"}, "start": {"utc": "2024-01-05T19:00:00Z"}, "category_id": "103", "ticket_classes": [{"free": True, "cost": None}, {"free": False, "cost": {"major_value": "12.50"}}]}]}
    r = one(feeds.eventbrite(page_of(spark, eb), "s"))
    assert (r["price_min"], r["price_max"], r["category"]) == (12.5, None, "music")
    blob = '<script type="application/json" id="wix-warmup-data">{"x": {"events": [{"slug": "a", "title": "W", "scheduling": {"config": {"startDate": "2024-01-05T19:00:00Z"}}}], "n": 1}}</script>'
    assert one(feeds.wix(page_of(spark, blob), "s"))["start_at"] == datetime(2024, 1, 5, 19)
    html = '<script type="application/ld+json">{"@graph": [{"@type": ["Event", "X"], "name": "L", "startDate": "2024-01-05T19:00", "duration": "PT2H"}, {"@type": "Place"}]}</script><script type="application/ld+json">{bad</script>'
    r = one(feeds.schema_events(page_of(spark, html).withColumnRenamed("body", "html"), "s"))
    assert (r["title"], r["start_at"], r["end_at"]) == ("L", datetime(2024, 1, 6), datetime(2024, 1, 6, 2))
    assert feeds.tribe(page_of(spark, "{broken"), "s").count() == 0
    lineup = {"tag": "fest", "day": "2024-06-01", "slots": [{"start": "1 PM", "end": "2 PM", "acts": [{"title": "A", "venue": "V", "column": "porch-1"}]}]}
    assert one(feeds.lineup(page_of(spark, lineup)))["tags"] == ["fest", "porch-1"]


def test_geojson(spark, tmp_path):
    shape = {"features": [{"properties": {"slug": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"properties": {"slug": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[2, 2], [3, 2], [3, 3]]], [[[5, 5], [6, 5], [6, 6]]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(shape))
    assert {r["slug"]: len(r["rings"]) for r in feeds.polygons(spark, str(tmp_path / "g.json")).collect()} == {"a": 1, "b": 2}


def test_paged_source(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"total_pages": 4, "n": n}))  # the fourth is missing: no page
    paged.register(spark)
    rows = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}.json").option("per_partition", "2").load()
    assert sorted(r["page"] for r in rows.collect()) == [1, 2, 3]
    answers = iter([(503, ""), (200, "ok")])
    assert paged.with_retries(lambda _: next(answers), "u", sleep=lambda _: None) == (200, "ok")
    assert paged.with_retries(lambda _: (500, ""), "u", 2, lambda _: None) == (500, "") and all(d <= 30 for d in paged.delays(12))


def test_landing(spark):
    rows = [("JAZZ AT THE CIVIC HALL TONIGHT ONLY", "<p>a</p>", datetime(2024, 1, 5), datetime(2024, 1, 6), "s", "1"), ("", "x", datetime(2024, 1, 5), None, "s", "2")]
    raw = spark.createDataFrame(rows, "title string, description string, start_at timestamp, end_at timestamp, source string, source_id string").withColumns({"tags": F.array(F.lit(" x &amp; y ")), "category": F.lit(None).cast("string")})
    source = landing.Source("s", "S", "g", parse=lambda df: df, review=lambda df: F.col("title").contains("JAZZ"))
    good, bad = landing.ingest({"s": raw}, [source, landing.Source("t", "T", "g", active=False)], datetime(2024, 1, 1))
    row = good.collect()[0]
    assert row["title"] == "Jazz at the Civic Hall Tonight Only" and row["tags"] == ["x & y"] and row["categories"] == ["music"] and row["needs_review"] and row["status"] == "published"
    assert [r["violation"] for r in bad.collect()] == ["missing or blank title"]
    log = landing.run_rows(good, bad, good.limit(0), datetime(2024, 1, 1)).collect()[0]
    assert (log["found"], log["inserted"], log["updated"], log["skipped"]) == (2, 1, 0, 1)
    assert landing.manifest(spark, [source]).count() == 1


# streams ------------------------------------------------------------------------------------------------------------------------------------


def test_gate_restarts_its_window(spark):
    minute = lambda m: datetime(2024, 1, 1, 10, m // 1 % 60)
    calls = [(1, i, minute(0)) for i in range(130)] + [(1, 200 + i, minute(11)) for i in range(3)] + [(2, 1, minute(5))]
    frame = spark.createDataFrame(calls, "plan_id long, call long, at timestamp")
    allowed = {(r["plan_id"], r["call"]): r["allowed"] for r in jobs.gated(frame).collect()}
    assert sum(allowed.values()) == 124 and not allowed[(1, 125)] and allowed[(1, 201)] and allowed[(2, 1)]


def test_streams_equal_batches(spark, tmp_path):
    calls = [(i % 3, i, datetime(2024, 1, 1, 10, i % 50)) for i in range(300)]
    frame = spark.createDataFrame(calls, "plan_id long, call long, at timestamp")
    frame.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "calls"))
    query = jobs.mutation_gate(stream).writeStream.format("memory").queryName("gate").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("gate").collect())) == sorted(map(tuple, jobs.gated(frame).collect()))
    once = jobs.once(stream, "plan_id", "at").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 3


def test_upsert_stream_may_run_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, seq long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    for turn in range(2):  # a lost checkpoint replays the whole input
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.upsert_each(stream, str(tmp_path / "out"), str(tmp_path / f"ck{turn}"), ["id"], "seq").awaitTermination()
        assert sorted(map(tuple, keyed.read(spark, str(tmp_path / "out")).collect())) == [(1, 2, "b"), (2, 1, "c")]


def test_drafts(spark):
    at = [datetime(2024, 1, 1, h) for h in range(6)]
    actions = spark.createDataFrame([(1, 0, "add", 7, at[0]), (1, 1, "add", 8, at[1]), (1, 2, "remove", 7, at[2]), (1, 3, "add", 7, at[3]), (1, 4, "add", 9, at[4])], "plan_id long, seq int, action string, event_id long, at timestamp")
    assert {r["event_id"]: r["added_at"] for r in jobs.draft(actions, 2).collect()} == {8: at[1], 7: at[0]}


def test_overlaps_touch_no_other(spark):
    rows = [(1, 1, "10:00", "11:00"), (1, 2, "10:30", "10:40"), (1, 3, "11:00", "12:00"), (2, 4, "10:30", "10:40"), (1, 5, "10:10", None), (1, 6, "01:00", "23:00")]
    frame = spark.createDataFrame([(g, i, datetime.fromisoformat(f"2024-01-01 {s}"), e and datetime.fromisoformat(f"2024-01-01 {e}")) for g, i, s, e in rows], "g int, id int, start_at timestamp, end_at timestamp")
    assert sorted((r["a"], r["b"]) for r in joins.overlaps(frame, "g").collect()) == [(1, 2), (6, 1), (6, 2), (6, 3)]



def test_festivals(spark):
    from tidewell.plans import pages

    rows = [("oak-day-2023", "Oak Day", date(2023, 6, 1)), ("oak-day-2024", "Oak Day", date(2024, 6, 1)), ("elm-2024", "Elm Fest", date(2024, 6, 5))]
    registry = spark.createDataFrame(rows, "slug string, name string, day date")
    asked = spark.createDataFrame([(1, "oak day"), (2, "Oak_Day 2023"), (3, "elm"), (4, "Elm Fest")], "ask_id int, name string")
    found = {r["ask_id"]: r["slug"] for r in pages.resolve_festivals(asked, registry, date(2024, 1, 1)).collect()}
    assert found == {1: "oak-day-2024", 2: "oak-day-2023", 4: "elm-2024"}
    assert [pages.upcoming_festival(registry, datetime(2024, m, d, 12)).first()["slug"] for m, d in ((5, 30), (6, 2), (7, 1))] == ["oak-day-2024", "elm-2024", None]


def test_festivals_whose_keys_agree_without_blanks(spark):
    from tidewell.plans import pages

    rows = [("lantern-1-2022", "Lantern 1 Festival", date(2024, 1, 2)), ("lantern-12022-2023", "Lantern 12022 Festival", date(2023, 6, 1))]
    registry = spark.createDataFrame(rows, "slug string, name string, day date")
    asked = spark.createDataFrame([(1, "lantern_12022"), (2, "LANTERN 1-2022"), (3, "lantern12022")], "ask_id int, name string")
    found = {r["ask_id"]: r["slug"] for r in pages.resolve_festivals(asked, registry, date(2024, 1, 1)).collect()}
    assert found == {1: "lantern-12022-2023", 2: "lantern-1-2022", 3: "lantern-1-2022"}


def test_day_plan_changes(spark):
    from tidewell.plans import day_plans

    at = [datetime(2024, 1, d) for d in (1, 2, 3)]
    items = spark.createDataFrame([(1, 7, at[0], True), (1, 8, at[0], False)], "plan_id long, event_id long, added_at timestamp, removed boolean")
    back = day_plans.added(items, spark.createDataFrame([(1, 7, at[1]), (1, 9, at[2])], "plan_id long, event_id long, added_at timestamp"))
    gone = day_plans.removed(back, spark.createDataFrame([(1, 8)], "plan_id long, event_id long"))
    assert sorted(map(tuple, gone.collect())) == [(1, 7, at[0], False), (1, 8, at[0], True), (1, 9, at[2], False)]
    plans = spark.createDataFrame([(1, "a")], "plan_id long, title string")
    more = day_plans.created(plans, spark.createDataFrame([(1, "x"), (2, "b")], "plan_id long, title string"))
    assert sorted(map(tuple, day_plans.titled(more, spark.createDataFrame([(2, "B")], "plan_id long, title string")).collect())) == [(1, "a"), (2, "B")]


def test_digest_ledger_makes_reruns_harmless(spark, sf_dir):
    from tidewell.catalog import AS_OF
    from tidewell.plans import mailing
    from tidewell.queries.entities import placed_events, subscribers

    events = placed_events(spark, sf_dir).withColumns({"description": F.col("title"), "ticket_url": F.col("image_url"), "org": F.col("organization_id").cast("string")})
    subs = subscribers(spark, sf_dir).filter("sub_id < 12").withColumns({"active": F.lit(True), "send_day": F.lit(1)})
    ledger = spark.createDataFrame([], "key string, sent_at timestamp")
    sent = mailing.run(mailing.pool(events, AS_OF), subs, ledger, AS_OF)
    after = mailing.recorded(ledger, sent, AS_OF)
    assert sent.count() > 0 and mailing.run(mailing.pool(events, AS_OF), subs, after, AS_OF).count() == 0
    assert mailing.recorded(after, sent, AS_OF).count() == after.count()


def test_cached_results(spark, tmp_path):
    from datetime import timedelta

    from tidewell.plans import pages

    at, made = datetime(2024, 1, 1, 12), []

    def make(n):
        def run():
            made.append(n)
            return spark.range(n)

        return run

    path = str(tmp_path / "kept")
    assert pages.cached(spark, "a", path, make(3), at).count() == 3
    assert pages.cached(spark, "a", path, make(4), at + timedelta(minutes=4)).count() == 3 and made == [3]
    assert pages.cached(spark, "a", path, make(4), at + timedelta(minutes=6)).count() == 4
    assert pages.cached(spark, "b", path, make(5), at, most=4).count() == 5 and pages.cached(spark, "b", path, make(2), at, most=4).count() == 2


def test_public_entries(spark):
    assert table(spark, classify.municipal_public, None, "", "Council concert", "Labor Day", "Labor Day parade", "Pool closed", "Parade: Elm closed", "Fair (cancelled)") == [False, False, False, False, True, False, True, False]
    assert table(spark, lambda a, b: classify.allowlisted(a, b), ("Sunday worship", None), ("Sunday worship", "then a fish fry"), ("Fundraiser", ""), (None, None), columns="a,b") == [False, True, True, False]
    assert table(spark, classify.congregation, "Elm Lutheran", "Elm Hall", "Templeton Hall") == [True, False, False]


def test_town_locations(spark):
    rows = ["Elm Hall - Annex - 12 Oak Rd  Elm OH 44000", "Elm Hall - Oak Street  Elm OH 44000", "- 12 Oak Rd", "12 Oak Rd", "Elm Hall &gt; Room 2", None, " &nbsp; ", "x" * 81, "Opens 7 p.m.", "Elm Hall - 7"]
    expected = [("Elm Hall", "12 Oak Rd"), ("Elm Hall", None), (None, None), (None, None), ("Elm Hall - Room 2", None), (None, None), (None, None), (None, None), (None, None), ("Elm Hall", None)]
    assert [tuple(v) for v in table(spark, text.municipal_location, *rows)] == expected

"""WARC shards under uneven ids: balance, order and round trips."""

import pytest

from tidewell.llm import warc

PAGES = "page_id long, url string, html string"


def body(i):
    return f"<p>{i}</p>" + "x" * 1100


@pytest.mark.parametrize(
    "ids",
    [
        list(range(2000)),
        [*range(2000), 1 << 62],
        [-(1 << 63), *range(2000), (1 << 63) - 1],
        [None] * 700 + list(range(1300)),
        [7] * 900 + list(range(100, 1100)),
        [i << 40 for i in range(500)] + list(range(1500)),
        [5],
    ],
    ids=["dense", "outlier", "extremes", "no ids", "one id", "clusters", "one row"],
)
def test_shards_are_even_and_in_order(spark, tmp_path, ids):
    rows = [(p, f"u{i}", body(i)) for i, p in enumerate(ids)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc.write_warc(pages, str(tmp_path / "a"), shards=8).collect()
    sizes = {}
    for m in manifest:
        sizes[m["shard"]] = sizes.get(m["shard"], 0) + m["records"]
    assert sum(sizes.values()) == len(ids) and max(sizes.values()) <= max(2, 2.5 * len(ids) / 8)
    back = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert sorted(map(str, ((r["page_id"], r["url"], r["payload"].decode()) for r in back))) == sorted(map(str, rows))
    # shards hold ids in order
    ends = {}
    for m in manifest:
        with open(tmp_path / "a" / m["name"], "rb") as f:
            for data in warc.members(f):
                if (r := warc.parse(data)) is not None:
                    ends.setdefault(m["shard"], []).append(-(1 << 64) if r["page_id"] is None else r["page_id"])
    joined = [i for s in sorted(ends) for i in ends[s]]
    assert joined == sorted(joined)
    again = warc.write_warc(pages.repartition(5), str(tmp_path / "b"), shards=8).collect()
    assert sorted((m["name"], m["sha1"]) for m in again) == sorted((m["name"], m["sha1"]) for m in manifest)


def test_revisits_reach_every_part_of_an_id(spark, tmp_path):
    rows = [(3, f"u{i}", body("same")) for i in range(600)] + [(9, "last", body("same"))] + [(i, "u", body(i)) for i in range(20, 60)]
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path), shards=8)
    back = warc.read_warc(spark, str(tmp_path)).filter("page_id = 3").collect()
    assert len(back) == 600 and all(r["record_type"] == "revisit" and r["refers_to"] == 9 for r in back)


def test_a_long_payload(spark, tmp_path):
    rows = [(1, "u", "ab" * 4_000_000), (2, "v", None)]
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path))
    assert {r["page_id"]: r["payload_bytes"] for r in warc.read_warc(spark, str(tmp_path)).collect()} == {1: 8_000_000, 2: 0}

"""A Python data source for paged JSON interfaces: ``spark.read.format("paged_json")``.

Pages are read in parallel, one partition for a run of pages, with retries.  The transport is a callable, so that
landed files and live interfaces read alike and tests need no network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from random import Random
from urllib.parse import urlsplit
from urllib.request import url2pathname, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (408, 425, 429, 500, 502, 503, 504)


def fetch(url: str, timeout: float = 30.0) -> tuple[int, str]:
    """Status and text of a page; file URLs are read from disk, and a missing file is a 404."""
    parts = urlsplit(url)
    if parts.scheme in ("", "file"):
        try:
            with open(url2pathname(parts.path), encoding="utf-8") as f:
                return 200, f.read()
        except FileNotFoundError:
            return 404, ""
    from urllib.error import HTTPError

    try:
        with urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.read().decode()
    except HTTPError as e:
        return e.code, ""


def delays(attempts: int, first: float = 0.5, most: float = 30.0, seed: int = 0) -> list[float]:
    """Waits between attempts: doubling, jittered downward by up to half, and bounded."""
    random = Random(seed)
    return [min(most, first * 2**i) * (0.5 + random.random() / 2) for i in range(max(0, attempts - 1))]


def with_retries(get: Callable[[str], tuple[int, str]], url: str, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """The first answer whose status is not worth another try; the last one if all are."""
    for wait in [*delays(attempts, seed=hash(url) & 0xFFFF), None]:
        status, body = get(url)
        if status not in RETRIED or wait is None:
            return status, body
        sleep(wait)
    raise AssertionError


class Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """Options: url (with {page}), first, total_path (dotted, to the number of pages), per_partition, empty (statuses of no page)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.first = options["url"], int(options.get("first", "1"))
        self.total, self.chunk = options.get("total_path", "total_pages"), int(options.get("per_partition", "10"))
        self.empty = {int(s) for s in options.get("empty", "404").split(",")}

    def partitions(self) -> list[Pages]:
        _, body = self._page(self.first)
        total = json.loads(body) if body else {}
        for key in self.total.split("."):
            total = total.get(key, 0) if isinstance(total, dict) else 0
        last = self.first + int(total or 0) - 1
        return [Pages(a, min(last, a + self.chunk - 1)) for a in range(self.first, last + 1, self.chunk)]

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        for page in range(partition.first, partition.last + 1):
            status, body = self._page(page)
            if status == 200:
                yield page, body

    def _page(self, page: int) -> tuple[int, str]:
        status, body = with_retries(fetch, self.url.replace("{page}", str(page)))
        if status != 200 and status not in self.empty:
            raise OSError(f"page {page} of {self.url}: status {status}")
        return status, body if status == 200 else ""


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)

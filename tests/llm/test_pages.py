"""HTML extraction: the ratios decide with and without names, and time grows with the page."""

import os
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import html_extract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXT = "The harbour froze in March, early for once. Ferries stopped, and so did the mail; nobody minded much."


def f1(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 1.0 if not a and not b else 2 * (a & b).total() / (a.total() + b.total())


def nameless(page):
    page = re.sub(r"<(/?)(nav|header|footer|aside|article|main)\b", r"<\1div", page)
    return re.sub(r'\s(class|id|role)="[^"]*"', "", page)


def test_ratios_select_the_article_of_pages_without_names(spark):
    pages = [r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    scores = [f1(html_extract.main_text(nameless(p)), html_extract.main_text(p)) for p in pages]
    assert sum(scores) / len(scores) >= 0.93  # many of these pages are a line or two
    blocks = [html_extract.Page(p) for p in pages]
    by_ratio = [html_extract.selected(b, priors=False) for b in blocks]
    assert sum(int((~s).sum()) for s in by_ratio) >= 0.3 * sum(map(len, by_ratio))


@pytest.mark.parametrize("around", ["main", "article", "div"])
def test_boilerplate_without_a_name_inside_the_article(around):
    links = "".join(f'<li><a href="/{i}">Another story of the week {i}</a></li>' for i in range(8))
    page = f"<body><{around}><h1>Ice</h1><p>{TEXT}</p><ul>{links}</ul><p>{TEXT}</p><ul><li>a bucket<li>some rope</ul><p>{TEXT}</p></{around}></body>"
    assert html_extract.main_text(page) == f"Ice {TEXT} {TEXT} a bucket some rope {TEXT}"


@pytest.mark.parametrize("around", ["main", "article", "div"])
def test_short_unnamed_lines_inside_the_article(monkeypatch, around):
    """Lines on a path of their own with little text or punctuation go; short lines of the article's own path stay."""
    advert = "<div>Sign up today</div><div>Buy two get one free</div><div>This is a paid placement</div>"
    page = f"<body><{around}><h1>Ice</h1><p>{TEXT}</p><p>Nobody minded</p>{advert}<p>{TEXT}</p><p>{TEXT}</p></{around}></body>"
    assert html_extract.main_text(page) == f"Ice {TEXT} Nobody minded {TEXT} {TEXT}"
    monkeypatch.setattr(html_extract, "path_ratios", lambda blocks: np.ones(len(blocks)))  # it is the ratios that tell them apart
    assert "paid placement" in html_extract.main_text(page)


def test_a_name_alone_does_not_remove_the_only_text():
    assert html_extract.main_text(f'<div class="related sidebar"><p>{TEXT}</p><p>{TEXT}</p></div>') == f"{TEXT} {TEXT}"
    comments = "".join(f"<p>{TEXT}</p>" for _ in range(20))
    assert html_extract.main_text(f'<article><p>{TEXT}</p></article><div class="comments">{comments}</div>') == TEXT


@pytest.mark.parametrize("piece", ["<div>x, y. ", "<p>x, y.</p>", "<b><i>x, y. ", "<span class='ad'>x</span>", "</q>", "<li>x", "<table><tr><td>x", "<", "<a href='"])
def test_time_grows_with_the_page(piece):
    def seconds(n):
        start = time.process_time()
        html_extract.main_text(piece * n)
        return time.process_time() - start

    seconds(2000)
    assert seconds(32_000) <= 4 * seconds(16_000) + 0.5
    assert seconds(64_000) <= 20

"""Extraction with the shipped weights: tables of every size, long pages, pages of plain divs."""

import html
import re

import pytest

from scorecraft.llm.block_labeller import extract, extract_text, shipped, teacher
from scorecraft.llm.html_blocks import blocks_of


@pytest.fixture(scope="module")
def pages(spark):
    # not the pages that the weights were trained on: another table
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


def truth(page):
    return "\n".join(b.text for b in blocks_of(page) if teacher(b.path))


def share(got, want):
    return sum(a == b for a, b in zip(got, want, strict=True)) / len(want)


def test_pages_of_another_table(pages):
    assert share(extract(shipped(), pages), [truth(p) for p in pages]) >= 0.99


@pytest.mark.parametrize("n", [1, 2, 10])
def test_small_tables(spark, pages, n):
    table = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages[:n])], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_text(table).collect()}
    assert got == {i: truth(p) for i, p in enumerate(pages[:n])}


def test_a_page_hangs_on_no_other(spark, pages):
    one = extract(shipped(), pages[:1])
    assert extract(shipped(), pages[:40])[:1] == one == extract(shipped(), [pages[0]] + ["<p>x</p>"] * 30)[:1]


@pytest.mark.parametrize("blocks, repeat", [(1500, 1), (400, 5), (8, 300)])
def test_long_pages_alone(pages, blocks, repeat):
    long = []
    for i, p in enumerate(pages[:20]):
        texts = [b.text for b in blocks_of(p) if teacher(b.path)]
        more = "".join("<p>" + " ".join([html.escape(texts[(7 * k + i) % len(texts)])] * repeat) + f" {k}.</p>" for k in range(blocks))
        long.append(p.replace("</article>", more + "</article>"))
    assert max(map(len, long)) > 165_000
    assert share(extract(shipped(), long), [truth(p) for p in long]) >= 0.95


def test_pages_of_divs(pages):
    want = [truth(p) for p in pages]
    for tags, by in ((r"p|article|h[1-6]", "div"), (r"article", "section"), (r"article", "div")):
        plain = [re.sub(rf"<(/?)(?:{tags})\b", rf"<\1{by}", p) for p in pages]
        assert share(extract(shipped(), plain), want) >= 0.95
    post = [p.replace("<article>", '<div class="post">').replace("</article>", "</div>") for p in pages]
    assert share(extract(shipped(), post), want) >= 0.95

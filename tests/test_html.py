import random
import time

import pytest
from pyspark.sql import functions as F

from textpulse.operators.html import Page, PageField, Step, with_html_fields
from textpulse.operators.payloads import VIDEO_FIELDS, page_text, video_page_fields

GOLDEN = """<!DOCTYPE html><html><head><title>t</title><script>if (a < b) document.write("<div id='viewbox_report'>no</div>")</script>
<style>a > b {}</style></head><body><!-- <div class="r-con"><a report-id="name">no</a></div> -->
<div class="wrap r-con big"><div><div>x</div></div><p><a href="/u?a=1&amp;b=2">other</a></p><div><a report-id="name" href='/u>x'>An <b>author</b> &amp; co</a></div></div>
<div id="viewbox_report" class="video-info report-wrap-module report-scroll-module"><h1><span>The <div>nested <div>title</div></div></span></h1>
<div class="tm-info"><div><a>Life</a> > <div><a>Food</a></div></div><img src=x><br/><span>first <span>inner</span></span><span>2019-01-01</span></div>
<div><span>later</span><a>not this</a></div></div></body></html>"""


def value(html, name):
    return VIDEO_FIELDS[name].value(Page(html))


def test_golden_page_with_nested_elements():
    assert value(GOLDEN, "author") == "An author & co"
    assert value(GOLDEN, "title") == "The nested title"
    assert value(GOLDEN, "type") == ["Life", "Food"]
    assert value(GOLDEN, "time") == "inner"  # the second span in document order
    one = GOLDEN.replace("<span>first <span>inner</span></span><span>2019-01-01</span>", "<span>only</span>")
    assert value(one, "time") == "only" and value("<p>none</p>", "time") == "" and value("", "type") == []


def test_selectors():
    page = Page("<ul id=a class='x y'><li>1<li>2</li><p class=y data-k=v>3</p></ul><div id='b'><p class='yy'>4</p></div>")
    text = lambda *path, **more: PageField(path, **more).value(page)
    assert text(Step("p", cls="y")) == "3" and text(Step(cls="x")) == "123" and text(Step("p"), all=True) == ["3", "4"]
    assert text(Step(attributes=(("data-k", "v"),))) == "3" and text(Step(id="b"), Step("p")) == "4"
    assert text(Step(id="a"), Step(child=0)) == "123" and text(Step(id="a"), Step(child=5)) == "" and text(Step("p"), places=(7, 1)) == "4"


def test_broken_pages():
    assert Page("a < b <> c <1 </p> d").text() == "a < b <> c <1  d"
    assert Page("x<div>y<a href='>z").text() == "xyz" and Page("x<div>y<b").text() == "xy"
    assert Page("<b>1<script>2</scr").text() == "1" and Page("1<!-- 2").text() == "1" and Page("<SCRIPT>1</Script>2<P>3</p>").text() == "23"


@pytest.mark.parametrize("unit", ["<", "<script", "<script>", "<!--", "<a ", "<a b='", '<a b="c>', "<div>", "</div>", "<p><b></p>", "<a x=\"'>", "&lt;<", "<![", "<style "])
def test_time_is_linear_on_large_broken_pages(unit):
    took = {}
    for size in (500_000, 5_000_000) if unit in ("<", "<script", "<!--", "<a ") else (100_000, 1_000_000):
        start = time.perf_counter()
        Page(unit * (size // len(unit)))
        took[size] = time.perf_counter() - start
    small, large = sorted(took)
    assert took[large] < max(40 * took[small], 1.0)
    if large == 5_000_000:
        assert took[large] < 1.0


def test_generated_pages_equal_their_trees():
    rng = random.Random(8)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            word = rng.choice(["a", "b c", "é", "1 < 2", ""])
            return word.replace("<", "&lt;"), word
        tag = rng.choice(["div", "p", "span", "div"])
        parts = [tree(depth - 1) for _ in range(rng.randrange(4))]
        return f"<{tag} class='k{depth}' title='a>b'>{''.join(h for h, _ in parts)}</{tag}>", "".join(t for _, t in parts)

    for _ in range(200):
        html, text = tree(6)
        assert Page(html).text() == text
        outer = Page(f"<i>{html}</i><div id=z>{html}</div>")
        assert PageField((Step("div", id="z"),)).value(outer) == text


def test_fields_in_spark(spark):
    pages = spark.createDataFrame([(1, GOLDEN), (2, None), (3, "")], "id long, html string")
    got = {r.id: r for r in with_html_fields(video_page_fields(pages, unescape=True), {}, text="words").collect()}
    assert (got[1].author, got[1].title, got[1].time, got[1].type) == ("An author & co", "The nested title", "inner", ["Life", "Food"])
    assert (got[2].author, got[2].time, got[2].type, got[3].title, got[2].words) == ("", "", [], "", "")
    assert "no" not in got[1].words.split() and "document.write" not in got[1].words


def test_page_text_is_linear(spark):
    sizes = {}
    for n in (20_000, 200_000):
        units = ["<", "<script", "<!--", "<a ", "<style>x"]
        df = spark.createDataFrame([(u * (n // len(u)),) for u in units], "html string")
        start = time.perf_counter()
        assert [r.t for r in df.select(page_text(F.col("html")).alias("t")).collect()] == ["<" * n, "", "", "", ""]
        sizes[n] = time.perf_counter() - start
    assert sizes[200_000] < 5
    texts = [r.t for r in spark.createDataFrame([("a<b>c</b><script>x</SCRIPT>d 1 < 2 > 1<!-- e -->f<!x>",)], "html string").select(page_text(F.col("html")).alias("t")).collect()]
    assert texts == ["acd 1 < 2 > 1f"]

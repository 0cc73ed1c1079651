from __future__ import annotations

import time

import pytest

from pageweave.operators import links

LONG = 1_000_000


def extracted(spark, html, **more):
    df = spark.createDataFrame([(1, "http://a.example/x", html)], "page_id long, url string, html string")
    return {(r["kind"], r["raw_url"]) for r in links.extract_links(df).collect()}


@pytest.mark.parametrize(
    "tag", ["<img src=data:" + "x" * LONG + ">", "<a href=u " + "y " * (LONG // 2) + ">", "<a b=\"" + ">" * LONG + "\" href=u>", "<a b='" + "'c='" * (LONG // 4) + "' href=u>"]
)
def test_very_long_tags(spark, tag):
    extracted(spark, "<a href=k>")
    began = time.time()
    got = extracted(spark, f"<p>{tag}</p><a href='/after'>")
    assert ("page", "/after") in got and len(got) == 2
    assert time.time() - began < 10


@pytest.mark.parametrize("tag", ["<img src=" + "x" * LONG, "<a href='" + "x" * LONG, "<a " + "b='c' " * (LONG // 6)])
def test_very_long_unclosed_tags(spark, tag):
    began = time.time()
    assert extracted(spark, f"<a href='/before'>{tag}") == {("page", "/before")}
    assert time.time() - began < 10


def test_names_inside_values_are_no_attributes(spark):
    html = "<a title=\"x href=wrong\" href=\"right\"><a rel='href=\"w\"' HREF = other href=late><img alt='src=no' data-src=lazy><a data-href=no><img src='' data-original=orig>"
    assert extracted(spark, html) == {("page", "right"), ("page", "other"), ("image", "lazy"), ("image", "orig")}


def test_script_urls_by_extension_of_the_path(spark):
    html = "<script>a('https://x.example/a.jpg?w=1');b=\"https://x.example/b.txt\";c('https://www.gstatic.com/c.png')</script>https://x.example/out.png<SCRIPT>'https://x.example/D.WEBP#f'</SCRIPT>"
    html = "<img src=/relative.png><img data-src=http://y.example/shown><img src='https://www.google.com/l.png'>" + html
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r["link"] for r in links.script_urls(df).orderBy("rank").collect()] == ["https://x.example/a.jpg?w=1", "https://x.example/D.WEBP#f"]
    shown = [r["link"] for r in links.search_images(df).orderBy("rank").collect()]
    assert shown == ["http://y.example/shown", "https://x.example/a.jpg?w=1", "https://x.example/D.WEBP#f"]
    assert [r["link"] for r in links.search_images(df, 1).collect()] == shown[:1]

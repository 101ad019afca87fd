"""Rules of addresses, pages and books on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import books as bk
from gleanery.functions import pages as pg
from gleanery.functions import urls as u


def one(spark, values, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(fn(F.col("v"))).collect()]


def test_canonical_addresses(spark):
    got = one(spark, [
        " HTTP://User@WWW.Example.COM:80//a//b/?utm_source=x&b=2&a=1&GCLID=3#top", "https://e.com:443", "https://e.com:8443/x%20y/%7Ez?q=a+b&e=",
        "ftp://e.com/", "mailto:a@e.com", "https://e.com./p%zz?x", None, "",
    ], u.canonical)
    assert got == [
        "http://www.example.com/a/b/?a=1&b=2", "https://e.com/", "https://e.com:8443/x%20y/~z?e=&q=a+b", None, None, "https://e.com/p%zz?x=", None, None,
    ]


def test_identity_scope_and_links(spark):
    same = one(spark, ["https://www.e.com/a?b=1", "http://e.com/a?b=1#x"], u.page_id)
    assert same[0] == same[1] and same[0].startswith("w-") and len(same[0]) == 18
    assert one(spark, ["https://e.com", "https://e.com/library", "https://e.com/articles.html", "https://e.com/blog/"], u.scope) == ["/", "/library/", "/", "/blog/"]
    rows = [("https://e.com/blog/x", "https://www.e.com/blog", True), ("https://e.com/blog", "https://e.com/blog/", True),
            ("https://e.com/blogs", "https://e.com/blog", False), ("https://o.com/blog/x", "https://e.com/blog", False), ("https://e.com", "https://e.com/a.html", True)]
    got = spark.createDataFrame(rows, "u string, s string, w boolean").select("w", u.in_scope(F.col("u"), F.col("s")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)
    links = one(spark, ["/p?q=1#f", "c", "./c", "//o.com/x", "#top", "mailto:x@e.com", "https://O.com", ""], lambda h: u.absolute(F.lit("https://e.com/a/b?z=1"), h))
    assert links == ["https://e.com/p?q=1", "https://e.com/a/c", "https://e.com/a/c", "https://o.com/x", None, None, "https://o.com/", None]


PAGE = """<html lang="EN-gb"><head><title> Tag
 title</title><meta property="og:title" content="OG title"><meta content="2020-03-04T10:00" name="date">
<script type="application/ld+json">{"@type": "Article", "headline": "LD title", "author": [{"name": "Ann B"}, {"name": "Cy D"}], "datePublished": "2021-05-06T00:00:00Z"}</script></head>
<body><p>Some <a href="/x">link text</a> here.</p></body></html>"""


def test_page_fields_take_structured_data_first(spark):
    plain = PAGE.replace("application/ld+json", "text/none")
    tags = plain.replace("og:title", "og:other").replace('name="date"', 'name="other"').replace("<p>", '<time datetime="2019-01-02"></time><p>')
    html = [PAGE, plain, tags, None, "", "<p>"]
    assert one(spark, html, pg.title) == ["LD title", "OG title", "Tag title", None, None, None]
    assert one(spark, html, pg.published) == ["2021-05-06", "2020-03-04", "2019-01-02", None, None, None]
    assert one(spark, html, pg.author)[:2] == ["Ann B, Cy D", None]
    assert one(spark, html, pg.language) == ["en", "en", "en", None, None, None]
    assert one(spark, ["March 2012One", "July 5, 2023 x", "In May 2020", "May 20201"], pg.byline_date) == ["2012-03-01", "2023-07-05", None, None]
    share = one(spark, [PAGE, "", None], pg.link_share)
    assert share[0] == pytest.approx(9 / 20, abs=0.02) and share[1] == 0.0


def test_page_type_and_kind(spark):
    rows = [(200, 0.1, 20, 0, False), (200, 0.6, 20, 0, False), (10, 0.1, 2, 1, False), (500, 0.1, 2, 1, True), (10, 0.0, 1, 0, False)]
    df = spark.createDataFrame(rows, "w int, s double, l int, v int, t boolean")
    got = [r[0] for r in df.select(pg.page_type(*[F.col(c) for c in "wslvt"])).collect()]
    assert got == ["article", "listing", "video", "video", "other"]
    rows = [("article", "https://e.com/blog/", "https://e.com/blog", 1, 200, False), ("article", "https://e.com/tag/x", "https://e.com/", 0, 200, False),
            ("video", "https://e.com/v", "https://e.com/", 0, 200, True), ("article", "https://e.com/a", None, None, 200, False)]
    df = spark.createDataFrame(rows, "k string, u string, s string, d int, w int, n boolean")
    assert [r[0] for r in df.select(pg.page_kind(*[F.col(c) for c in "kusdwn"])).collect()] == ["listing", "listing", "article", "article"]


def test_chapter_titles(spark):
    assert one(spark, ["Chapter 4: Start", "4. The  end", "IV. War", "Civil War", "12", "II", None], bk.plain) == ["Start", "The end", "War", "Civil War", "12", "II", ""]
    assert one(spark, ["Copyright", "Further Reading", "3. Notes", "Notebook", "The index fund", "About the author"], bk.is_matter) == [True, True, True, False, False, True]
    assert one(spark, ["Notes"], lambda t: bk.is_matter(t, include=("notes",))) == [False]
    df = spark.createDataFrame([("1 THE START It was", "1. The start", True), ("It was long before the start", "The start", False), ("x", "ab", False)], "p string, t string, w boolean")
    assert all(r[0] == r[1] for r in df.select("w", bk.opens_with(F.col("p"), F.col("t"))).collect())


def test_bibliography(spark):
    lines = [["ISBN 978-0-306-40615-7 (hardcover)", "eISBN: 978-1-4028-9462-6"], ["ISBN 0-306-40615-2 | ISBN 978-1-4028-9462-6 (ebook)"], ["ISBN 978-0-306-40615-8"], []]
    assert one(spark, lines, bk.pick_isbn, "array<string>") == ["9781402894626", "9781402894626", None, None]
    years = [["Copyright © 2014 by X", "© 1999"], ["(c) by Y", "copyright 2001"], ["Printed 2003"]]
    assert one(spark, years, bk.copyright_year, "array<string>") == [2014, 2001, None]
    assert [tuple(r) for r in one(spark, ["A: b: c", "Only", " : x", None], bk.split_title)] == [("A", "b: c"), ("Only", None), (None, "x"), (None, None)]
    got = one(spark, ["Horowitz, Ben", "A B & C D; E F", "A B, C D and E F", "A B and C D", "", None], bk.split_authors)
    assert got == [["Ben Horowitz"], ["A B", "C D", "E F"], ["A B", "C D", "E F"], ["A B", "C D"], [], []]
    assert one(spark, got, bk.speaker, "array<string>") == ["Ben Horowitz", "A B, C D and E F", "A B, C D and E F", "A B and C D", None, None]
    assert one(spark, ["A b!", "---", None], bk.slug) == ["a-b", "untitled", "untitled"]

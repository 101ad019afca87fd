import random

from pyspark.sql import functions as F

from gleanery.llm import main_content as mc
from gleanery.llm import repeated_lines as rl
from gleanery.llm.html_lines import line_key, page_view, visible_lines

PAGES = "doc_id string, source_id string, raw_path string, norm string, html string"
RAW = "raw_path string, html string, doc_id string"


def page(title, body, n):
    return "\n".join(
        ["<html><head>", f"<title>{title} - Site</title>", "</head><body>", "<nav><ul>", '<li><a href="/a">Home</a>', "</ul></nav>", "<main>",
         f"<h1>{title}</h1>", f"<p>Posted on {n} May 20{n:02d}</p>", *body, "</main>", "<div>", "<h3>7 comments</h3>",
         f"<p>Ann: my own view number {'x' * n} is this.</p>", "</div>", "<footer>", "<p>All rights reserved</p>", "</footer></body></html>"]
    )


def frames(spark, pages, raw):
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(raw, RAW)


def site(n=12):
    names = ["apple", "pear", "plum", "fig", "kiwi", "lime", "date", "nut", "rice", "corn", "bean", "leek"]
    raw = [
        (f"p{i}", page(f"On the {w} tree", [f"<p>The {w} grows slowly in {w} gardens.", "It is eaten often as a %s.</p>" % (w * 2)], i + 1), "x")
        for i, w in enumerate(names[:n])
    ]
    pages = [(f"d{i}", " S " if i % 2 else "s", f"p{i}", "z", "y") for i in range(n)]
    return pages + [pages[0]], raw


def test_visible_lines_keep_numbers_over_tags_and_scripts():
    html = "a<!-- x\ny -->b\n<script>1\n2</script>c &amp; d\n<p\nclass=x>e"
    assert visible_lines(html) == ["a", "b", "", "c & d", "", "e"]
    assert visible_lines(None) == [] and visible_lines("") == []
    assert line_key("Page 12 of  340") == line_key("PAGE 7 of 1")


def test_leaf_containers_are_paragraphs():
    _, rows, _ = page_view('<body>\n<div class="m">\n<div class="p">one\ntwo</div>\n<p>three</p>\n</div>')
    assert [r.no for r in rows] == [3, 4, 5] and len({r.branch for r in rows}) == 1


def test_repeated_lines(spark):
    pages, raw = site()
    got = {tuple(r) for r in rl.repeated_lines(*frames(spark, pages, raw)).select("doc_id", "line_no").collect()}
    lines = {no for d, no in got if d == "d3"}
    # menu entry, date (digits folded), comments heading and footer
    assert {5, 9, 14, 18} <= lines and 10 not in lines and 8 not in lines
    few_pages, few_raw = site(7)
    assert rl.repeated_lines(*frames(spark, few_pages, few_raw)).count() == 0


def test_repeated_lines_count_pages_not_occurrences_and_skip_nulls(spark):
    pages = [(f"d{i}", "s", f"p{i}", "", "") for i in range(7)] + [("d7", None, "p7", "", ""), ("d8", "s", None, "", ""), ("d9", "s", "p9", "", "")]
    raw = [(f"p{i}", "same\nsame", "") for i in range(8)] + [("p9", None, "")]
    assert rl.repeated_lines(*frames(spark, pages, raw)).count() == 0
    assert rl.repeated_lines(*frames(spark, pages, raw), min_pages=7).count() == 14
    assert rl.repeated_lines(*frames(spark, [], [])).count() == 0


def test_pages_without_repeats(spark):
    pages, raw = site()
    got = {r["doc_id"]: r for r in rl.pages_without_repeats(*frames(spark, pages, raw)).collect()}
    assert "Home" not in got["d1"]["text"] and "pear" in got["d1"]["text"] and got["d1"]["n_removed"] > 0


def test_main_lines(spark):
    pages, raw = site()
    got = {}
    for r in mc.main_lines(*frames(spark, pages, raw)).collect():
        got.setdefault(r[0], set()).add(r[1])
    assert got["d2"] == {8, 10, 11}


def test_index_pages_and_empty_pages_have_no_body(spark):
    pages, raw = site()
    links = [f'<li><a href="/p/{i}">A long title of piece number {i}</a>' for i in range(9)]
    pages += [("dx", "s", "px", "", ""), ("dn", "s", "pn", "", ""), ("de", "s", "pe", "", "")]
    raw += [("px", page("All the pieces here", links, 3), ""), ("pn", None, ""), ("pe", "", "")]
    got = {r[0] for r in mc.main_lines(*frames(spark, pages, raw)).collect()}
    assert not got & {"dx", "dn", "de"}
    assert mc.main_lines(*frames(spark, [], [])).count() == 0


def test_style_tree_scores_elements_by_their_styles(spark):
    """All pages build their side box alike and the piece each in its own way; by
    their styles alone the box scores low and the piece high."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    pages, raw = [], []
    for i in range(40):
        side = "".join(f"<p>{' '.join(word() for _ in range(4))}\n" for _ in range(3))
        body = "".join(f"<{rnd.choice(['p', 'li', 'h2'])}>{' '.join(word() for _ in range(9))}\n" for _ in range(rnd.randint(5, 12)))
        raw.append((f"r{i}", f"<body>\n<div class=box>\n{side}</div>\n<div class=piece>\n<p>{word()} {word()}\n{body}</div>", "x"))
        pages.append((f"d{i}", "S", f"r{i}", "", ""))
    got = {(r["doc_id"], r["line_no"]) for r in mc.main_lines(*frames(spark, pages, raw)).collect()}
    nos = {n for d, n in got if d == "d7"}
    assert nos == set(range(8, 8 + raw[7][1].split("piece>")[1].count("\n<") - 1))
    nodes = mc.page_nodes(*frames(spark, pages, raw))
    lines = nodes.select("host", F.inline("nodes")).withColumn("importance", F.lit(1.0))
    tree = [r["composite"] for r in mc.branch_importance(nodes.select("host", F.inline("elements")), lines.where("false")).collect()]
    assert min(tree) < 0.2 and max(tree) > 0.8  # by their styles alone

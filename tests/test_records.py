"""Rules of moments, sections, trims, codes and chapters on hand-made rows."""

from pyspark.sql import functions as F

from gleanery.functions import records as rc
from gleanery.operators import books as ob
from gleanery.operators import spans as sp


def one(spark, values, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(fn(F.col("v"))).collect()]


def test_moments_of_spans(spark):
    spans = spark.createDataFrame([("q", 130, 150, 2), ("q", 60, 180, 3), ("z", 5, 5, 1), ("y", 0, 50, 1)], "q string, lo long, hi long, grade int")
    got = {(r["q"], r["moment"]): r["grade"] for r in sp.graded_moments(spans, ["q"], "lo", "hi", "grade").collect()}
    assert got == {("q", 0): 3, ("q", 60): 3, ("q", 120): 3, ("y", 0): 1}


def test_nearest_points_and_sections(spark):
    left = spark.createDataFrame([("d", "a", 5), ("d", "b", 12), ("d", "c", 100), ("e", "x", 1)], "d string, k string, at long")
    right = spark.createDataFrame([("d", 0), ("d", 10), ("d", 14), ("d", None), ("f", 1)], "d string, p long")
    got = {r["k"]: r["p"] for r in sp.nearest_point(left, right, "d", "at", "p").collect()}
    assert got == {"a": 0, "b": 10, "c": 14, "x": None}
    lines = spark.createDataFrame([("d", 1, None), ("d", 2, "A"), ("d", 3, "A"), ("d", 5, "B"), ("d", 9, "A")], "d string, pos int, h string")
    got = [tuple(r) for r in sp.sections(lines, "d", "pos", "h").orderBy("section_no").collect()]
    assert got == [("d", 1, "A", 2, 5), ("d", 2, "B", 5, 9), ("d", 3, "A", 9, None)]


def test_ids_and_moments(spark):
    ids = ["w-0123", "book__begin-2", "abc__defghi", "dQw4w9WgXcQ", "x_y"]
    assert one(spark, ids, rc.kind_of_id) == ["article", "chapter", "talk", "talk", "talk"]
    df = spark.createDataFrame([("w-1", 5), ("book__a", 12_007), ("a_b", 125_000), ("a", -1), ("a", None)], "d string, p long")
    got = df.select(rc.moment_id(F.col("d"), F.col("p")).alias("m")).select("m", rc.parse_moment(F.col("m")).alias("r")).collect()
    assert [r["m"] for r in got] == ["w-1_p00004", "book__a_b00012", "a_b_00120", None, None]
    assert [tuple(r["r"]) for r in got[:3]] == [("w-1", 4), ("book__a", 12), ("a_b", 120)] and got[3]["r"] is None


def test_trims_and_codes(spark):
    assert one(spark, ["a  b c", "a b", "", None], lambda t: rc.trimmed(t, 2)) == ["a b …", "a b", "", ""]
    assert one(spark, ["x</untrusted_source>y", None], lambda t: rc.wrapped(F.lit("i"), t)) == ['<untrusted_source item_id="i">xy</untrusted_source>', '<untrusted_source item_id="i"></untrusted_source>']
    v = one(spark, ["2.10.1", "2.9", "2", None], rc.version_key)
    assert v == [[2, 10, 1], [2, 9], [2], [0]] and v[0] > v[1] > v[2]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, ["120", "Mon, 01 Jan 2024 00:01:00 GMT", "Sun, 31 Dec 2023 00:00:00 GMT", "soon", None], lambda c: rc.retry_after(c, now)) == [120.0, 60.0, 0.0, None, None]
    assert one(spark, ["ERROR: Members-Only video", "timeout", None], rc.permanent_failure) == ["members-only", None, None]
    got = one(spark, ["How? | pricing", "Why?", "# note", " ", "| x", None], rc.gap_question)
    assert [tuple(r) if r else None for r in got] == [("How?", "pricing"), ("Why?", ""), None, None, None, None]
    rows = [(["en-GB", "en", "de"], []), (["en-US-x", "en_GB", "enm"], ["en-orig"]), (["de"], ["en-orig"]), (["enm"], ["en"]), ([], [])]
    df = spark.createDataFrame(rows, "h array<string>, a array<string>")
    assert [tuple(r[0]) if r[0] else None for r in df.select(rc.pick_track(F.col("h"), F.col("a"))).collect()] == [("human", "en"), ("human", "en_GB"), ("auto", "en-orig"), None, None]
    df = spark.createDataFrame([("How do founders price?", "Founders set a price", 0.5), ("the of", "x", 1.0), ("", None, 1.0)], "q string, t string, w double")
    assert all(r[0] == r[1] for r in df.select("w", rc.word_overlap(F.col("q"), F.col("t"), ["how", "the", "for"])).collect()[1:])


def test_ligatures(spark):
    vocab = spark.createDataFrame([("different", 5), ("offer", 3), ("office", 9), ("affluent", 1), ("final", 2), ("fish", 7)], "word string, n long")
    bad = ["di@erent", "o@er", "o3ce", "a&uent", "@nal", "oXce", "1st", "word", "di@er@nt", "Fish"]
    got = {r["c"]: r["fixed"] for r in ob.repair_ligatures(spark.createDataFrame([(b,) for b in bad], "c string"), "c", vocab).collect()}
    assert got == {"di@erent": "different", "o@er": "offer", "o3ce": "office", "a&uent": "affluent", "@nal": "final", "oXce": "office"}


def book(spark):
    text = "word " * 70
    rows = [("b", 1, 0, "Contents", "text", 0), ("b", 3, 1, "1 THE START", "heading", 1), ("b", 3, 2, text, "text", 0), ("b", 8, 3, "2. Middle part", "heading", 1),
            ("b", 8, 4, text, "text", 0), ("b", 12, 5, "3 The End it was", "heading", 1), ("b", 12, 6, text, "text", 0), ("b", 20, 7, "Index", "heading", 1), ("b", 20, 8, text, "text", 0)]
    rows += [("w", p, p, text, "text", 0) for p in range(1, 33)]
    return spark.createDataFrame(rows, "book string, page long, pos int, text string, kind string, level int")


def test_chapters_of_books(spark):
    paragraphs = book(spark)
    entries = spark.createDataFrame([("b", i, t, 1) for i, t in enumerate(["1. The start", "2. Middle part", "3. The end", "Index"])], "book string, no int, title string, contents_page long")
    found = ob.align_contents(entries, paragraphs)
    assert sorted((r["title"], r["page"]) for r in found.collect()) == [("1. The start", 3), ("2. Middle part", 8), ("3. The end", 12), ("Index", 20)]
    few = entries.where("no < 2")
    assert ob.align_contents(few, paragraphs).count() == 0
    got = [(r["book"], r["method"], r["title"], r["page"]) for r in ob.detect_chapters([("contents", found)], paragraphs).orderBy("book", "page").collect()]
    assert got == [("b", "contents", "The start", 3), ("b", "contents", "Middle part", 8), ("b", "contents", "The end", 12),
                   ("w", "windows", "Pages 1-15", 1), ("w", "windows", "Pages 16-30", 16), ("w", "windows", "Pages 31-32", 31)]
    heads = ob.numbered_headings(paragraphs)
    assert {(r["title"], r["page"]) for r in heads.collect()} == {("1 THE START", 3), ("2. Middle part", 8), ("3 The End it was", 12), ("Index", 20)}
    got = ob.detect_chapters([("contents", ob.align_contents(few, paragraphs)), ("headings", heads)], paragraphs).where("book = 'b'").select("method").distinct().collect()
    assert [r[0] for r in got] == ["headings"]


def test_hash_embedding_equals_the_definition(spark):
    import hashlib
    import math

    texts = ["Price, price and PRICE!", "", None, "a 'quoted' word.  x"]
    for text, got in zip(texts, one(spark, texts, rc.hash_embedding)):
        v = [0.0] * 64
        for w in (text or "").lower().split():
            v[int(hashlib.md5(w.strip(".,?!'\"").encode()).hexdigest(), 16) % 64] += 1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(a - b / n) < 1e-6 for a, b in zip(got, v))


def test_votes_parts_dates_and_citations(spark):
    rows = [([False, True, True], False, True), ([False, False], False, False), ([False], True, False), ([True, False, False], False, True), ([False, True], False, None), ([], False, None)]
    df = spark.createDataFrame(rows, "o array<boolean>, once boolean, w boolean")
    assert all(r[0] == r[1] for r in df.select("w", rc.majority_of_trials(F.col("o"), F.col("once"))).collect())
    rows = [(True, True, None, True), (True, False, True, True), (True, False, None, False), (False, False, True, False), (True, None, None, False)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, w boolean")
    assert all(r[0] == r[1] for r in df.select("w", rc.claim_supported(F.col("a"), F.col("b"), F.col("c"))).collect())
    df = spark.createDataFrame([([["a"], ["b", "c"], ["d"]], [["c"], ["a"]], 2), ([["a"], ["b"]], [None], 2), ([["a"]], [], 0)], "e array<array<string>>, s array<array<string>>, w int")
    assert all(r[0] == r[1] for r in df.select("w", rc.parts_reached(F.col("e"), F.col("s"))).collect())
    got = one(spark, ["Positions as of 3/7/2024", "Date downloaded 2024-02-30 or 2024-03-01", "as of Mar-09-2024", "3/7/2024", None], rc.as_of_date)
    assert [str(d) if d else None for d in got] == ["2024-03-07", None, "2024-03-09", None, None]
    df = spark.createDataFrame([("see [a](https://e.com/x#:~:text=hi) and [b](https://e.com/y), PDF p. 4 and PDF p. 5", 'https://e.com/x ... , PDF p. 4 "page": 7')], "a string, s string")
    assert df.select(rc.uncited(F.col("a"), F.col("s"))).first()[0] == ["https://e.com/y", "PDF p. 5"]

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as ft
from gleanery.operators import decisions as dec
from gleanery.operators import retrieval as rt
from gleanery.operators import segments as sg
from gleanery.operators.graph import bounded_walk, components
from gleanery.operators import coverage, metrics, quotes
from gleanery.sources import broker_csv, captions, sinks, sitemap, trec


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_bm25_prefers_rare_terms_and_short_documents(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple pie " + "filler words " * 20), (3, "plum cake"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(0, "the apple")], "qid long, q string")
    got = rt.top_k(rt.bm25_scores(docs, "id", "text", q, "qid", "q"), "qid", "id", "score", 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]


def test_rrf_order_and_ties(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "qid long, k string, rank int")
    b = spark.createDataFrame([(0, "c", 1), (0, "a", 2)], "qid long, k string, rank int")
    fused = rt.fused_top(rt.rrf([(a, 1.0, "ra"), (b, 1.0, "rb")], "qid", "k"), "qid", "k", ["ra", "rb"], 10)
    assert [r["k"] for r in fused.orderBy("rank").collect()] == ["a", "c", "b"]


def test_dense_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype(float)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, v array<double>")
    asked = v.where("id < 5").withColumnRenamed("id", "q")
    got = rows(rt.dense_top_k(v, "id", "v", asked, "q", 3, exclude_self=True), "q", "rank", "id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for i in range(5):
        c = u @ u[i]
        c[i] = -9
        want += [(i, r + 1, int(j)) for r, j in enumerate(np.argsort(-c)[:3])]
    assert got == sorted(want)


def test_quote_and_document_caps_equal_the_greedy_rule(spark):
    rnd = random.Random(3)
    data = [(0, r, f"d{rnd.randint(0, 3)}", rnd.choice(["", "q1", "q2", "q3", "Q1 "])) for r in range(1, 200)]
    df = spark.createDataFrame(data, "qid long, rank int, doc string, quote string")
    got = [r[0] for r in rows(rt.quote_and_document_caps(df, "qid", "doc", "quote", "rank"), "rank")]
    kept = []
    for _, r, d, q in data:
        q = q.strip().lower()
        same = [k for k in kept if k[1] == d]
        if len(same) < 3 and not (q and any(k[2] == q for k in same)):
            kept.append((r, d, q))
    assert got == [k[0] for k in kept]


def test_diversify_rules(spark):
    data = [(0, 1, 1, "s", "one two three four five"), (0, 2, 2, "s", "one two three four five"), (0, 3, 3, "s", "six seven eight"), (0, 4, 4, "s", "nine ten eleven")]
    df = spark.createDataFrame(data, "qid long, id long, rank int, series string, text string")
    got = rt.diversify(df, "qid", "id", [rt.NearDuplicate(), rt.SeriesCap(2)], 10)
    assert [r[0] for r in rows(got, "id")] == [1, 3]


def test_rolling_captions(spark):
    data = [(1, 0, 0, "hello there my"), (1, 1, 10, "there my friends"), (1, 2, 20, "there my friends"), (1, 3, 30, "new words")]
    df = spark.createDataFrame(data, "doc_id long, cue_no int, start_ms long, text string")
    assert rows(sg.rolling_dedup(df), "cue_no", "fresh") == [(0, "hello there my"), (1, "friends"), (2, ""), (3, "new words")]


def test_utterance_merge_breaks_on_pause_and_span(spark):
    data = [(1, 0, 1000), (1, 1500, 2000), (1, 4000, 5000), (1, 5100, 30000)]
    df = spark.createDataFrame(data, "doc_id long, start_ms long, end_ms long")
    assert rows(sg.merge_utterances(df), "start_ms", "end_ms", "n_cues") == [(0, 2000, 2), (4000, 5000, 1), (5100, 30000, 1)]


def test_chunks_carry_a_tail_but_never_repeat_it_alone(spark):
    units = spark.createDataFrame([(1, i, "w " * 100) for i in range(9)] + [(2, 0, "")], "doc_id long, pos long, text string")
    got = rows(sg.chunk_units(units, budget=400, overlap=0.4), "doc_id", "chunk_no", "first_pos", "last_pos")
    assert got[0][:3] == (1, 0, 0)
    firsts = [g for g in got if g[0] == 1]
    assert all(b[2] == a[3] for a, b in zip(firsts, firsts[1:]))  # one unit carried
    assert firsts[-1][3] == 8


def test_windows_and_splits(spark):
    units = spark.createDataFrame([(1, i, "w " * 300) for i in range(4)], "doc_id long, pos long, text string")
    assert rows(sg.greedy_windows(units, 800), "pos", "window_no") == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert [r[1] for r in rows(sg.split_long(units.limit(1), 140), "part", "n_words")] == [100, 100, 100]


def test_text_functions(spark):
    df = spark.createDataFrame([("0-306-40615-2", "Companies & Buses", "A  um [laughs] quote (so very nice), ok")], "i string, n string, q string")
    r = df.select(ft.isbn13(F.col("i")), ft.singular_key(F.col("n")), ft.normal_words(F.col("q"))).collect()[0]
    assert r[0] == "9780306406157"
    assert r[1] == "company and buse"
    assert r[2] == ["a", "quote", "ok"]


def test_graph_walk_and_components(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("x", "y", "r")], "src string, dst string, relation string")
    walk = bounded_walk(e, spark.createDataFrame([("a",)], "node string"), 2)
    assert rows(walk, "hop", "src", "dst") == [(1, "a", "b"), (2, "b", "c")]
    assert rows(components(e.select("src", "dst"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]


def test_isotonic_and_statistics(spark):
    knots = dec.isotonic(np.array([0.1, 0.2, 0.3]), np.array([0.5, 0.3, 0.9]), np.array([10, 10, 10]))
    assert [(round(x, 9), round(y, 9)) for x, y in knots] == [(0.15, 0.4), (0.3, 0.9)]
    assert dec.isotonic(np.array([0.1, 0.1, 0.4]), np.array([0.1, 0.2, 0.3]), np.array([5, 5, 5])) == [(0.1, 0.1), (0.4, 0.3)]
    pairs = spark.createDataFrame([(i / 200, int(i > 100)) for i in range(200)], "s double, y int")
    knots = dec.isotonic_fit(pairs, "s", "y")
    assert [k[1] for k in knots] == sorted(k[1] for k in knots)
    assert dec.isotonic_fit(pairs.limit(20), "s", "y") is None
    assert math.isclose(dec.binomial_tail(1, 9), 2 * (1 + 10) / 1024)
    assert dec.binomial_tail(0, 0) == 1.0
    assert dec.fleiss_kappa([[3, 0], [0, 3]]) == 1.0 and math.isnan(dec.fleiss_kappa([]))
    halves = spark.createDataFrame([(i, float(i % 2)) for i in range(100)], "k int, v double")
    got = dec.bootstrap(halves, "k", "v", 500).first()
    assert 0.35 < got["low"] < 0.45 and 0.55 < got["high"] < 0.65
    assert dec.randomization_p(halves.selectExpr("k", "0.5D AS v").where("k < 20"), "k", "v", 500).first()["p"] < 0.01
    assert dec.randomization_p(halves.selectExpr("k", "v - 0.5 AS v"), "k", "v", 500).first()["p"] > 0.5


def test_leader_clusters_follow_the_running_centroid(spark):
    data = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)]
    got = dec.leader_clusters(spark.createDataFrame(data, "id long, v array<double>"), "id", "v")
    assert {r["size"] for r in got.collect()} == {20}
    # drifts: each vector is near the centroid so far, the last far from the first
    turn = [(i, [math.cos(i * 0.03), math.sin(i * 0.03)]) for i in range(60)] + [(99, [-1.0, 0.0])]
    x = [np.array(v) for _, v in turn]
    sums, owner = [], []
    for v in x:
        cos = [s @ v / np.linalg.norm(s) for s in sums]
        j = int(np.argmax(cos)) if cos else -1
        if j < 0 or cos[j] < 0.75:
            sums.append(v.copy())
            owner.append(len(sums) - 1)
        else:
            sums[j] += v
            owner.append(j)
    firsts = [turn[owner.index(j)][0] for j in range(len(sums))]
    want = {k: firsts[o] for (k, _), o in zip(turn, owner)}
    got = dec.leader_clusters(spark.createDataFrame(turn, "id long, v array<double>").repartition(5), "id", "v", least=1).collect()
    assert {r["id"]: r["cluster"] for r in got} == want


def test_quotes_equal_brute_force(spark):
    rnd = random.Random(5)
    cases = []
    for i in range(60):
        text = [rnd.choice("abcdefgh") + rnd.choice("xy") for _ in range(rnd.randint(0, 40))]
        at = rnd.randint(0, max(0, len(text) - 3))
        quote = [w for w in text[at:at + rnd.randint(0, 14)] if rnd.random() < 0.9]
        cases.append((i, " ".join(quote), " ".join(text)))

    def brute(quote, text):
        q, t = quote.split(), text.split()
        if not q or not t:
            return 0.0, None, False
        def windows(size):
            return [(s, set(t[s:s + size])) for s in range(max(1, len(t) - size + 1))]
        best = max(((len(w & set(q)) / len(w | set(q)), -s) for s, w in windows(max(4, len(q)))))
        found = (best[0], -best[1] if best[0] else None, best[0] >= 0.7)
        if found[2] or len(set(q)) < 8:
            return found
        held = (0.0, None)
        for scale in (1.15, 1.3, 1.5):
            for s, w in windows(int(round(len(q) * scale))):
                c = len(w & set(q)) / len(set(q))
                if c > held[0]:
                    held = (c, s)
        return (*held, True) if held[0] >= 0.9 else found

    got = quotes.ground_quotes(spark.createDataFrame(cases, "id int, q string, t string"), "id", "q", "t").orderBy("id").collect()
    for r, (_, q, t) in zip(got, cases):
        assert (r["score"], r["at"], r["ok"]) == pytest.approx(brute(q, t)), (q, t)


def test_quote_pieces_and_roll_up(spark):
    text = "well um the first ten customers came from cold calls [music] and nobody paid us for two whole years after that"
    rows = [(1, "first ten customers came from ... nobody paid us for two", text), (2, "first ten customers came from ... sold the company to them", text),
            (3, "The first (laughs) ten customers", text), (4, None, text), (5, "...", text), (6, "x", None)]
    got = {r["id"]: r for r in quotes.ground_quotes(spark.createDataFrame(rows, "id int, q string, t string"), "id", "q", "t").collect()}
    assert [got[i]["ok"] for i in range(1, 7)] == [True, False, True, False, False, False]
    assert got[1]["at"] == 2 and got[3]["score"] == 1.0 and got[4]["score"] == 0.0 and got[4]["at"] is None
    checked = spark.createDataFrame([("a", True)] * 9 + [("a", False), ("b", True), ("b", False), ("c", None), ("d", True), ("e", False)], "d string, ok boolean")
    r = {x["d"]: (x["checked"], x["failed"], x["status"]) for x in quotes.roll_up(checked, "d", F.col("d") == "d").collect()}
    assert r == {"a": (10, 1, "pass"), "b": (2, 1, "failed"), "c": (0, 0, "pass"), "d": (1, 0, "flagged"), "e": (1, 1, "failed")}


def test_metrics_on_the_textbook_example(spark):
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "c", 0), ("q", "d", 2), ("n", "a", 1), ("z", "a", 0)], "qid string, did string, grade int")
    runs = spark.createDataFrame([("q", d, i) for i, d in enumerate("caxd", 1)] + [("z", "a", 1)], "qid string, did string, rank int")
    got = {r["qid"]: r for r in metrics.per_query(runs, qrels, 10).collect()}
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    assert set(got) == {"q", "n"} and got["n"]["ndcg"] == 0.0
    q = got["q"]
    assert q["ndcg"] == pytest.approx((3 / math.log2(3) + 2 / math.log2(5)) / ideal) and q["recall"] == pytest.approx(2 / 3)
    assert q["mrr"] == 0.5 and q["judged"] == 0.75 and q["condensed"] == pytest.approx((3 / math.log2(3) + 2 / 2) / ideal)
    assert metrics.per_query(runs, qrels, 10, 2).where("qid = 'q'").first()["recall"] == 1.0
    state = [metrics.verdict(spark.createDataFrame([(f,)], "fails_gate boolean"), F.lit(j), F.lit(s)).first()[0] for f, j, s in ((True, 1.0, True), (False, 1.0, None), (True, 0.5, True), (False, 1.0, False))]
    assert state == ["fail", "pass", "inconclusive", "inconclusive"]


def test_coverage_rules(spark):
    cols = "qid int, domain int, item_id int, doc_id string, source_id string, series string, p double, best double, tier string, year int"
    hits = [(1, 1, i, d, "s", s, p, None, t, y) for i, (d, s, p, t, y) in enumerate([
        ("d1", "x", 0.7, "medium", 2020), ("d1", "x", 0.9, "medium", 2024)])]  # one document only
    hits += [(1, 2, 10, "d1", "s", "x", 0.6, None, "medium", 2019), (1, 2, 11, "d2", "s", "x", 0.61, None, "medium", 2018)]
    hits += [(1, 3, 20, "d1", "s", "x", 0.8, None, "high", None), (1, 3, 21, "d2", "s", "x", 0.8, None, "high", None)]  # one voice
    hits += [(1, 4, 30, "d1", "s", "x", 0.5, None, "low", 2000), (1, 4, 31, "d1", "s", "x", 0.5, None, "low", 2001)]
    hits += [(1, 5, 40, "d1", "s", "x", 0.3, None, "low", 2024), (1, 6, 50, "d1", "s", "x", None, None, "low", 2024), (1, 7, 60, "d1", "s", "x", 0.2, 0.5, "medium", 2024)]
    got = {r["domain"]: (r["level"], r["newest_year"]) for r in coverage.levels(spark.createDataFrame(hits, cols), ["qid", "domain"]).collect()}
    assert got == {1: ("partial", 2024), 2: ("strong", 2019), 3: ("partial", None), 4: ("strong", 2001), 5: ("none", None), 6: ("none", None), 7: ("partial", None)}
    by = spark.createDataFrame([(1, 1, "strong"), (1, 2, "partial"), (2, 1, "none"), (3, 1, "strong")], "qid int, domain int, level string")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 9)], "qid int, domain int")
    got = {r["qid"]: (r["level"], r["weak"]) for r in coverage.combined(coverage.with_empty(by, asked, "qid"), "qid").collect()}
    assert got == {1: ("partial", [2]), 2: ("none", []), 3: ("partial", [9])}
    rates = spark.createDataFrame([(0.0, 0.2, 0.0), (0.02, 0.1, 0.15), (-0.02, 0.1, 0.15), (0.04, 0.0, 0.15), (0.06, 0.0, 0.2)], "shift double, answered double, refused double")
    assert coverage.recommended(rates).first()["shift"] == 0.04


def test_captions(spark):
    srt = "﻿1\r\n00:00:01,500 --> 00:00:03,000\r\n<i>Hello</i>\r\nthere\r\n\r\n2\r\n00:00:05,000 --> 00:00:04,000\r\n\r\n\r\n3\r\n01:00:00.000 --> 01:00:01.000\r\nBye"
    got = rows(captions.parse_captions(spark.createDataFrame([("p", srt)], "path string, value string")), "start_ms", "dur_ms", "text")
    assert got == [(1500, 1500, "Hello there"), (3_600_000, 1000, "Bye")]


def test_trec_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("1", "a", 3), ("1", "b", 0)], "qid string, did string, grade int")
    trec.write_qrels(q, f"{tmp_path}/q")
    assert rows(trec.read_qrels(spark, f"{tmp_path}/q")) == [("1", "a", 3), ("1", "b", 0)]
    (tmp_path / "r.txt").write_text("1 Q0 b 2 0.5 t\n1 Q0 a 1 0.9 t\nbroken line\n")
    assert rows(trec.read_run(spark, f"{tmp_path}/r.txt"), "qid", "did", "rank") == [("1", "a", 1), ("1", "b", 2)]


def test_sitemap(spark):
    xml = "<urlset><url><loc> https://a.example/x </loc><lastmod>2024-01-01</lastmod></url></urlset><sitemapindex><sitemap><loc>https://a.example/s.xml</loc></sitemap></sitemapindex>"
    got = rows(sitemap.parse_sitemaps(spark.createDataFrame([("p", xml)], "path string, value string")), "kind", "loc")
    assert got == [("child", "https://a.example/s.xml"), ("page", "https://a.example/x")]


def test_broker_csv(spark):
    lines = ["Positions as of 1/2/2024", "", 'Account Name,Symbol,Description,Quantity,Current Value', 'Main,ABC,"Fund, one",10,"$1,234.56"', "Main,CASH**,Money,1,(12.00)", "Main,Pending activity,,,5", "Total,,,,1"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines, 1)] + [("g", 1, "a,b"), ("g", 2, "1,2")], "path string, line_no int, value string")
    assert rows(broker_csv.parse_positions(df), "symbol", "value_cents") == [("ABC", 123456), ("CASH", -1200)]


def test_sinks(spark):
    cur = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert rows(sinks.replace_by_key(cur, spark.createDataFrame([(1, "z")], "k int, v string"), "k")) == [(1, "z"), (2, "c")]
    assert rows(sinks.keep_only(cur, spark.createDataFrame([(2,)], "k int"), "k")) == [(2, "c")]
    tags = spark.createDataFrame([(1, ["x"]), (2, ["d"])], "k int, t array<string>")
    have = spark.createDataFrame([(1, ["y"]), (2, None)], "k int, t array<string>")
    assert [r["changed"] for r in sinks.retag(have, tags, "k", "t", "d").orderBy("k").collect()] == [True, False]


def test_every_routed_domain_has_its_floor(spark):
    rows = [("q", i, i, "a", 1.0 - i / 100, 100.0 - i) for i in range(1, 9)]
    rows += [("q", 20, 9, "b", 0.7, 50.0), ("q", 21, 10, "b", 0.6, 49.0), ("q", 22, 11, "b", 0.55, 48.0), ("q", 23, 12, "c", 0.3, 10.0)]
    rows += [("s", i, i, "a", 1.0, 1.0) for i in range(1, 11)]
    ranked = spark.createDataFrame(rows, "qid string, k int, rank int, domain string, relevance double, score double")
    routed = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("s", "a")], "qid string, domain string")
    got = {}
    for r in rt.per_domain_floor(ranked, routed, "qid", "k").orderBy("final_rank").collect():
        got.setdefault(r["qid"], []).append(r["k"])
    assert got == {"q": [1, 2, 3, 4, 5, 6, 20, 21], "s": list(range(1, 9))}


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    from gleanery.streaming import events as ev

    for n, rows in enumerate([["10:05", "12:00"], ["10:10", "11:55", "12:30"], ["12:05", "11:00"], ["10:20", "11:59", "12:45"]]):
        spark.createDataFrame([(f"2024-01-01 {t}:00", "a") for t in rows], "ts string, event_type string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = (
        spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    )
    got = {r["started"] % 86400 // 3600: r["n"] for r in ev.run_to_end(ev.tumbling(stream), "update", ("event_type", "started")).collect()}
    # Spark drops by the watermark of the batch before: 10:20 and 11:59 come when it has passed their hours
    assert got == {10: 2, 11: 2, 12: 4}


def test_search_in_several_blocks_equals_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(60)], "id long, v array<double>, g int")
    asked = v.where("id < 20").selectExpr("id AS q", "v")
    want = {tuple(r) for g in (None, "g") for r in rt.dense_top_k(v, "id", "v", asked, "q", 3, True, g).select("q", "id", "rank").collect()}
    monkeypatch.setattr(rt, "QUERY_BLOCK", 7)
    got = {tuple(r) for g in (None, "g") for r in rt.dense_top_k(v, "id", "v", asked, "q", 3, True, g).select("q", "id", "rank").collect()}
    assert got == want


def test_joins_with_a_small_side_by_either_way(spark):
    from gleanery.operators.joins import join_small

    large = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("inner", "left"):
        one, other = (
            {tuple(r) for r in join_small(large, small, ["k"], F.col("i"), how, most).select("i", "k", "v").collect()} for most in (10, 0)
        )
        assert one == other and len(one) >= 42

import random

import numpy as np

from gleanery.llm import near_duplicates as nd
from gleanery.llm import similar_vectors as sv

REC = "id string, text string, key string, words string"


def brute(recs):
    sets = [(k, set(t.lower().split())) for k, t in recs if t and t.strip()]
    return {
        tuple(sorted((a, b))) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1:]
        if a != b and len(x & y) * 5 >= len(x | y) * 4
    }


def test_similar_records_equal_brute_force(spark):
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    recs = []
    for i in range(120):
        base = rnd.sample(vocab, rnd.choice([1, 2, 3, 5, 9, 12, 20, 40]))
        recs.append((f"k{i}", " ".join(base)))
        for j in range(2):
            edit = [w for w in base if rnd.random() > 0.08] + rnd.sample(vocab, rnd.randint(0, max(1, len(base) // 8)))
            rnd.shuffle(edit)
            recs.append((f"k{i}-{j}", " ".join(edit).upper()))
    data = [(k, t, "a", "b") for k, t in recs + [recs[0], ("n", None), ("e", ""), ("w", "  ")]]
    got = {(r["key_a"], r["key_b"]) for r in nd.similar_records(spark.createDataFrame(data, REC), "t", "id", "text").collect()}
    assert got == brute(recs) and got


def test_large_class_of_copies_stays_linear(spark):
    n = nd.EXPANDED_CLASS + 30
    data = [(f"k{i:03d}", "one two three", "", "") for i in range(n)]
    got = nd.similar_records(spark.createDataFrame(data, REC), "t", "id", "text").collect()
    assert len(got) == n - 1 and {r["key_a"] for r in got} == {"k000"}
    assert nd.connected_groups(nd.similar_records(spark.createDataFrame(data, REC), "t", "id", "text")).select("group_key").distinct().count() == 1


def test_one_edit(spark):
    ids = ["abcd", "abdc", "abce", "abc", "abcde", "ABCD", "xyz", "a", "b", "ab", None, "", "abcd"]
    got = {(r["key_a"], r["key_b"]) for r in nd.one_edit_apart(spark.createDataFrame([(i,) for i in ids], "v string"), "t", "v").collect()}

    def near(a, b):
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    real = sorted({i for i in ids if i})
    assert got == {(a, b) for i, a in enumerate(real) for b in real[i + 1:] if near(a, b)}


def test_empty_tables(spark):
    assert nd.similar_records(spark.createDataFrame([], REC), "t", "id", "text").count() == 0
    assert nd.one_edit_apart(spark.createDataFrame([], "v string"), "t", "v").count() == 0
    assert sv.nearest(spark.createDataFrame([], "space string, id long, data array<float>")).count() == 0


def test_sound_vectors(spark):
    nan = float("nan")
    data = [([1.0, 2.0],), ([0.0, 0.0],), ([nan, 1.0],), ([None, 1.0],), ([1.0],), (None,), ([float("inf"), 1.0],)]
    from pyspark.sql import functions as F
    got = spark.createDataFrame(data, "d array<float>").select(sv.sound(F.col("d"), F.lit(2))).collect()
    assert [r[0] for r in got] == [True] + [False] * 6


def test_nearest_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(150, 16))
    x = np.vstack([c + 0.15 * rng.normal(size=(8, 16)) for c in centres]).astype(np.float32)
    data = [("s", i, x[i].tolist()) for i in range(len(x))]
    got = {(r["id"], r["other"]) for r in sv.nearest(spark.createDataFrame(data + data[:5], "space string, id long, data array<float>"), 5).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-cos[i])[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_copies_are_neighbours_by_id(spark):
    data = [("s", i, [1.0, 0.0]) for i in range(9)] + [("s", 20, [1.0, 0.05]), ("t", 30, [1.0, 0.0])]
    got = {}
    for r in sv.nearest(spark.createDataFrame(data, "space string, id long, data array<float>"), 5, 0.8).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got[8] == {0, 1, 2, 3, 4} and got[0] == {1, 2, 3, 4, 5} and got[20] == {0, 1, 2, 3, 4} and 30 not in got

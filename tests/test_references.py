import datetime as dt

from pyspark.sql import functions as F

from gleanery.operators import references as ref

UTC = dt.timezone.utc
T0, T1, T2 = (dt.datetime(2024, m, 15, tzinfo=UTC) for m in (1, 2, 3))
REFS = "src_id string, key string, at timestamp, extra string, target string"
NODES = "id string, created timestamp, gone timestamp, key string"


def faults(spark, refs, parents):
    r = ref.reference_rows(spark.createDataFrame(refs, REFS), "edges", "src_id", "at", {"key": "nodes"})
    p = ref.parent_intervals(spark.createDataFrame(parents, NODES), "nodes", "id", "created", "gone")
    return {tuple(x) for x in ref.orphan_references(r, p).select("row_key", "period", "fault").collect()}


def test_missing_deleted_late_and_sound(spark):
    parents = [("A", T0, None, "x"), ("b ", T0, T1, "x"), ("c", T2, None, "x"), ("d", None, None, "x"), ("E", T0, T1, "x"), ("e", T2, None, "x")]
    refs = [
        ("1", "a", T1, "", ""), ("2", "\tB", T1, "", ""), ("3", "C", T1, "", ""), ("4", "d", T0, "", ""),
        ("5", "zz", None, "", ""), ("6", None, T1, "", ""), ("7", "  ", T1, "", ""), ("8", "c", None, "", ""),
        ("9", "e", T1, "", ""), ("5", "zz", None, "", ""),
    ]
    assert faults(spark, refs, parents) == {
        ("2", "2024-02", "deleted"), ("3", "2024-02", "late"), ("5", "unknown", "missing")
    }


def test_hot_key_takes_the_same_decisions(spark):
    refs = [(f"r{i}", "hot" if i % 3 else f"k{i}", T1, "", "") for i in range(900)]
    got = faults(spark, refs, [("hot", T2, None, "x")])
    assert sum(f == "late" for _, _, f in got) == 600
    assert sum(f == "missing" for _, _, f in got) == 300


def test_empty_inputs(spark):
    assert faults(spark, [], []) == set()
    assert faults(spark, [], [("a", T0, None, "x")]) == set()


def test_id_key_drops_outer_white_space_only(spark):
    row = spark.createDataFrame([(" \t a B ",), ("",), (None,)], "x string").select(ref.id_key(F.col("x"))).collect()
    assert [r[0] for r in row] == ["a b", None, None]


import numpy as np

from gleanery.operators import retrieval as rt
from gleanery.plans import decisions, units

DOCS = "doc_id long, text string"
TALKS = "doc_id long, version int, utterances array<struct<start_ms long, end_ms long, text string>>"


def test_domain_scores_see_every_label(spark, tmp_path):
    rng = np.random.default_rng(4)
    near = np.array([1.0, 0, 0, 0]) + 0.1 * rng.normal(size=(70, 4))
    far = np.array([-1.0, 0.5, 0, 0]) + 0.1 * rng.normal(size=(5, 4))
    x = np.vstack([near, far]).astype(np.float32)
    label = [1] * 68 + [2] * 2 + [3] * 5
    rows = [(100 if i == 0 else i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, label))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(
        str(tmp_path / "embeddings.parquet")
    )
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u[0]
    want = {}
    for l in set(label):
        best = sorted((c for i, c in enumerate(cos) if i and label[i] == l), reverse=True)[:3]
        want[l] = np.mean(best)
    got = {r["label"]: r["score_micro"] for r in decisions.domain_scores(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[l] - want[l] * 1e6) <= 1 for l in want)


def test_best_per_group_takes_null_as_a_group(spark):
    rows = [(i, [1.0, i / 10], "a" if i < 4 else None) for i in range(8)]
    v = spark.createDataFrame(rows, "id long, v array<float>, g string")
    asked = v.where("id = 0").selectExpr("id AS q", "v")
    got = {(r["g"], r["id"], r["rank"]) for r in rt.dense_top_k(v, "id", "v", asked, "q", 2, True, "g").collect()}
    assert got == {("a", 1, 1), ("a", 2, 2), (None, 4, 1), (None, 5, 2)}


def test_fingerprint_sees_text_version_and_order(spark, tmp_path):
    docs, talks = [(1, "a"), (2, "b"), (20001, None)], [(2, 1, None)]
    cases = {
        "same": (docs[::-1] + docs[:1], talks),
        "text": ([(1, "c"), *docs[1:]], talks),
        "exchanged": ([(1, "b"), (2, "a"), docs[2]], talks),
        "version": (docs, [(2, 2, None)]),
        "empty": ([*docs[:2], (20001, "")], talks),
        "base": (docs, talks),
    }
    got = {}
    for name, (d, t) in cases.items():
        spark.createDataFrame(d, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(t, TALKS).write.parquet(str(tmp_path / name / "transcripts.parquet"))
        got[name] = units.QUERIES["index_fingerprint"](spark, str(tmp_path / name)).collect()[0][0]
    assert got.pop("same") == got["base"] and len(set(got.values())) == 5


def test_asof_section_answers_every_cue(spark, tmp_path):
    spark.createDataFrame([(7, 1, [(s, s + 1, "x") for s in (0, 5, 10, 11, 99)]), (8, 1, [(3, 4, "x")])], TALKS).write.parquet(
        str(tmp_path / "transcripts.parquet")
    )
    spark.createDataFrame([("a", "7", 5), ("b", "7", 10), ("c", "7", 10), ("d", "", 1), ("e", "7", -1)], "item_id string, doc_id string, start_ms long").write.parquet(
        str(tmp_path / "items.parquet")
    )
    got = {tuple(r) for r in units.QUERIES["asof_section"](spark, str(tmp_path)).collect()}
    assert got == {(7, 5, "a"), (7, 10, "c"), (7, 11, "c"), (7, 99, "c")}

"""Disk tests of the findings in FINDINGS_r02.md: what a query shuffles and writes on the way."""

import random
from pathlib import Path

import pytest

from gleanery.plans import catalog, retrieval


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """4,000 documents of 60 of 3,000 words, one question in a hundred, and 400 vectors."""
    rnd, at = random.Random(11), tmp_path_factory.mktemp("tables")
    words = [f"word{i}" for i in range(3000)]
    docs = [(retrieval.DOC_BASE + i, " ".join(rnd.choices(words, k=60)), " ".join(rnd.choices(words, k=3)) if i % 100 == 0 else None) for i in range(4000)]
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(8)], i % 5) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, title string").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def _size(path) -> int:
    return sum(p.stat().st_size for p in Path(path).rglob("*") if p.is_file())


def _on_disk(spark) -> int:
    """Bytes shuffled and written to the checkpoint folder so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    folder = sc.getCheckpointDir()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite() + (_size(folder.get().removeprefix("file:")) if folder.isDefined() else 0)


#: Queries that failed by disk, or by time, at 1 GB.
SPARING = """
run_verdict
hybrid_search_rrf
popularity
recall_mrr_judged
facet_means
doc_qrels
pool_union
question_overlap
decided_split
results_to_moments
recall_ceiling
kind_mix
reachability
""".split()


@pytest.mark.parametrize("name", SPARING)
def test_query_takes_less_disk_than_its_input(spark, tables, name):
    before = _on_disk(spark)
    assert catalog.queries()[name](spark, str(tables)).collect()
    took = _on_disk(spark) - before
    assert took < 0.3 * _size(tables)  # the postings of every word were shuffled

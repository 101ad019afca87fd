"""Whole-job tests of the findings in FINDINGS_r02.md on training-data queries."""

import os

import pytest

from gleanery.llm import byte_bpe
from gleanery.llm.token_queries import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file here")
def test_constants_of_the_encoder_stand_in_no_plan_and_no_row(spark):
    docs = spark.createDataFrame([(1, "two words, two"), (2, None)], "doc_id long, text string")
    ids = byte_bpe.encode_texts(docs, RANKS)
    for df in (ids, byte_bpe.decode_ids(ids, RANKS)):
        run = df._jdf.queryExecution()
        assert len(run.toString()) < 100_000  # was the whole vocabulary, several times
        own = [x for x in run.optimizedPlan().toString().split("\n") if "Project" in x and "_held" in x]
        assert not own  # no projection puts the constants into rows
    assert df.orderBy("doc_id").collect() == [(1, "two words, two"), (2, "")]

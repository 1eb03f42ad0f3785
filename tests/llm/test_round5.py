"""Tests of the findings of the fifth round."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from labelwise.llm import common, ctw, ctw_sharded, langid, token_store
from labelwise.llm.queries import TOKENIZER
from tests.llm.test_llm_operators import brute_ctw


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_no_context_is_left_out_of_a_large_tree(spark, depth, monkeypatch):
    """with room for few contexts the scores stay those of the whole tree."""
    monkeypatch.setattr(ctw_sharded, "CHUNK_BYTES", 8)
    monkeypatch.setattr(ctw_sharded, "MEETING_BYTES", 12)
    texts = ["abab abba", "abba baab", "ab", "zq abba", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(docs, lambda i: i < 3, depth=depth, contexts=4).collect()}
    coded = [t.encode() + b"\n" for t in texts]
    cost = brute_ctw(coded[:3], depth)
    for k, t in enumerate(coded):
        assert got[k].score == pytest.approx(-cost(t) * np.log10(2), rel=1e-4)
    held = {r.doc_id: r for r in ctw.score(docs, lambda i: i < 3, depth=depth, contexts=100_000).collect()}
    for k in range(3):
        assert got[k].score == pytest.approx(held[k].score, rel=1e-4)
    assert all(got[k][c] == held[k][c] for k in got for c in ("n_tokens", "n_known", "train_tokens"))


def test_a_worker_drops_its_encoder_when_another_stage_begins():
    """pipeline: workers held the encoder of the token stage through the language stage of the next run."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two"]})
    encode = token_store._encode_with(TOKENIZER, b"\0" * 4)
    assert [b.num_rows for b in encode(iter([batch]))] == [1]
    encoder = common.kept(("encoder", TOKENIZER), lambda: None)
    assert encoder is not None and len(common._kept) == 1
    assert [len(x) for x in langid._predicting(["en"], None)(iter([pd.Series(["one two"])]))] == [1]
    assert not common._kept

"""Findings of the third review on the training-data operators."""

import pytest
from pyspark.sql import functions as F

from labelwise.llm import quality, simhash


def test_quality_learns_from_all_trusted_texts_but_the_held_out_quarter(spark, monkeypatch):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"))
    counts, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda texts: counts.append(texts.count()) or train(texts))
    assert quality.judged(docs, docs.select("doc_id")).count() == 9000
    assert 0.7 * 9000 < counts[0] < 0.8 * 9000


@pytest.mark.parametrize("learned", [0, 60])
def test_joined_scores_equal_held_ones(spark, sf, learned):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "  \x0b "), (-4, "the The THE"), (-4, "the The THE")], docs.schema)
    rows = docs.unionByName(odd)
    model = quality.train(docs.where(F.col("doc_id") < learned).select("text"))
    held, joined = (
        sorted((r.doc_id, r.n_tokens, r.log10_prob) for r in quality.scored(rows, model, most).collect()) for most in (quality.HELD_BYTES, 0)
    )
    assert len(held) == len(joined) == rows.count()
    for a, b in zip(held, joined):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_shingle_counts_order_the_prefixes_but_change_no_group(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        own = [f"x{k}", *words[k % 7 :], f"y{k % 5}"]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, f"z{k}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for counted, told in ((20_000, 100_000), (3, 100_000), (20_000, 0)):
        monkeypatch.setattr(simhash, "COUNTED", counted)
        monkeypatch.setattr(simhash, "COMMON_SHINGLES", told)
        found.append(sorted(map(tuple, simhash.similar_groups(docs, seeds=(1,)).collect())))
    assert found[0] == found[1] == found[2]
    sets = {i: simhash.shingle_set(t, 5) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if simhash.similarity(sets[a], sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in root):
            break
    assert dict(found[0]) == root

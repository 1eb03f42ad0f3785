"""Findings of the third review on spans and texts."""

import random
import re

from pyspark.sql import functions as F

from labelwise.functions import spans as S
from labelwise.operators import spanjoin as J


def test_spans_are_found_in_blocks(spark):
    rnd = random.Random(4)
    texts = [None, "", " ", *(" ".join("ab☃" * rnd.randint(1, 3) for _ in range(n)) + tail for n in (1, 126, 127, 128, 129, 256, 1000) for tail in ("", " "))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.s for r in docs.select("id", S.match_spans(F.col("text"), "[^ ]+").alias("s")).collect()}
    assert got[0] is None
    for k, text in enumerate(texts[1:], 1):
        assert [(x.st, x.en, x.txt) for x in got[k]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[^ ]+", text)]
    blocks = docs.select(S.match_spans(F.col("text"), "[^ ]+"))._jdf.queryExecution().toString()
    assert "flatten" in blocks


def test_documents_of_few_levels_need_no_levels_of_their_own(spark):
    left = spark.range(500).selectExpr("id % 7 AS doc_id", "int(id * 3) AS st", "int(id * 3 + 9) AS en", "id AS sid")
    right = spark.range(500).selectExpr("id % 5 AS doc_id", "int(id * 3 + 1) AS st", "int(id * 3 + 12) AS en")
    a, _ = J._indexed(left, right, 0)
    assert "Join" not in a._jdf.queryExecution().optimizedPlan().toString()
    spans = [(i % 7, i * 3, i * 3 + 9, i) for i in range(500)]
    others = [(i % 5, i * 3 + 1, i * 3 + 12) for i in range(500)]
    want = {i: min((s, e) for d2, s, e in others if d2 == d and 0 <= s - en <= 24) for d, _, en, i in spans if any(d2 == d and 0 <= s - en <= 24 for d2, s, e in others)}
    got = {r.sid: tuple(r.run) for r in J.following_span(left, right, 24, "sid").collect()}
    assert got == want


def test_long_texts_are_compared_by_whole_numbers(spark):
    from labelwise.functions import text as X

    rnd = random.Random(5)
    pairs = [("", ""), ("a", ""), (None, "a"), ("a", None), ("☃𝒳b", "𝒳☃b")]
    pairs += [("".join(rnd.choices("abc☃", k=n)), "".join(rnd.choices("abd𝒳", k=m))) for n in (1, 61, 62, 63, 200) for m in (1, 62, 130)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string")
    got = df.select("id", X.lcs_length(F.col("a"), F.col("b")).alias("n"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.n for r in got.collect()} == {i: None if a is None or b is None else lcs(a, b) for i, (a, b) in enumerate(pairs)}


def test_evidence_files_are_written_by_several_tasks(spark, sf, tmp_path, monkeypatch):
    from labelwise.plans import storage

    monkeypatch.setattr(storage, "shared_dir", lambda spark, name: str(tmp_path / name))
    assert storage.evidence_files(spark, sf).count() > 0
    for part in (0, 1):
        folder = tmp_path / "evidence" / f"scan{part}" / "images"
        assert len({p.name.split("-")[1] for p in folder.glob("part-*")}) > 1


def test_a_report_folds_its_results_and_totals_together(spark, sf):
    from labelwise.plans import workflow

    plan = workflow.report_payload(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate [scan_id" in line]
    assert len(groups) == 1

"""Tests of the findings of the fifth round."""

import glob
import os

from labelwise.operators import reports as R
from labelwise.operators import review as V
from labelwise.plans import workflow
from labelwise.plans.bindings import bound
from labelwise.sources import sinks as K


def test_a_report_takes_few_bytes_a_verdict(spark, sf, tmp_path):
    """the same rows come back, in less than a third of the bytes."""
    scans, users = bound(spark, sf, "scans"), bound(spark, sf, "users")
    rows = R.report_rows(V.with_inspector(scans, users), workflow.overlaid(spark, sf)).cache()
    path = str(tmp_path / "report")
    K.write_report_csv(rows, path)
    written = sum(map(os.path.getsize, glob.glob(f"{path}/part-*")))
    assert written < 100 * rows.count()
    text = rows.selectExpr(*[f"nullif(CAST({c} AS STRING), '') AS {c}" for c in rows.columns])
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == rows.columns and back.exceptAll(text).isEmpty() and text.exceptAll(back).isEmpty()

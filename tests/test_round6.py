"""Tests of the findings of the sixth round."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelwise.functions import parse as P
from labelwise.operators import ordering as O
from labelwise.operators import spanjoin as J
from labelwise.operators import sweep as W
from labelwise.operators.extract import Telling
from labelwise.plans import extraction
from labelwise.sources import sinks as K
from labelwise.streaming import frames as T


@pytest.mark.parametrize("block", [10, 10_000])
def test_blocks_are_dealt_whole_behind_a_join(spark, block):
    """a deal by the columns of a shuffled join is left out, and that join may become one that deals nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 400, 1, 4).selectExpr("cast(id div 40 as string) cam", "id % 40 + 1 rn", "id % 40 * 60 us")
        thin = O.thin(rows, ["cam"], "us", 600, block_rows=block)
        plan = thin._jdf.queryExecution().executedPlan().toString()
        got = {(r.cam, r.rn) for r in thin.where("accepted").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("MapInArrow"):]
    assert "REPARTITION_BY_COL" in below[: below.index("ExistingRDD")]
    assert got == {(str(cam), rn) for cam in range(10) for rn in (1, 11, 21, 31)}


def test_a_parser_tells_the_printed_text(spark):
    """the repair of toll-free numbers takes the 2 of 218007, which the message names."""
    texts = ["cannot read group 218007", "cannot read group 18007", "Tea"]
    log = spark.createDataFrame(
        [("detection", f"i{k}", 1, k, "product_name", t) for k, t in enumerate(texts)],
        "record_type string, image_path string, detection_index int, ln long, canonical_class string, ocr_text string")
    telling = Telling(lambda clean, wide: P.product_name(clean), lambda text, wide: F.when(text.startswith("cannot"), text))
    got = {r.image: r.parser_error for r in W.digest(log, dt.date(2024, 1, 1), {"product_name": telling}).collect()}
    assert got == {"i0": texts[0], "i1": texts[1], "i2": None}


def test_span_joins_carry_places_and_keys_only(spark, sf, monkeypatch):
    """F16, F17: neither the real id nor a span's text nor a hash beside a number travels."""
    joined = []
    keep = J._indexed
    monkeypatch.setattr(J, "_indexed", lambda *a: joined.append(keep(*a)) or joined[-1])
    extraction.nearest_label(spark, sf), extraction.following_span(spark, sf)
    (dates, labels), (anchors, runs) = ([set(d.columns) for d in pair] for pair in joined)
    assert dates == {"doc_id", "st", "en", "_lo", "_at"} and labels == {"doc_id", "r_kind", "r_st", "r_en", "_rlo", "_at"}
    assert anchors == {"doc_id", "_st", "st", "en", "_lo", "_at"} and runs == {"doc_id", "r_st", "r_en", "_rlo", "_at"}
    assert all(dict(d.dtypes)["doc_id"] == "bigint" for pair in joined for d in pair)


def test_a_report_takes_few_bytes_a_scan(spark, sf, tmp_path):
    """the same reports come back, in less than a quarter of the bytes."""
    doc = spark.range(2000).select(F.col("id").alias("scan_id"), F.expr("transform(sequence(1, 7), k -> named_struct('rule_class', 'net_quantity', 'reason', concat('as declared ', k)))").alias("results"))
    path = str(tmp_path / "report")
    K.write_report_json(doc, path)
    assert sum(p.stat().st_size for p in (tmp_path / "report").glob("part-*")) < doc.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] / 4
    back = spark.read.schema(doc.schema).json(path)
    assert back.exceptAll(doc).isEmpty() and doc.exceptAll(back).isEmpty()


def test_late_frames_call_python_by_bucket(spark, tmp_path):
    """cameras share calls of the state operator, and each keeps its own gate and its own count of late frames."""
    frames = spark.range(600).select(
        F.concat(F.lit("c"), F.col("id") % 20).alias("cam"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").alias("seq"),
        F.lit(200.0).alias("sharpness"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array(F.lit("a")).alias("classes"),
        F.lit(1).alias("n_det"), F.lit(None).cast("string").alias("det_error"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (frames.where("seq < 560 and seq % 50 > 39 or seq between 540 and 559"), frames.where("seq < 540 and seq % 50 <= 39"), frames.where("seq >= 560").withColumn("ts", F.col("ts") + F.expr("interval 900 days"))):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = T.ordered_status(T.read_stream(spark, path, T.FRAMES, 1), "1 day", 1.0, buckets=3)
    assert "bucket" in stream._jdf.queryExecution().analyzed().toString()
    T.stateful(spark)
    T.append_once(stream, out, str(tmp_path / "mark")).awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out).collect()
    late = {r.seq: r for r in got if r.late}
    mark = 559 - 24  # the first file's newest frame less the watermark's delay
    assert set(late) == {s for s in range(540) if s % 50 <= 39 and s <= mark}
    for cam in range(20):
        assert [late[s].late_frames for s in sorted(late) if s % 20 == cam] == list(range(1, 1 + sum(s % 20 == cam for s in late)))
        own = [r for r in sorted(got, key=lambda r: r.seq) if not r.late and r.cam == f"c{cam}"]
        assert [r.frames for r in own] == list(range(1, len(own) + 1)) and all(r.detected for r in own)

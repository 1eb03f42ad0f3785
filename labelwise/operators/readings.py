"""Choosing and joining readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import text as X
from labelwise.operators.ordering import assemble_text

LINE = "struct<text:string,conf:double,x1:int,y1:int,x2:int,y2:int>"


def reading_order(lines: Column) -> Column:
    """Lines of one crop the way a person reads them: bands down, then left to right.

    A line joins the first band whose opening line is vertically close enough.
    """
    def mid(l: Column) -> Column:
        return (l["y1"] + l["y2"]) / 2.0

    def height(l: Column) -> Column:
        return l["y2"] - l["y1"]

    keyed = F.transform(
        lines,
        lambda l, i: F.struct(mid(l).alias("yc"), l["x1"].alias("x"), i.alias("i"), l.alias("l")),
    )
    ordered = F.array_sort(keyed)
    start = F.struct(
        F.expr("cast(array() as array<struct<yc:double,h:int>>)").alias("bands"),
        F.expr(
            f"cast(array() as array<struct<top:double,x:int,i:int,l:{LINE}>>)"
        ).alias("rows"),
    )

    def step(acc: Column, item: Column) -> Column:
        h = height(item["l"])
        fits = F.filter(
            acc["bands"],
            lambda b: F.abs(b["yc"] - item["yc"])
            <= F.greatest(F.lit(4.0), 0.6 * F.greatest(b["h"], h)),
        )
        top = F.coalesce(F.get(fits, F.lit(0))["yc"], item["yc"])
        row = F.struct(
            top.alias("top"), item["x"].alias("x"), item["i"].alias("i"), item["l"].alias("l")
        )
        bands = F.when(
            F.size(fits) == 0,
            F.array_append(acc["bands"], F.struct(item["yc"].alias("yc"), h.alias("h"))),
        ).otherwise(acc["bands"])
        return F.struct(bands.alias("bands"), F.array_append(acc["rows"], row).alias("rows"))

    rows = F.aggregate(ordered, start, step, lambda acc: acc["rows"])
    return F.transform(F.array_sort(rows), lambda r: r["l"])


def result_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """OCR lines to one result per crop: text, weighted confidence, line count."""
    tidy = F.trim(F.col("text"))
    kept = df.where(tidy != "")
    line = F.struct(tidy.alias("text"), "conf", "x1", "y1", "x2", "y2").cast(LINE)
    weight = F.length(tidy)
    grouped = kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(line), _by_position).alias("_lines"),
        (F.sum(weight * F.col("conf")) / F.sum(weight)).alias("conf"),
        F.count("*").alias("lines"),
    )
    return grouped.withColumn(
        "text", F.array_join(F.transform(reading_order(F.col("_lines")), lambda l: l["text"]), " ")
    ).drop("_lines")


def _by_position(a: Column, b: Column) -> Column:
    def sign(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(rest)

    same = F.lit(0)
    for f in ["text", "y2", "x2", "x1"]:
        same = sign(a[f], b[f], same)
    return sign(a["y1"] + a["y2"], b["y1"] + b["y2"], same)


def words_to_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """Words to lines: joined text, length-weighted confidence / 100, hull box."""
    text = F.trim(F.col("text"))
    conf = F.col("conf").try_cast("double")
    conf = F.when(conf.isNull() | (conf < 0), 0.0).otherwise(F.least(F.lit(1.0), conf / 100.0))
    weight = F.length(text)
    return (
        df.where(text != "")
        .groupBy(*keys)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.col("word"), text.alias("t")))),
                    lambda w: w["t"],
                ),
                " ",
            ).alias("text"),
            (F.sum(weight * conf) / F.sum(weight)).alias("conf"),
            F.min("left").alias("x1"),
            F.min("top").alias("y1"),
            F.max(F.col("left") + F.col("width")).alias("x2"),
            F.max(F.col("top") + F.col("height")).alias("y2"),
        )
    )


def candidate_score(text: Column, conf: Column, signal: Column) -> Column:
    filled = F.least(F.lit(1.0), F.length(text) / K.YIELD_CHARS)
    score = (
        K.W_CONFIDENCE * F.coalesce(conf, F.lit(0.0))
        + K.W_PARSE * signal
        + K.W_YIELD * filled
    )
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(score)


def max_variants(df: DataFrame, k: int | None) -> DataFrame:
    return df if k is None else df.where(F.col("variant_ord") < k)


def early_stop(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop variants tried after the first compliant, confident one.

    The stop is an aggregate (it folds before the shuffle) joined back, so a hot
    key never becomes one window task.
    """
    stop = F.col("compliant") & (F.coalesce("conf", F.lit(0.0)) >= K.STOP_CONFIDENCE)
    stops = df.where(stop).groupBy(*keys).agg(F.min("variant_ord").alias("_stop"))
    return (
        df.join(stops, keys, "left")
        .where(F.col("_stop").isNull() | (F.col("variant_ord") <= F.col("_stop")))
        .drop("_stop")
    )


def best_candidate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Highest score per crop, earliest on a tie; nothing when no score is above 0."""
    best = F.max_by(
        F.struct("variant", "text", "conf", "compliant", "score"),
        F.struct("score", -F.col("variant_ord")),
    )
    picked = df.groupBy(*keys).agg(best.alias("b"), F.sum("seconds").alias("seconds"))
    won = F.col("b.score") > 0

    def field(name: str, default=None) -> Column:
        return F.when(won, F.col(f"b.{name}")).otherwise(F.lit(default)).alias(name)

    return picked.select(
        *keys, field("variant"), field("text", ""), field("conf"),
        field("compliant", False), field("score", 0.0), "seconds",
    )


def distinct_readings(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """First spelling of every distinct reading per group, blanks dropped.

    Readings that differ only in case, spacing or punctuation count as one;
    readings with no letters or digits never collapse.
    """
    tidy = df.withColumn("_t", F.trim(F.col(text))).where("_t <> ''")
    rank = F.struct(*[F.col(c) for c in order])
    fp = X.fingerprint(F.col("_t"))
    own = F.when(fp == "", F.to_json(rank)).otherwise(F.lit(""))
    first = F.min_by(F.struct(F.col("_t").alias(text), rank.alias("_o")), rank)
    return (
        tidy.groupBy(*keys, fp.alias("_fp"), own.alias("_own"))
        .agg(first.alias("_f"))
        .select(*keys, F.col(f"_f.{text}"), *[F.col(f"_f._o.{c}") for c in order])
    )


def join_readings(df: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Distinct readings of each group joined in order: ``keys, text``."""
    return assemble_text(distinct_readings(df, keys, order, text), keys, order, text, text)


def pack_text(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Whole-pack text per scan or image from its class texts."""
    return assemble_text(df.where(F.col(text) != ""), keys, order, text, "pack_text")


def scan_dietary(df: DataFrame) -> DataFrame:
    """First decisive dietary status of each scan; uncertain marks are not promoted."""
    decisive = F.col("dietary_status").isin("VEG", "NON_VEG")
    order = F.when(decisive, F.struct("image_ord", "det_idx"))
    return df.groupBy("scan_id").agg(
        F.coalesce(F.min_by("dietary_status", order), F.lit("NOT_DETECTED")).alias("dietary_status")
    )


def scan_stats(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Detections, classes found and time split per scan.

    ``images`` is ``scan_id, image_ord, elapsed``; detection time is what OCR leaves.
    """
    per_image = detections.groupBy("scan_id", "image_ord").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("ocr"),
    )
    times = (
        images.join(per_image, ["scan_id", "image_ord"], "left")
        .groupBy("scan_id")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("detections"),
            F.coalesce(F.sum("ocr"), F.lit(0.0)).alias("ocr_seconds"),
            F.sum(
                F.greatest(F.lit(0.0), F.col("elapsed") - F.coalesce("ocr", F.lit(0.0)))
            ).alias("detect_seconds"),
        )
    )
    found = detections.groupBy("scan_id").agg(
        F.array_join(F.array_sort(F.collect_set("canonical")), ",").alias("classes_found")
    )
    return times.join(found, "scan_id", "left").withColumn(
        "classes_found", F.coalesce("classes_found", F.lit(""))
    )


def flatten_candidates(detections: DataFrame) -> DataFrame:
    """One diagnostics row per rejected or chosen candidate."""
    return detections.select("image", "det_idx", "canonical", F.inline("candidates"))

"""Run-log analytics: passes, resume, digest, throughput, failures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import predicates as Q
from labelwise.operators.clean import clean_corpus, once
from labelwise.operators.extract import Parser, dispatch, isolated, told
from labelwise.operators.ordering import ranked
from labelwise.operators.readings import join_readings
from labelwise.session import written


def newest_pass(log: DataFrame) -> DataFrame:
    """Detections of the latest non-empty pass over each image.

    A pass ends at an ``image_done`` marker or where ``detection_index`` restarts
    at 0, so it starts at the later of the last restart and the last marker that
    still has a detection behind it.  Two folding aggregates find that line per
    image; the log itself is joined once and never windowed.
    """
    known = log.where("image_path is not null and image_path <> ''")
    det = known.where("record_type = 'detection'")
    ends = det.groupBy("image_path").agg(
        F.max("ln").alias("_last"),
        F.max(F.when(F.col("detection_index") == 0, F.col("ln"))).alias("_restart"),
    )
    marks = (
        known.where("record_type = 'image_done'")
        .select("image_path", "ln")
        .join(ends.select("image_path", "_last"), "image_path")
        .where("ln < _last")
        .groupBy("image_path")
        .agg(F.max("ln").alias("_mark"))
    )
    start = ends.join(marks, "image_path", "left").select(
        "image_path",
        F.greatest(F.coalesce("_restart", F.lit(-1)), F.coalesce("_mark", F.lit(-1))).alias("_from"),
    )
    return det.join(start, "image_path").where("ln >= _from").drop("_from")


def completed_images(log: DataFrame) -> DataFrame:
    """Images a resumed run may skip.

    Marked images, plus every unmarked record's image but the one first seen
    last, which may have been cut off.
    """
    known = log.where("image_path is not null and image_path <> ''")
    marked = known.where("record_type = 'image_done'").select("image_path")
    seen = known.where("record_type <> 'image_done'").groupBy("image_path").agg(
        F.min("ln").alias("_ln")
    )
    tail = seen.agg(F.max("_ln").alias("_tail"))
    inferred = seen.join(F.broadcast(tail), F.col("_ln") < F.col("_tail")).select("image_path")
    return marked.union(inferred).distinct()


def resume(images: DataFrame, log: DataFrame) -> DataFrame:
    """Images still to process."""
    return images.join(completed_images(log), "image_path", "left_anti")


def zero_detection_images(images: DataFrame, log: DataFrame) -> DataFrame:
    found = log.where("record_type = 'detection'").select("image_path")
    return images.join(found, "image_path", "left_anti")


def failures(log: DataFrame, threshold: float | None = None) -> DataFrame:
    """Readings worth a look, with reasons."""
    cut = Q.low_conf_threshold(threshold, F.col("ocr_engine"))
    reasons = Q.failure_reasons(
        F.col("ocr_status"), F.col("ocr_text"), F.col("ocr_confidence"), F.col("ocr_error"), cut
    )
    kept = log.where(F.col("record_type").isin("detection", "full_image_ocr"))
    return kept.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def failures_by_image(log: DataFrame, threshold: float | None = None) -> DataFrame:
    """Image to its failing readings, one row per image."""
    item = F.struct("detection_index", "ocr_source", "ocr_text", "ocr_confidence", "ocr_error", "reasons")
    return (
        failures(log, threshold)
        .groupBy("image_path")
        .agg(F.array_sort(F.collect_list(item)).alias("failures"))
    )


def sample_n(images: DataFrame, limit: int | None, path: str = "image_path") -> DataFrame:
    """The first ``limit`` images by lower-cased path, all of them without a limit."""
    ordered = images.orderBy(F.lower(path), path)
    return ordered if limit is None else ordered.limit(limit)


# --- digest -----------------------------------------------------------------


def digest(log: DataFrame, as_of: dt.date, own_parsers: dict[str, Parser] | None = None) -> DataFrame:
    """One row per image and class of the newest pass.

    Boxes are counted, readings joined without repeats, and the class's parser judges the joined text; the care class
    is judged again with the whole pack.  ``own_parsers`` replace or add parsers of classes.  One that raises, or tells
    that it cannot read a text (``Telling``), breaks its own group only: the group has no result and the message as ``parser_error``; where the second reading of
    the care class raises, the verdict of the first one stays.
    """
    base = newest_pass(log).where("canonical_class is not null and canonical_class <> ''").select(
        F.col("image_path").alias("image"), F.col("canonical_class").alias("class"), "ln",
        F.trim(F.coalesce("ocr_text", F.lit(""))).alias("text"),
    )
    counts = base.groupBy("image", "class").agg(
        F.count("*").alias("box_count"), F.min("ln").alias("ord")
    )
    joined = join_readings(base, ["image", "class"], ["ln"], "text")
    # packs, cleanings and verdicts all read these rows, so they are written once
    rows = written(
        counts.join(joined, ["image", "class"], "left")
        .withColumn("combined_text", F.coalesce("text", F.lit("")))
        .drop("text")
    )
    care = F.col("class") == "consumer_care_fssai"
    # classes per image are few, so a pack is a small ordered list
    packs = rows.where("combined_text <> ''").groupBy("image").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ord", "class", "combined_text"))),
                lambda r: r["combined_text"],
            ),
            " ",
        ).alias("pack")
    )
    plugged = tuple((own_parsers or {}).items())
    filled = F.col("combined_text") != ""

    def judged(texts: DataFrame, name: str, clean: str, wide: str | None, only: tuple | None) -> DataFrame:
        """``texts`` with the verdict ``name`` on ``clean`` and ``<name>_error``, told or raised."""
        said = written(texts.withColumn("_says", F.when(filled, told("class", "combined_text", wide, plugged))))
        verdict = F.when(filled & F.col("_says").isNull(), dispatch(as_of, "class", clean, wide, only, plugged))
        out = isolated(said, {name: verdict})
        return out.withColumn(f"{name}_error", F.coalesce("_says", f"{name}_error")).drop("_says")

    keys = ["class", "combined_text"]
    rows = once(rows, keys, lambda texts: judged(clean_corpus(texts, keys, "combined_text"), "own", "clean", None, None))
    # only the care class asks for the pack
    wide = rows.where(care).join(packs, "image", "left").withColumn("_wide", F.concat_ws(" ", "clean", "pack")).drop("pack")
    wide = clean_corpus(written(wide), ["image", "class"], "_wide", "wide").drop("_wide")
    wide = judged(wide, "packwide", "clean", "wide", ("consumer_care_fssai",)).drop("wide")
    rows = rows.where(~care).unionByName(wide, allowMissingColumns=True)
    error = F.coalesce("own_error", "packwide_error")
    parsed = F.when(error.isNull(), F.when(care, F.col("packwide")).otherwise(F.col("own")))
    first = F.col("own.is_compliant")
    return rows.select(
        "image", "class", "box_count", "combined_text", "ord", parsed.alias("parsed"), error.alias("parser_error"),
        F.when(F.col("own_error").isNotNull(), None)
        .when(care & F.col("packwide_error").isNull(), F.col("packwide.is_compliant"))
        .otherwise(first)
        .alias("is_compliant"),
        first.alias("strict_is_compliant"),
    )


def digest_class_counts(rows: DataFrame) -> DataFrame:
    good = F.coalesce(F.col("is_compliant"), F.lit(False))
    return rows.groupBy("class").agg(
        F.count("*").alias("groups"),
        F.count_if(good).alias("compliant"),
        F.count_if(~good).alias("need_attention"),
    )


def digest_csv_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "image", "class", "box_count",
        Q.csv_verdict(F.col("is_compliant")).alias("is_compliant"),
        Q.csv_verdict(F.col("strict_is_compliant")).alias("strict_is_compliant"),
        "combined_text",
        F.when(F.col("parser_error").isNotNull(), F.to_json(F.struct("parser_error")))
        .otherwise(F.coalesce(F.to_json("parsed"), F.lit("{}")))
        .alias("parsed_json"),
    )


def digest_sections(rows: DataFrame) -> DataFrame:
    """Report lines: class header with counts, then failing groups before passing ones."""
    mark = (
        F.when(F.col("is_compliant").isNull(), "n/a")
        .when(F.col("is_compliant"), "PASS")
        .otherwise("FAIL")
    )
    body = rows.select(
        "class", F.lit(1).alias("level"),
        F.coalesce(F.col("is_compliant"), F.lit(False)).alias("passed"), "image",
        F.concat(
            F.lit("### ["), mark, F.lit("] "), F.col("image"), F.lit("  ("),
            F.col("box_count").cast("string"), F.lit(" box(es))"),
        ).alias("line"),
    )
    has_parser = F.col("class").isin(K.REGION_CLASSES)
    head = digest_class_counts(rows).select(
        "class", F.lit(0).alias("level"), F.lit(False).alias("passed"), F.lit("").alias("image"),
        F.concat(
            F.lit("## "), "class", F.lit(" - "), F.col("groups").cast("string"), F.lit(" group(s)"),
            F.when(
                has_parser,
                F.concat(
                    F.lit(": "), F.col("compliant").cast("string"), F.lit(" parsed-compliant, "),
                    F.col("need_attention").cast("string"), F.lit(" need attention"),
                ),
            ).otherwise(" (no rule parser; text shown for reference)"),
        ).alias("line"),
    )
    return head.unionByName(body).orderBy("class", "level", "passed", "image")


# --- throughput -------------------------------------------------------------


def throughput_buckets(
    done: DataFrame, bucket_images: int = K.BUCKET_IMAGES, **sizes
) -> DataFrame:
    """Every ``bucket_images`` finished images in log order, with seconds per crop."""
    numbered = ranked(done, [], ["ln"], "_rn", **sizes)
    bucket = F.floor((F.col("_rn") - 1) / bucket_images)
    return (
        numbered.groupBy(bucket.alias("bucket"))
        .agg(
            F.count("*").alias("images"),
            F.sum("crops").alias("crops"),
            F.sum("seconds").alias("seconds"),
        )
        .withColumn("rate", F.when(F.col("crops") > 0, F.col("seconds") / F.col("crops")))
    )


def throughput_rates(buckets: DataFrame) -> DataFrame:
    """Opening, recent and overall seconds per crop in one row."""
    rated = F.when(F.col("rate").isNotNull(), F.col("bucket"))
    return buckets.agg(
        F.min_by("rate", rated).alias("opening"),
        F.max_by("rate", rated).alias("recent"),
        F.try_divide(F.sum("seconds"), F.sum("crops")).alias("overall"),
    )


def slowdown_alert(
    buckets: DataFrame, bucket_images: int = K.BUCKET_IMAGES, ratio: float = K.SLOWDOWN_RATIO
) -> DataFrame:
    """First complete later bucket at least ``ratio`` times slower than the opening one."""
    opening = throughput_rates(buckets).select("opening").where("opening > 0")
    slow = (
        buckets.where((F.col("images") >= bucket_images) & (F.col("bucket") > 0))
        .join(F.broadcast(opening), F.col("rate") >= F.col("opening") * ratio)
    )
    hit = slow.groupBy("opening").agg(
        F.min("bucket").alias("bucket"), F.min_by("rate", "bucket").alias("rate")
    )
    return hit.withColumn("times", F.col("rate") / F.col("opening"))


def run_summary(
    images: DataFrame, log: DataFrame, threshold: float | None = None
) -> DataFrame:
    """One record of a run: counts of images, readings, failures and rates."""
    one = F.lit(True)  # every side below is a single row
    total = images.agg(F.count("*").alias("image_count"))
    done = log.where("record_type = 'image_done'")
    counts = log.agg(
        F.count_if(F.col("record_type") == "detection").alias("detection_record_count"),
        F.count_if(F.col("record_type") == "image_error").alias("image_error_count"),
        F.count_if(F.col("record_type") == "image_done").alias("images_processed"),
    )
    failed = failures(log, threshold).agg(F.count("*").alias("ocr_failure_record_count"))
    empty = zero_detection_images(images, log).agg(F.count("*").alias("zero_detection_image_count"))
    rates = throughput_rates(throughput_buckets(done)).select(
        F.round("opening", 4).alias("seconds_per_crop_opening"),
        F.round("overall", 4).alias("seconds_per_crop"),
    )
    out = total
    for side in (counts, failed, empty, rates):
        out = out.join(F.broadcast(side), one)
    return out

"""Annotation files as tables: audit, repair, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import geometry as G

FILE = ["split", "file"]


def with_boxes(rows: DataFrame) -> DataFrame:
    """Add kind, authored and loader boxes, overlap and damage to label rows.

    Whether a file reads as segments is a folding aggregate joined back, so a
    file holding a third of all rows is not one window task.
    """
    flags = rows.groupBy(*FILE).agg((F.max(F.size("vals")) + 1 > 6).alias("segment_file"))
    j = rows.join(flags, FILE)
    vals = F.col("vals")
    out = (
        j.withColumn("kind", G.row_kind(vals))
        .withColumn("authored", G.row_to_box(vals))
        .withColumn("trained", G.loader_box(vals, F.col("segment_file")))
    )
    overlap = F.when(F.col("trained").isNull(), 0.0).otherwise(
        G.iou(F.col("authored"), F.col("trained"))
    )
    area = F.greatest(
        F.col("authored.w") * F.col("authored.h"),
        F.coalesce(F.col("trained.w") * F.col("trained.h"), F.lit(0.0)),
    )
    known = F.col("authored").isNotNull()
    return (
        out.withColumn("iou", F.when(known, overlap))
        .withColumn("corrupted", known & (F.col("iou") <= K.IOU_MATCH))
        .withColumn("damage", F.when(known, (1.0 - F.col("iou")) * area))
        .withColumn("tiny", F.coalesce(G.min_side(F.col("authored")) < K.TINY_SIDE, F.lit(False)))
    )


def label_audit(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Counters per split and in total; ``files`` drives so empty files count.

    Rows fold to one record per file before the rollup.
    """
    is_box, is_poly = F.col("kind") == "bbox", F.col("kind") == "polygon"
    per_file = with_boxes(rows).groupBy(*FILE).agg(
        F.count("*").alias("rows"),
        F.count_if(is_box).alias("bbox_rows"),
        F.count_if(is_poly).alias("polygon_rows"),
        F.count_if(F.col("corrupted")).alias("corrupted_rows"),
        F.count_if(F.col("tiny")).alias("tiny_rows"),
    )
    zero = F.lit(0)
    names = ["rows", "bbox_rows", "polygon_rows", "corrupted_rows", "tiny_rows"]
    j = files.join(per_file, FILE, "left").select(
        *FILE, *[F.coalesce(n, zero).alias(n) for n in names]
    )
    return (
        j.rollup("split")
        .agg(
            F.count("*").alias("files"),
            F.count_if(F.col("rows") == 0).alias("empty_files"),
            *[F.sum(n).alias(n) for n in names],
            F.sum(F.col("rows") - F.col("bbox_rows") - F.col("polygon_rows")).alias("unknown_rows"),
            F.count_if((F.col("bbox_rows") > 0) & (F.col("polygon_rows") > 0)).alias("mixed_files"),
        )
        .withColumn("split", F.coalesce("split", F.lit("all")))
    )


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "class_id").agg(F.count("*").alias("n"))


def corruptions(rows: DataFrame) -> DataFrame:
    return with_boxes(rows).where("corrupted").select(
        *FILE, "line", "class_id",
        *[F.round(F.col(f"authored.{c}"), 6).alias(f"authored_{c}") for c in ("cx", "cy", "w", "h")],
        F.round("iou", 6).alias("iou"), F.round("damage", 6).alias("damage"),
    )


def worst_corruptions(rows: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` relocations by label area misplaced."""
    return corruptions(rows).orderBy(F.desc("damage"), *FILE, "line").limit(k)


def repair_rows(rows: DataFrame) -> DataFrame:
    """Canonical text of every row, or a drop; with change flags."""
    box = G.row_to_box(F.col("vals"))
    side = G.min_side(F.col("box"))
    kept = F.col("box").isNotNull() & (side >= K.MIN_SIDE)
    return (
        rows.withColumn("kind", G.row_kind(F.col("vals")))
        .withColumn("box", box)
        .withColumn("kept", F.coalesce(kept, F.lit(False)))
        .withColumn("fixed", F.when(F.col("kept"), G.format_row(F.col("class_id"), F.col("box"))))
        .withColumn("changed", ~F.col("kept") | (F.col("fixed") != F.trim("raw")))
    )


def repair_files(repaired: DataFrame) -> DataFrame:
    """Per-file before and after, the manifest's rows."""
    return repaired.groupBy(*FILE).agg(
        F.count("*").alias("rows_before"),
        F.count_if(F.col("kept")).alias("rows_after"),
        F.count_if(F.col("kept") & (F.col("kind") != "bbox")).alias("polygons_converted"),
        F.count_if(F.col("kept") & (F.col("kind") == "bbox")).alias("unchanged"),
        F.max("changed").alias("changed"),
    )


def repair_summary(repaired: DataFrame) -> DataFrame:
    """Scanned, rewritten, converted, unchanged and dropped per split."""
    return repair_files(repaired).groupBy("split").agg(
        F.count("*").alias("files_scanned"),
        F.count_if(F.col("changed")).alias("files_rewritten"),
        F.sum("polygons_converted").alias("rows_converted"),
        F.sum("unchanged").alias("rows_unchanged"),
        F.sum(F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"),
    )


def verify_rows(rows: DataFrame, n_classes: int) -> DataFrame:
    """Every problem of every row: ``split, file, line, problem``."""
    v = [F.get(F.col("vals"), F.lit(i)) for i in range(4)]
    cx, cy, w, h = v
    is_box = F.col("kind") == "bbox"
    outside = F.exists("vals", lambda x: (x < 0.0) | (x > 1.0))
    eps = 1e-6

    def crosses(c, s):
        return (c - s / 2 < -eps) | (c + s / 2 > 1 + eps)

    problems = F.array_compact(
        F.array(
            F.when(~is_box, "field_count"),
            F.when(is_box & (n_classes > 0) & ~F.col("class_id").between(0, n_classes - 1), "class_range"),
            F.when(is_box & outside, "coordinates"),
            F.when(is_box & (F.least(w, h) <= 0), "degenerate"),
            F.when(is_box & crosses(cx, w), "crosses_x"),
            F.when(is_box & crosses(cy, h), "crosses_y"),
            F.when(
                F.col("authored").isNotNull() & F.col("trained").isNotNull() & (F.col("iou") < K.IOU_MATCH),
                "relocated",
            ),
        )
    )
    return with_boxes(rows).select(*FILE, "line", F.explode(problems).alias("problem"))

"""Live frame gating over stored frames; the batch twins of the streams.

Every operator is keyed by camera and ordered by (ts, seq).  Cameras are cut into
rank blocks, so one camera with a third of all frames spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.operators.ordering import BLOCK_ROWS, carry_forward, ranked, rolling, thin

US = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ranked_frames(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return ranked(frames.withColumn("us", micros(F.col("ts"))), ["cam"], ["us", "seq"], "rn")


def detect_throttle(
    frames: DataFrame, interval_s: float = K.DETECT_INTERVAL_S, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Frames with ``accepted``: sent to the detector.

    At most one per interval, and none after a detector error on an accepted frame.
    """
    gated = thin(ranked_frames(frames, block_rows), ["cam"], "us", round(interval_s * US), "rn", block_rows)
    broke = (
        gated.where("accepted and det_error is not null")
        .groupBy("cam")
        .agg(F.min("rn").alias("_broke"), F.min_by("det_error", "rn").alias("_error"))
    )
    after = F.col("_broke").isNotNull() & (F.col("rn") > F.col("_broke"))
    return (
        gated.join(broke, "cam", "left")
        .withColumn("accepted", F.col("accepted") & ~after)
        .withColumn("sticky_error", F.when(F.col("rn") >= F.col("_broke"), F.col("_error")))
        .drop("_broke", "_error")
    )


def carry_detections(detected: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Frames between detections reuse the last ones; an error clears them."""
    none = F.expr("cast(array() as array<string>)")
    classes = F.when(F.col("det_error").isNotNull(), none).otherwise(
        F.array_sort(F.array_distinct("classes"))
    )
    seen = F.when(
        F.col("accepted"),
        F.struct(
            classes.alias("classes"),
            F.when(F.col("det_error").isNotNull(), 0).otherwise(F.col("n_det")).alias("n"),
        ),
    )
    out = carry_forward(detected, ["cam"], seen, "_det", "rn", block_rows)
    return (
        out.withColumn("live_classes", F.coalesce("_det.classes", none))
        .withColumn("live_n", F.coalesce("_det.n", F.lit(0)))
        .drop("_det")
    )


def frame_rate(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(n - 1) / span over the last 30 arrivals."""
    def make(w) -> dict[str, Column]:
        span = (F.col("us") - F.first("us").over(w)) / US
        n = F.count("*").over(w) - 1
        return {"fps": F.when(span > 0, n / span).otherwise(0.0)}

    return rolling(ranked_frames(frames, block_rows), ["cam"], K.RATE_FRAMES - 1, make, "rn", block_rows)


def sharpest_recent(ranked_df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sharpest of the last ten frames, earliest on a tie, as ``best_seq`` and ``best_sharpness``."""
    def make(w) -> dict[str, Column]:
        pick = F.max_by(F.struct("seq", "sharpness"), F.struct("sharpness", -F.col("rn"))).over(w)
        return {"_best": pick}

    out = rolling(ranked_df, ["cam"], K.RECENT_FRAMES - 1, make, "rn", block_rows)
    return (
        out.withColumn("best_seq", F.col("_best.seq"))
        .withColumn("best_sharpness", F.col("_best.sharpness"))
        .drop("_best")
    )


def auto_capture(
    frames: DataFrame,
    interval_s: float = K.DETECT_INTERVAL_S,
    cooldown_s: float = K.CAPTURE_COOLDOWN_S,
    floor: float = K.SHARPNESS_FLOOR,
    min_classes: int = K.MIN_CLASSES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Captures: a sharp, well-covered frame after the cooldown emits the sharpest recent one."""
    live = carry_detections(detect_throttle(frames, interval_s, block_rows), block_rows)
    recent = sharpest_recent(live.drop("accepted"), block_rows)
    able = recent.where(
        (F.col("sharpness") >= floor) & (F.size("live_classes") >= min_classes)
    )
    # eligible frames keep their order, so their own ranks drive the second thinning
    ranked_able = ranked(able.drop("rn"), ["cam"], ["us", "seq"], "rn")
    fired = thin(ranked_able, ["cam"], "us", round(cooldown_s * US), "rn", block_rows)
    return fired.where("accepted").select(
        "cam", "seq", "ts", "best_seq", "best_sharpness", F.size("live_classes").alias("n_classes")
    )


def capture_buffer(captures: DataFrame, keep: int = K.CAPTURE_KEEP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Newest ``keep`` captures per camera."""
    newest = ranked(
        captures.withColumn("_neg", -micros(F.col("ts"))).withColumn("_negseq", -F.col("seq")),
        ["cam"], ["_neg", "_negseq"], "_rn",
    )
    return newest.where(F.col("_rn") <= keep).drop("_rn", "_neg", "_negseq")


def frame_counters(detected: DataFrame, captures: DataFrame) -> DataFrame:
    """Frames, detector calls and captures per camera."""
    shots = captures.groupBy("cam").agg(F.count("*").alias("captures"))
    return (
        detected.groupBy("cam")
        .agg(F.count("*").alias("frames"), F.count_if(F.col("accepted")).alias("detect_calls"))
        .join(shots, "cam", "left")
        .withColumn("captures", F.coalesce("captures", F.lit(0)))
    )


def latest_only(batch: DataFrame) -> DataFrame:
    """Newest frame per camera of a backlog, with how many it dropped."""
    return batch.groupBy("cam").agg(
        F.max("seq").alias("seq"),
        F.max_by("sharpness", "seq").alias("sharpness"),
        (F.count("*") - 1).alias("dropped"),
    )


def frame_windows(frames: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time counts per camera; works on streams too."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        frames.groupBy("cam", w.alias("w"))
        .agg(F.count("*").alias("frames"), F.max("sharpness").alias("sharpest"))
        .select("cam", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "sharpest")
    )


def frame_sessions(frames: DataFrame, gap: str) -> DataFrame:
    """Runs of frames with no gap of ``gap`` or more; works on streams too."""
    return (
        frames.groupBy("cam", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("frames"))
        .select("cam", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")
    )

"""Reading-engine evaluation: grouped quality, winners, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.functions.geometry import character_error_rate


def with_truth(measurements: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach reference transcripts and character error rates."""
    t = truth.select("key", F.col("text").alias("truth"))
    return measurements.join(t, "key", "left").withColumn(
        "cer", character_error_rate(F.col("text"), F.col("truth"))
    )


def stats() -> list[Column]:
    """Aggregates of one group of measurements."""
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    n = F.count("*")

    def mean(c: Column) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    return [
        n.alias("crops"),
        F.round(F.count_if(filled) / n, 3).alias("read_rate"),
        F.round(mean(F.col("signal")), 3).alias("field_yield"),
        F.round(F.count_if(F.col("compliant")) / n, 3).alias("compliant_rate"),
        F.round(mean(F.when(filled, F.col("conf"))), 3).alias("mean_confidence"),
        F.round(mean(F.col("seconds")), 3).alias("mean_seconds"),
        F.round(F.sum("seconds"), 1).alias("total_seconds"),
        F.round(F.avg("cer"), 4).alias("mean_cer"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    ]


def benchmark_groupings(measurements: DataFrame) -> DataFrame:
    """The same statistics by backend, backend/variant and backend/class in one pass."""
    sets = [
        [F.col("backend")],
        [F.col("backend"), F.col("variant")],
        [F.col("backend"), F.col("class")],
    ]
    return measurements.groupingSets(sets, "backend", "variant", "class").agg(
        F.grouping_id().alias("_g"), *stats()
    ).withColumn(
        "grouping", F.when(F.col("_g") == 3, "backend").when(F.col("_g") == 1, "variant").otherwise("class")
    ).drop("_g")


def crop_winners(measurements: DataFrame) -> DataFrame:
    """Best measurement per crop by (signal, confidence), earliest on a tie."""
    best = F.max_by(
        F.struct("backend", "variant", "class"),
        F.struct("signal", F.coalesce("conf", F.lit(0.0)), -F.col("ord")),
    )
    return measurements.groupBy("key").agg(best.alias("w")).select("key", "w.*")


def variant_wins(measurements: DataFrame) -> DataFrame:
    return (
        crop_winners(measurements)
        .groupBy("backend", "variant")
        .agg(F.count("*").alias("wins"))
        .orderBy(F.desc("wins"), "backend", "variant")
    )


def variant_win_share(measurements: DataFrame) -> DataFrame:
    """Share of crops each variant wins within a class."""
    wins = crop_winners(measurements).groupBy("class", "variant").agg(F.count("*").alias("wins"))
    totals = wins.groupBy("class").agg(F.sum("wins").alias("crops"))
    return wins.join(totals, "class").withColumn("share", F.col("wins") / F.col("crops"))


def measurement_rows(measurements: DataFrame) -> DataFrame:
    """Measurements rounded for a flat file."""
    return measurements.select(
        "key", "class", "backend", "variant", "text", F.bround("conf", 4).alias("confidence"),
        "lines", F.bround("seconds", 3).alias("seconds"), F.bround("signal", 3).alias("parse_signal"),
        F.col("compliant").cast("int").alias("compliant"), F.bround("cer", 4).alias("cer"), "truth",
        "error",
    )

"""Mixing sources to target weights along a time-varying curriculum, with built-in functions only.

Each source's share of the words comes from its weight, filled like water below a cap.  Within a source,
documents follow each other in a fixed pseudo-random order, pass after pass, until the source's words are
taken.  A source's schedule is a piecewise linear density over training time 0 to 1; its integral says how
many of the source's words are due by a time, and the inverse of that gives every document its position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwise.llm import common

Schedule = Sequence[tuple[float, float]]

#: Weights by rank of the source, repeating, and the density of each rank over training time.
WEIGHTS = (5, 2, 1)
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
#: Rows of a source that one window task orders.
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """``(source, source_size, rank, target)`` from one row per source ``(source, source_size)``.

    Sources rank by code point, null last.  The targets are the level of a water-filling: ``weight * level``
    up to ``cap`` times the source's size, which is what resharing the excess by weight until none is above
    comes to.  One row per source passes through these windows, not one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    full = ranked.withColumn("most", F.col("source_size") * cap).withColumn("fill", F.col("most") / F.col("weight"))
    order = Window.orderBy("fill", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        full.withColumn("place", F.row_number().over(order))
        .withColumn("wanted", F.sum("source_size").over(Window.partitionBy()) * share)
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
    )
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(Window.partitionBy())
    level = F.coalesce(first["level"], F.max("fill").over(Window.partitionBy()))
    return levels.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * level)).select(
        "source", "source_size", "rank", "target"
    )


def _when_due(share: Column, schedule: Schedule) -> Column:
    """The time by which ``share`` (0 to 1) of the scheduled words is due."""
    areas = [(d0 + d1) / 2 * (t1 - t0) for (t0, d0), (t1, d1) in zip(schedule, schedule[1:])]
    total, done = sum(areas), 0.0
    due = F.lit(float(schedule[-1][0]))
    pieces = []
    for (t0, d0), (t1, d1), area in zip(schedule, schedule[1:], areas):
        rest = share * total - done
        slope = (d1 - d0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), d0 * d0 + 2 * slope * rest))
        pieces.append((done + area, F.when(rest <= 0, F.lit(t0)).otherwise(t0 + 2 * rest / (d0 + root))))
        done += area
    for until, piece in reversed(pieces):
        due = F.when(share * total <= until, piece).otherwise(due)
    return due


def _inverse(schedule: Schedule) -> Callable[[Column], Column]:
    return lambda share: _when_due(share, schedule)


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """One row per document, in order of position: doc_id, source, size, source_size, target, taken, positions.

    ``size`` counts words (null: 0); ``taken`` is how many of them the mix takes, repeats counted: whole
    passes over the source, and in the last pass the documents up to the word at which its target is met,
    so a source's sum is its target rounded and no document exceeds ``cap`` times its size.  ``positions``
    holds the training time (0 to 1) at which each reading of the document starts, empty if it is not taken.
    The order within a source comes from a hash of the id, so reruns agree; rows alike in id and size are
    interchangeable.  Null ids and sources are values like any other; an empty table gives no rows.
    """
    rows = common.keep_table(
        common.narrow(docs, id=id_col, text=text_col, source=source_col).select(
            "id",
            "source",
            common.word_count(F.col("text")).alias("size"),
            F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        ),
        "sizes",
    )
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.shiftright("key", 60 - bits))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = common.keep_table(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket_words")
    sums = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    sums = sums.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("name"), F.col("bucket").alias("at"), "ahead", "source_size", "rank", "target"
    )
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = placed.join(
        common.keep_table(sums, "bucket_starts"),
        F.col("source").eqNullSafe(F.col("name")) & (F.col("bucket") == F.col("at")),
    ).withColumn("start", F.col("ahead") + F.col("inside"))
    quota = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("quota") - F.col("passes") * F.col("source_size") - F.col("start")))
    taken = placed.withColumn("quota", quota).withColumn("passes", passes).withColumn("last", last).withColumn(
        "taken", F.col("passes") * F.col("size") + F.col("last")
    )
    readings = F.expr("CASE WHEN taken = 0 THEN 0 WHEN last > 0 THEN passes + 1 ELSE passes END").cast("int")
    starts = F.expr("transform(filter(sequence(0, 1 + int(passes)), p -> p < readings), p -> (p * source_size + start) / quota)")
    due = F.lit(None).cast("array<double>")
    for k, schedule in enumerate(schedules):
        due = F.when(
            F.col("rank") % len(schedules) == k, F.transform("starts", _inverse(schedule))
        ).otherwise(due)
    return (
        taken.withColumn("readings", readings)
        .withColumn("starts", starts)
        .withColumn("positions", due)
        .select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "positions")
        .orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix reads them, all columns, sorted by position: a row for each whole reading.

    A reading that the target cuts short counts if at least half of its words are taken.  Documents of which
    nothing is taken go.  Rows with the same id, source and size share one plan.
    """
    chosen = plan(docs, id_col, text_col, source_col, **options).where("taken > 0")
    chosen = chosen.withColumn("whole", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).where("whole > 0")
    chosen = common.keep_table(
        chosen.groupBy("doc_id", "source", "size").agg(F.min(F.expr("slice(positions, 1, whole)")).alias("when_")), "mix_plan"
    ).toDF("plan_id_", "plan_source_", "plan_size_", "when_")
    key = (
        docs[id_col].eqNullSafe(chosen["plan_id_"])
        & docs[source_col].eqNullSafe(chosen["plan_source_"])
        & (common.word_count(docs[text_col]) == chosen["plan_size_"])
    )
    packed = docs.join(chosen, key).select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), F.explode("when_").alias("at_"))
    return packed.orderBy("at_").select("row_.*")

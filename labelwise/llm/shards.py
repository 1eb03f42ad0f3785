"""Contiguous shards of near equal size in bytes, cut out of a global prefix sum.

Documents are brought into order and written once; a row's place is its partition and its number there.  Every
partition reports one total, the running sum of the totals gives each its first byte, and equal targets are cut
points on that line.  Only the partitions in which a cut falls (one less than there are shards, at most) sum up
their rows one by one, and give the place where the next shard begins.  The second pass knows each row's shard and
slot from its place alone, so texts move once, in the range sort, and not at all where the given order is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwise.llm import common

#: A place is the partition's number and, in these lower bits, the row's number in it.
ROW_BITS = 33
#: Texts are written twice, so the first copy is packed tightly.
PACKED = "zstd"


@dataclass(frozen=True)
class Cut:
    """Where a shard begins: the place of its first row, and how many rows lie before it."""

    place: int
    rank: int


def _longs(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<long>")


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def placed(docs: DataFrame, text_col: str, order: Sequence[str]) -> DataFrame:
    """Written ``(place, size, doc)``, ``doc`` being the whole row; places ascend in ``order``, nulls last, or as stored
    if there is none.

    Rows that agree in ``order`` follow each other as stored, and any number of them divides among partitions.
    """
    rows = docs.select(
        text_size(docs[text_col]).alias("size"),
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        *[docs[c].alias(f"by{k}") for k, c in enumerate(order)],
        F.monotonically_increasing_id().alias("stored"),
    )
    if order:
        by = [*[F.col(f"by{k}").asc_nulls_last() for k in range(len(order))], F.col("stored").asc()]
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = rows.select(F.monotonically_increasing_id().alias("place"), "size", "doc")
    return common.keep_table(rows, "placed_rows", compression=PACKED)


def partition_starts(rows: DataFrame) -> DataFrame:
    """``(part, bytes, rows, first_byte, first_row)`` of each partition: its totals and the sums of all before it."""
    totals = common.keep_table(
        rows.groupBy(F.shiftright("place", ROW_BITS).alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")),
        "partition_totals",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return totals.select(
        "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("bytes", "first_byte"), ("rows", "first_row"))]
    )


def cuts(rows: DataFrame, starts: DataFrame, shards: int) -> list[Cut]:
    """The ``shards - 1`` inner cuts: where the bytes before it come closest to an equal share for each shard."""
    total = starts.agg(F.sum("bytes").alias("n")).collect()[0]["n"]
    if not total or shards < 2:
        return []
    targets = _longs([k * total // shards for k in range(1, shards)])
    end = F.col("first_byte") + F.col("bytes")
    wanted = F.filter(targets, lambda c: (c >= F.col("first_byte")) & (c < end))
    # at most one row per cut
    parted = starts.withColumn("targets", wanted).where(F.size("targets") > 0).select("part", "rows", "first_byte", "first_row", "targets")
    near = rows.select("place", "size", F.shiftright("place", ROW_BITS).alias("part")).join(F.broadcast(parted), "part")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begins = near.withColumn("at", F.col("first_byte") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    after = begins.select("part", "place", (2 * F.col("at") + F.col("size")).alias("twice"), F.explode("targets").alias("target"))
    found = after.where("twice > 2 * target").groupBy("part", "target").agg(F.min("place").alias("place"))
    pieces = parted.select("part", "rows", "first_row", F.explode(F.array_distinct("targets")).alias("target"))
    first = {(r["part"], r["target"]): r["place"] for r in found.collect()}
    begun = {}
    for r in pieces.collect():
        base = r["part"] << ROW_BITS
        place = first.get((r["part"], r["target"]))
        inside = r["rows"] if place is None else place - base
        begun[r["target"]] = Cut((r["part"] + 1) << ROW_BITS if place is None else place, r["first_row"] + inside)
    return [begun[k * total // shards] for k in range(1, shards)]


def sharded(rows: DataFrame, starts: DataFrame, begun: Sequence[Cut]) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, from each row's place and its partition's first row."""
    part = F.shiftright("place", ROW_BITS)
    places, ranks = _longs([c.place for c in begun]), _longs([0, *[c.rank for c in begun]])
    passed = F.size(F.filter(places, lambda p: F.shiftright(p, ROW_BITS) < F.col("part")))
    # cuts of earlier partitions are counted once per partition, only those of its own are compared with its rows
    offsets = starts.select(
        F.col("part").alias("of"),
        "first_row",
        passed.alias("passed"),
        F.filter(places, lambda p: F.shiftright(p, ROW_BITS) == F.col("part")).alias("inner"),
    )
    offsets = common.sized(common.keep_table(offsets, "partition_offsets"), 64)
    at = rows.join(offsets, part == F.col("of"))
    shard = (F.col("passed") + F.size(F.filter("inner", lambda p: p <= F.col("place")))).cast("int")
    return at.withColumn("shard", shard).select(
        "shard",
        (F.col("first_row") + F.expr(f"place & {(1 << ROW_BITS) - 1}L") - F.element_at(ranks, F.col("shard") + 1)).alias("slot"),
        "size",
        "doc",
    )


def write(docs: DataFrame, path: str, shards: int = 8, order: Sequence[str] = ("doc_id",), text_col: str = "text") -> None:
    """Shards 0 to ``shards - 1`` as Parquet folders ``shard=N`` below ``path``, rows in order of their slot.

    A document's size is the UTF-8 bytes of its text (null: none) plus 1.  Shards are contiguous in ``order`` (nulls
    last; rows that agree in it as stored; an empty ``order`` keeps the stored one, without a shuffle), and each cut is
    the document boundary closest to an equal share of all bytes, the earlier one of two equally close, so a shard is
    off its share by at most the larger half of the documents at its ends.  A document larger than a share leaves
    neighbouring shards empty.  ``slot`` counts a shard's rows from 0.  The whole row is in the column ``doc``, so no
    name can clash.  Equal texts are documents like any others.  An empty table writes no shard.
    """
    rows = placed(docs, text_col, order)
    starts = common.keep_table(partition_starts(rows), "partition_starts")
    out = sharded(rows, starts, cuts(rows, starts, shards)).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").option("compression", PACKED).parquet(path)


def read(spark: SparkSession, path: str, like: DataFrame, shard: int | None = None) -> DataFrame:
    """``(shard, slot, size, doc)`` of written shards, or of one of them alone; ``like`` has the documents' columns."""
    doc = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in like.schema)
    rows = spark.read.schema(f"slot long, size long, doc struct<{doc}>, shard int").parquet(path)
    return rows if shard is None else rows.where(F.col("shard") == shard)

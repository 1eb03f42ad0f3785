"""Exact duplicates by two passes over a Bloom filter; rows that cannot repeat never shuffle.

Pass one sets, for each text hash, ``PROBES`` bits of a filter that is held as 32,768-bit blocks, and keeps
only the bits that two rows or more have set.  Pass two tests every row against those bits: a row with a
bit that nobody else set is unique and passes straight through; the rest group by SHA-256.  A chance hit
only sends a unique row through the shuffle, so results are exact at any filling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common

PROBES = 2
#: Filter bits for each row.
BITS_PER_ROW = 16
#: A filter up to this size is broadcast; a larger one joins by block number.
BROADCAST_BYTES = 32 << 20
BLOCK_BITS = 32_768


def _bits(rows: int) -> int:
    """A power of two, at least one block."""
    return max(BLOCK_BITS, 1 << math.ceil(math.log2(max(1, rows * BITS_PER_ROW))))


def _probe(digest: Column, k: int, bits: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1))


def repeated_bits(rows: DataFrame, bits: int) -> DataFrame:
    """``(block, bitmap)``: the bits that more than one row sets, from the ``sha`` column."""
    probes = rows.select(F.explode(F.array(*[_probe(F.col("sha"), k, bits) for k in range(PROBES)])).alias("bit"))
    # partial counts fold copies before the shuffle, so a text repeated a billion times is one row a task
    twice = probes.groupBy("bit").count().where("count > 1")
    return twice.groupBy(F.expr(f"bit div {BLOCK_BITS}").alias("block")).agg(
        F.expr(f"bitmap_construct_agg(bit % {BLOCK_BITS})").alias("bitmap")
    )


def _maybe_repeated(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``maybe``: all probes of the row are among the repeated bits."""
    filter_rows = common.keep_table(repeated_bits(rows, bits), "repeated_bits")
    small = bits // 8 <= BROADCAST_BYTES
    flags = rows
    for k in range(PROBES):
        part = filter_rows.toDF(f"block{k}", f"bitmap{k}")
        part = F.broadcast(part) if small else part
        at = flags.withColumn(f"bit{k}", _probe(F.col("sha"), k, bits)).withColumn(
            f"block{k}", F.expr(f"bit{k} div {BLOCK_BITS}")
        )
        # bits lie least significant first within each byte of a block
        byte = F.conv(F.hex(F.expr(f"substring(bitmap{k}, int(bit{k} % {BLOCK_BITS} div 8) + 1, 1)")), 16, 10).cast("int")
        hit = F.expr(f"shiftright(byte{k}, int(bit{k} % 8)) & 1") == 1
        flags = at.join(part, f"block{k}", "left").withColumn(f"byte{k}", byte).withColumn(
            f"hit{k}", F.coalesce(hit, F.lit(False))
        )
    return flags.select(
        *rows.columns, F.expr(" AND ".join(f"hit{k}" for k in range(PROBES))).alias("maybe")
    )


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty.
    Of equal texts the row with the smallest id stays, null ids last; of rows that also share the id,
    exactly one.  An empty table gives an empty result; other columns play no part.
    """
    rows = common.keep_table(
        common.narrow(docs, id=id_col, text=text_col).select(
            "id", F.sha2(common.one_space(F.col("text")), 256).alias("sha"), F.monotonically_increasing_id().alias("row")
        ),
        "text_hashes",
    )
    flagged = _maybe_repeated(rows, _bits(rows.count()))
    flagged = common.keep_table(flagged, "text_flags")
    alone = flagged.where("NOT maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    maybe = flagged.where("maybe").select("id", "sha", "row")
    groups = maybe.groupBy("sha").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"), F.count("*").alias("group_size")
    )
    grouped = maybe.join(groups, "sha").select(
        "id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "sha",
    )
    return alone.unionByName(grouped).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )

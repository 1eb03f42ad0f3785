"""What several of the training-data operators share: written tables, word rules, row choice, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwise.session import shared_dir

#: The white space of the word rules: space and \x09 to \x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keep_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost tasks reread it."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the rows that Spark hands to a Python worker at a time, and its setting for that.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run here hand rows to workers in small batches, for texts and lists of ids are long."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


#: What a worker keeps for its next task, one thing at a time.
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What the worker made for an earlier task under this key, or else made now in place of anything else it kept."""
    if key not in _kept:
        released()
        _kept[key] = make()
    return _kept[key]


def released() -> None:
    """A task of another kind begins in this worker: what it kept is dropped, and freed memory goes back to the system."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def one_space(text: Column) -> Column:
    """Every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def fold(id_col: Column, parts: int) -> Column:
    """Remainder of the crc32 of the id as text; null when the id is null."""
    return (F.crc32(id_col.cast("string")) % parts).cast("int")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns cannot clash."""
    return df.select(*[df[have].alias(name) for name, have in columns.items()])


#: A written table is broadcast up to this many bytes; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def sized(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` (a written one), hinted as broadcast if its rows are few enough."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def without(docs: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` less the ids in the one column of the written table ``dropped``; rows with a null id stay."""
    gone = sized(dropped.toDF("gone_id_"), 16)
    return docs.join(gone, docs[id_col] == gone["gone_id_"], "left_anti")


def single(docs: DataFrame, id_col: str) -> DataFrame:
    """One row of each id, the first by all its columns; rows with a null id all stay.

    Only rows of repeated ids shuffle; with none, ``docs`` comes back untouched.
    """
    ids = narrow(docs, repeated_id_=id_col)
    again = keep_table(
        ids.where(F.col("repeated_id_").isNotNull()).groupBy("repeated_id_").count().where("count > 1").select("repeated_id_"),
        "repeated_ids",
    )
    if again.isEmpty():
        return docs
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), docs[id_col].alias("key_"))
    repeated = packed.join(again, packed["key_"] == again["repeated_id_"], "left_semi")
    first = repeated.groupBy("key_").agg(F.min("row_").alias("row_")).select("row_.*")
    return docs.join(again, docs[id_col] == again["repeated_id_"], "left_anti").unionByName(first)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for the nodes of undirected ``edges (a, b)``: root is the least node reachable.

    Each round takes every node's least neighbouring label and then the label of its label, so paths
    halve; labels are written to the shared folder every round.  No component is gathered: a hub's edges
    are rows of a join (which adaptive execution splits) and of a minimum that is combined before the shuffle.
    """
    both = keep_table(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(),
        f"{name}_edges",
    )
    labels = keep_table(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}_labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("near")
        )
        least = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = keep_table(
            least.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")), f"{name}_labels"
        )
        labels = new.select("node", "root")
        if new.where("old != root").isEmpty():
            return labels


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))

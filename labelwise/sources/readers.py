"""Sources: run logs, label files, transcripts, tables, frames."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions.predicates import path_list
from labelwise.session import qualified, sized, written

SWEEP_LOG = (
    "record_type string, image_path string, image_filename string, detection_index int, "
    "detection_class string, raw_detection_class string, canonical_class string, "
    "bbox array<int>, yolo_confidence double, ocr_source string, ocr_engine string, "
    "ocr_text string, ocr_confidence double, ocr_error string, ocr_status string, "
    "ocr_seconds double, ocr_variant string, ocr_score double, parsed boolean, "
    "error string, seconds double, crops int, ln long"
)
FRAMES = (
    "cam string, ts timestamp, seq long, sharpness double, width int, height int, "
    "classes array<string>, n_det int, det_error string"
)


def file_place() -> Column:
    """Where a row stands in its source: file, start of the split, place within the split's task.

    A task may pack several splits, largest files first; within one of them its rows ascend.
    """
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))


def read_sweep_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with torn and blank lines skipped; neighbours survive.

    Written logs carry ``ln`` and are read as they are.  Rows without it are numbered behind all others by their place
    in the files: file, split, row.  They are written once with their place, every split reports how many it has, and
    the running sum of these counts gives each split its first number; the log itself is neither sorted nor shuffled.
    """
    raw = spark.read.schema(SWEEP_LOG + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")]
    good = raw.select("*", *split).where("_corrupt_record is null and record_type is not null").drop("_corrupt_record")
    plain = good.where("ln is not null").drop("_file", "_split")
    missing = good.where("ln is null")
    if missing.isEmpty():
        return plain
    # within a task the rows of a split follow each other
    missing = written(missing.withColumn("_row", F.monotonically_increasing_id()))
    splits = missing.groupBy("_file", "_split").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    ahead = plain.agg(F.count("*").alias("_ahead"))
    starts = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = written(starts.join(F.broadcast(ahead), F.lit(True)))  # one row
    numbered = missing.join(sized(starts, 256), ["_file", "_split"]).withColumn(
        "ln", F.col("_ahead") + F.col("_start") + F.col("_row") - F.col("_first") + 1
    )
    return plain.unionByName(numbered.select(*plain.columns))


def parse_label_lines(text: Column) -> Column:
    """Lines of one label file as ``array<struct<line, raw, class_id, vals>>``.

    Blank lines keep their number but give no row; a row with any field that is
    not a number is kept as class -1 without values.
    """
    def row(raw: Column, i: Column) -> Column:
        fields = F.filter(F.split(raw, r"\s+"), lambda f: f != "")
        numbers = F.transform(fields, lambda f: f.try_cast("double"))
        ok = ~F.exists(numbers, lambda n: n.isNull())
        return F.struct(
            (i + 1).alias("line"),
            raw.alias("raw"),
            F.when(ok, F.get(numbers, F.lit(0)).cast("int")).otherwise(-1).alias("class_id"),
            F.when(ok, F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0))))
            .otherwise(F.expr("cast(array() as array<double>)"))
            .alias("vals"),
        )

    lines = F.transform(F.split(text, r"\r\n|\n|\r"), row)
    return F.filter(lines, lambda r: F.trim(r["raw"]) != "")


#: A file that goes away between listing and reading, or cannot be read, must not end the job.
LENIENT = {"recursiveFileLookup": "true", "ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}


def plain_path(path: Column) -> Column:
    """A path as a file source prints it: not encoded, one slash after ``file:``."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe=":/"))


def _listed(files: DataFrame) -> DataFrame:
    """The files that Spark listed for a source, the empty ones too."""
    names = files.sparkSession.createDataFrame([(f,) for f in files.inputFiles()], "path string")
    return names.select(plain_path(F.col("path")).alias("path"))


def _empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """'' for a file that is there and empty, null for any other."""
    for batch in batches:
        contents = []
        for path in batch.column(0).to_pylist():
            try:
                store, name = _store(path)
                contents.append("" if store.get_file_info(name).size == 0 else None)
            except (OSError, ValueError):
                contents.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.string())], names=["_path", "content"])


def label_files(spark: SparkSession, root: str) -> DataFrame:
    """Every label file below ``root`` as ``split, file, content, status``; a file is one small record.

    The split is the folder that holds ``labels``, the file its path below that.  The listing is Spark's own; files
    of it that could not be read are rows too, without content and with status ``unreadable``.
    """
    # load, not text(): that one sets the option back
    whole = spark.read.format("text").options(pathGlobFilter="*.txt", wholetext="true", **LENIENT).load(root)
    texts = whole.select(plain_path(F.col("_metadata.file_path")).alias("_path"), F.col("value").alias("content"))
    listed = _listed(whole).withColumnRenamed("path", "_path")
    joined = listed.join(texts, "_path", "left")
    # Spark reads nothing from an empty file, so what came without content is looked at again
    silent = joined.where("content IS NULL").select("_path").mapInArrow(_empty, "_path string, content string")
    below = r"([^/]+)/labels/(.+)$"
    return joined.where("content IS NOT NULL").unionByName(silent).select(
        F.regexp_extract("_path", below, 1).alias("split"),
        F.regexp_extract("_path", below, 2).alias("file"),
        "content",
        F.when(F.col("content").isNull(), "unreadable").otherwise("read").alias("status"),
    )


def read_label_rows(files: DataFrame) -> DataFrame:
    """Rows of all label files; those without content, or empty, have none."""
    return files.select("split", "file", F.inline(parse_label_lines(F.col("content"))))


def class_names(lines: DataFrame, text: str = "value") -> DataFrame:
    """``names: [a, 'b']`` to an id and name dimension."""
    body = F.regexp_extract(text, r"^names:\s*\[(.*)\]\s*$", 1)
    items = F.transform(F.split(body, ","), lambda x: F.btrim(F.trim(x), F.lit("'\"")))
    kept = F.filter(items, lambda x: x != "")
    return lines.where(F.col(text).startswith("names:")).select(
        *[c for c in lines.columns if c != text], F.posexplode(kept).alias("class_id", "name")
    )


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image paths below a folder, by lower-cased relative path; contents unread."""
    top = qualified(spark, root).rstrip("/") + "/"
    suffix = F.lower(F.substring_index("path", ".", -1))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .where(suffix.isin(K.IMAGE_SUFFIXES))
        .select(F.substring("path", len(top) + 1, 1 << 30).alias("image_path"))
        .orderBy(F.lower("image_path"), "image_path")
    )


#: Files up to this size are hashed as one value; a larger one streams through its task in pieces.
WHOLE_BYTES = 64 << 20
PIECE_BYTES = 1 << 20


def _hash_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, hashes = [], []
        for path in batch.column(0).to_pylist():
            digest, length = hashlib.sha256(), 0
            try:
                store, name = _store(path)
                with store.open_input_stream(name) as file:
                    while piece := file.read(PIECE_BYTES):
                        digest.update(piece)
                        length += len(piece)
                lengths.append(length)
                hashes.append(digest.hexdigest())
            except (OSError, ValueError):
                lengths.append(None)
                hashes.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string())], names=["path", "length", "hash"])


def evidence_files(spark: SparkSession, root: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """``(path, length, hash)`` of every file below ``root`` with the SHA-256 of its bytes; no content leaves its task.

    What Spark listed but did not read (empty, gone, or larger than ``whole``) is opened in its task and read in pieces;
    a file that cannot be read has a null hash.
    """
    files = spark.read.format("binaryFile").options(**LENIENT).load(root)
    small = files.where(F.col("length") <= whole).select(plain_path(F.replace("path", F.lit("%"), F.lit("%25"))).alias("path"), "length", F.sha2("content", 256).alias("hash"))
    joined = _listed(files).join(small, "path", "left")
    rest = joined.where("hash IS NULL").select("path", "length")
    return joined.where("hash IS NOT NULL").unionByName(rest.mapInArrow(_hash_in_pieces, "path string, length long, hash string"))


def read_path_list(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, path_list(F.col(column)))


def tidy_truth(raw: DataFrame, order: str) -> DataFrame:
    """Transcripts: trimmed, blank keys or texts dropped, the last row of a key wins."""
    key, text = (F.trim(F.coalesce(c, F.lit(""))) for c in ("key", "text"))
    return (
        raw.select(key.alias("key"), text.alias("text"), order)
        .where("key <> '' and text <> ''")
        .groupBy("key")
        .agg(F.max_by("text", order).alias("text"))
    )


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return tidy_truth(raw.withColumn("_n", file_place()), "_n")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table; partition options spread the scan over executors."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Frame metadata as a stream."""
    return spark.readStream.schema(FRAMES).format(fmt).load(path)


def evolve_schema(old: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add missing columns, filled with their default."""
    out = old
    for name, (ddl, value) in defaults.items():
        if name in old.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit(value).cast(ddl)))
        else:
            out = out.withColumn(name, F.lit(value).cast(ddl))
    return out

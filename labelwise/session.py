"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "labelwise") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LABELWISE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one written table.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only where it
    is unset and Spark runs on this machine alone a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/labelwise/{name}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """The full name of a path, as Spark's file sources print it; a relative one lies below the working folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


#: An input of fewer files than cores, and of at most so many bytes a core, is dealt out again.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """Even out an input of at most ``most`` bytes a core over all cores before CPU-heavy projections.

    Text work costs far more than its bytes suggest, so a table of a few megabytes would run as one task.  A large
    input, in however few files, has enough splits and passes through untouched, as does one that is not read from
    files.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length").alias("n")).collect()[0]["n"]
    return df.repartition(max(cores, size // SPREAD_BYTES)) if size <= cores * most else df


def written(df: DataFrame) -> DataFrame:
    """An intermediate result that several jobs read, as Parquet in the shared folder: they read the columns they need,
    and lost tasks reread them."""
    path = shared_dir(df.sparkSession, "written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What is joined by sending it to every task is at most this large.
BROADCAST_BYTES = 32 << 20


def sized(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` (a written one), hinted as broadcast if its rows are few enough."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an intermediate result that several jobs read, dealt out to all cores if small."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
    return spread(df).checkpoint()

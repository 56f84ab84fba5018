"""Session and table helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, app: str = "scriptorium", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a test-data folder (any store that Spark reads)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan gives fewer tasks than half of them (a small file can't be split); else as it is.

    For work that costs far more a row than moving the row does.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound Arrow batches by bytes, so that Python holds few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stored(df: DataFrame, *more: DataFrame) -> DataFrame:
    """``df`` (and ``more`` of the same columns, one after the other) written under ``spark.checkpoint.dir`` and read back: cuts lineage, and survives lost executors.

    The shuffle files of each write go when it is done, as nothing reads them again.
    Only a local session without that setting uses a temporary folder of this machine.
    """
    return stored_parts(df.sparkSession, [df, *more])


def stored_parts(spark: SparkSession, parts: Iterable[DataFrame], by: str | None = None) -> DataFrame:
    """As :func:`stored`, of frames that are made only when those before them are written; ``by`` names a column of folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", base)
    path, schema = f"{base.rstrip('/')}/{uuid.uuid4().hex}", None
    for part in parts:
        schema = part.schema
        write = part.write.mode("append").option("compression", "zstd")
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            (write.partitionBy(by) if by else write).parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of :func:`stored` frames that nothing reads any more."""
    for df in frames:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

"""Session and storage helpers shared by operators, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TESTDATA_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "shapelens") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the cluster (a shared file system).
    Only a local-mode session without the setting gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        configured = tempfile.mkdtemp(prefix="shapelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    the planner sees the true size, so it broadcasts only below its threshold.
    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a scale-factor folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file sources name it, with its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(target).toString()


def footer_session(spark: SparkSession) -> SparkSession:
    """A session like this one whose Parquet reader answers counts, minima and maxima from the files' footers.

    That takes Spark's second reader, which is chosen by a setting; the caller's session keeps its own.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def no_less(count: Column) -> Column:
    """A count from footers: of no row groups at all Spark's pushed count is null, or -1 in generated code."""
    return F.greatest(count, F.lit(0).cast("bigint"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL (by position) of many DataFrames, analysed once.

    Chaining ``unionByName`` re-analyses the growing plan at every step, which
    is quadratic in the number of inputs; one SQL statement is not. Frames are
    aligned to the column order of the first one.
    """
    if len(frames) == 1:
        return frames[0]
    cols = frames[0].columns
    spark = frames[0].sparkSession
    names = {f"u{i}": f.select(*cols) for i, f in enumerate(frames)}
    return spark.sql(" UNION ALL ".join(f"SELECT * FROM {{{n}}}" for n in names), **names)

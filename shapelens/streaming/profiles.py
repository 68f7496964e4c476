"""Streaming key templates per event-time window (O-47) and running field
profiles over message bodies (O-48).

Counts are plain Structured Streaming aggregations: the per-row work (templating,
or the walk of a document's shape) is stateless, and the state holds one count per
(window, template) or (path, type), never the rows themselves. What has been counted
is read from the state store, so a result is as large as the state. Groups with
types and sample keys (``run_key_groups``) need the smallest keys of a group, which no
streaming aggregate has; they keep a state table of their own, merged once a micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapelens.functions.keys import key_template
from shapelens.operators.documents import document_shapes, typed_paths, with_percentages
from shapelens.operators.keys import top_n_per_group
from shapelens.session import ensure_checkpoint_dir


def event_time(stream: DataFrame, ts_col: str):
    """The column as an instant; TIMESTAMP_NTZ is UTC wall-clock time, whatever the session's zone."""
    ts = F.col(ts_col)
    if isinstance(stream.schema[ts_col].dataType, T.TimestampNTZType):
        return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).cast("timestamp")
    return ts


def stream_key_templates(stream: DataFrame, ts_col: str, key_col: str,
                         window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Counts per key template per tumbling event-time window (O-47).

    Rows whose window ended before the watermark are dropped by Spark in
    append/update mode (judged against the previous micro-batch's watermark);
    complete mode keeps every row. TIMESTAMP_NTZ event times are read as UTC
    wall-clock times, independent of the session time zone.
    """
    events = stream.select(event_time(stream, ts_col).alias("event_time"), key_template(F.col(key_col)).alias("pattern"))
    return (events.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", window).alias("window"), "pattern")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "pattern", "count"))


def stream_field_profile(stream: DataFrame, json_col: str) -> DataFrame:
    """Running (path, type, type_count) over message bodies (O-48).

    Each document's shape is walked where it is read, so the stream's state is one
    count per (path, type), however many shapes there are. The row with null path
    and type counts object documents. Percentages are computed on read with
    ``profile_percentages``.
    """
    return typed_paths(document_shapes(stream, json_col), []).groupBy("path", "type").agg(
        F.count(F.lit(1)).alias("type_count"))


def profile_percentages(counts: DataFrame) -> DataFrame:
    """Field-profile percentages from a snapshot of ``stream_field_profile``."""
    objects = counts.where(F.col("path").isNull() & F.col("type").isNull()).agg(F.sum("type_count").alias("_docs"))
    return with_percentages(counts, objects)


def new_root(spark: SparkSession) -> str:
    """A folder for one stream's results, state and checkpoint, in the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/streams-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _there(spark: SparkSession, path: str) -> bool:
    files, target = _folder(spark, path)
    return files.exists(target)


def run_available_now(result: DataFrame, root: str, mode: str = "append") -> None:
    """Run a streaming query over everything available.

    ``root`` is the query's folder: a later run with the same one goes on from its
    checkpoint. In append mode Spark's exactly-once file sink writes finished rows under
    ``root/rows``; in update mode nothing is written but the state.
    """
    out = result.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    out = out.format("parquet").option("path", f"{root}/rows") if mode == "append" else out.format("noop")
    query = out.start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def state_rows(spark: SparkSession, root: str, columns: str) -> DataFrame:
    """Keys and values in the query's state store after its last committed batch, named by DDL ``columns``."""
    schema = T.StructType.fromDDL(columns)
    if not _there(spark, f"{root}/checkpoint/state"):
        return spark.createDataFrame([], schema)
    state = spark.read.format("statestore").load(f"{root}/checkpoint")
    return state.select("key.*", "value.*").toDF(*schema.names)


def key_template_counts(spark: SparkSession, root: str, finished: bool = False) -> DataFrame:
    """(window_start, window_end, pattern, count) of an append run of ``stream_key_templates``.

    Windows that the watermark has passed are in the files, each once; the others are in the
    state. With ``finished`` the first alone.
    """
    schema = "window_start timestamp, window_end timestamp, pattern string, count bigint"
    done = spark.read.schema(schema).parquet(f"{root}/rows") if _there(spark, f"{root}/rows") else spark.createDataFrame([], schema)
    if finished:
        return done
    held = state_rows(spark, root, "window struct<start:timestamp,end:timestamp>, pattern string, count bigint")
    return done.unionByName(held.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "pattern", "count"))


def field_counts(spark: SparkSession, root: str) -> DataFrame:
    """(path, type, type_count) of an update run of ``stream_field_profile``, for ``profile_percentages``."""
    return state_rows(spark, root, "path string, type string, type_count bigint")


class KeyGroupState:
    """State of ``run_key_groups``: a folder for each batch with counts by type, sample keys and the latest event time.

    Batch b reads the state of b - 1 and writes its own, so a batch that runs again gives the
    same; older ones are deleted. Windows that the watermark had passed before the batch are
    moved to ``closed`` once, and their late rows are dropped. A group has a row for each type and ``n`` keys.
    """

    COUNTS = "window_start timestamp, window_end timestamp, pattern string, type string, n bigint"
    SAMPLES = "window_start timestamp, window_end timestamp, pattern string, key string"
    GROUP = ("window_start", "window_end", "pattern")

    def __init__(self, spark: SparkSession, root: str, n: int, watermark: str):
        self.spark, self.root, self.n, self.watermark = spark, root, n, watermark

    def _read(self, table: str, schema: str, batch: int) -> DataFrame:
        path = f"{self.root}/state/{batch}/{table}"
        return self.spark.read.schema(schema).parquet(path) if _there(self.spark, path) else self.spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """``rows``: window_start, window_end, event_time, pattern, type, key."""
        latest = self._read("latest", "event_time timestamp", batch - 1)
        mark = latest.select(F.max("event_time") - F.expr(f"INTERVAL {self.watermark}")).first()[0]
        passed = F.coalesce(F.col("window_end") <= F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        fresh = rows.where(~passed)
        counts, samples = self._read("counts", self.COUNTS, batch - 1), self._read("samples", self.SAMPLES, batch - 1)
        own = f"{self.root}/state/{batch}"
        for name, old, new in (("counts", counts, self._counts(fresh)), ("samples", samples, fresh.select(*self.GROUP, "key"))):
            old.where(passed).write.mode("overwrite").parquet(f"{self.root}/closed/{name}/batch={batch}")
            both = old.where(~passed).unionByName(new)
            merged = both.groupBy(*self.GROUP, "type").agg(F.sum("n").alias("n")) if name == "counts" else \
                top_n_per_group(both, self.GROUP, [F.col("key").asc()], self.n)
            merged.write.mode("overwrite").parquet(f"{own}/{name}")
        latest.unionByName(rows.select("event_time")).agg(F.max("event_time").alias("event_time")).write.mode("overwrite").parquet(f"{own}/latest")
        files, old = _folder(self.spark, f"{self.root}/state/{batch - 2}")
        files.delete(old, True)

    def _counts(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.GROUP, "type").agg(F.count(F.lit(1)).alias("n"))

    def last(self) -> int | None:
        """The last batch whose state is whole: ``latest`` is written last."""
        files, folder = _folder(self.spark, f"{self.root}/state")
        if not files.exists(folder):
            return None
        found = [int(f.getPath().getName()) for f in files.listStatus(folder)]
        return max((b for b in found if _there(self.spark, f"{self.root}/state/{b}/latest/_SUCCESS")), default=None)

    def groups(self) -> DataFrame:
        """(window_start, window_end, pattern, count, types map<string,bigint>, sample_keys array<string>)."""
        last = self.last()
        tables = []
        for name, schema in (("counts", self.COUNTS), ("samples", self.SAMPLES)):
            rows = self._read(name, schema, -1 if last is None else last)
            if last is not None:
                closed = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/closed/{name}")
                # Of a batch that failed after closing windows, they are still in the state of the one before.
                rows = rows.unionByName(closed.where(F.col("batch") <= last).drop("batch"))
            tables.append(rows)
        counts = tables[0].groupBy(*self.GROUP).agg(
            F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(
                F.when(F.col("type").isNotNull(), F.struct("type", "n"))))).alias("types"))
        samples = tables[1].groupBy(*self.GROUP).agg(F.sort_array(F.collect_list("key")).alias("sample_keys"))
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in self.GROUP]
        return counts.alias("c").join(samples.alias("s"), same, "left").select("c.*", "s.sample_keys")


def run_key_groups(stream: DataFrame, ts_col: str, key_col: str, type_col: str, root: str, window: str = "1 day",
                   watermark: str = "1 hour", n: int = 10) -> DataFrame:
    """Key templates with counts, types and the ``n`` smallest keys per event-time window, over all that is available (O-47 with O-21).

    A micro-batch is grouped like a batch table (counts combine in each task, at most ``n`` keys
    of a group leave one), then merged with the state of the batch before. A row whose
    window had ended before the watermark of the batches before it is dropped. A later run
    with the same ``root`` goes on from its checkpoint.
    """
    state = KeyGroupState(stream.sparkSession, root, n, watermark)
    own = F.window("event_time", window)
    rows = stream.select(event_time(stream, ts_col).alias("event_time"), key_template(F.col(key_col)).alias("pattern"),
                         F.col(key_col).alias("key"), F.col(type_col).alias("type"))
    rows = rows.select(own.alias("w"), "*").select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                                                   "event_time", "pattern", "type", "key")
    query = (rows.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return state.groups()

"""Checked streaming queries (O-47, O-48): file streams over the testdata,
``availableNow`` into files of the shared folder, compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapelens.plans import duck
from shapelens.plans.registry import query
from shapelens.session import ensure_checkpoint_dir, read_table
from shapelens.streaming.profiles import (field_counts, key_template_counts, new_root, profile_percentages,
                                          run_available_now, run_key_groups, stream_field_profile, stream_key_templates)


def _event_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf))


@query("stream_key_templates", f"""
SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start,
       {duck.key_template("concat(event_type, ':', CAST(user_id AS VARCHAR))")} AS pattern,
       CAST(count(*) AS BIGINT) AS count
FROM events GROUP BY 1, 2
""")
def q_stream_key_templates(spark, sf):
    ev = _event_stream(spark, sf).withColumn(
        "key", F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")))
    root = new_root(spark)
    run_available_now(stream_key_templates(ev, "ts", "key", "1 day", "1 hour"), root)
    out = key_template_counts(spark, root)
    # Epoch seconds: comparable across engines and session time zones.
    return out.select(F.unix_seconds("window_start").alias("window_start"),
                      "pattern", F.col("count").cast("bigint"))


@query("stream_field_profile", f"""
WITH d AS (SELECT event_id AS doc_id, props AS json FROM events),
l AS ({duck.json_leaves('d')}),
pt AS (SELECT path, type, count(*) AS type_count FROM l GROUP BY path, type),
pp AS (SELECT *, sum(type_count) OVER (PARTITION BY path) AS occurrences FROM pt),
n AS (SELECT count(*) AS docs FROM d)
SELECT path, type, CAST(type_count AS BIGINT) AS type_count,
       {duck.pct('type_count', 'occurrences')} AS type_pct,
       CAST(occurrences AS BIGINT) AS occurrences,
       {duck.pct('occurrences', 'docs')} AS occurrence_pct
FROM pp, n
""")
def q_stream_field_profile(spark, sf):
    root = new_root(spark)
    run_available_now(stream_field_profile(_event_stream(spark, sf), "props"), root, "update")
    return profile_percentages(field_counts(spark, root))


LATE_CUT = "(SELECT CAST(min(ts) AS TIMESTAMP) + INTERVAL 5 DAY FROM events)"


@query("stream_key_templates_append", f"""
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type, user_id,
                  user_id % 10 = 3 AND CAST(ts AS TIMESTAMP) < {LATE_CUT} AS late FROM events),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e WHERE NOT late),
k AS (SELECT epoch(date_trunc('day', ts)) AS day,
        {duck.key_template("concat(event_type, ':', CAST(user_id AS VARCHAR))")} AS pattern
      FROM e, m WHERE NOT late OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
SELECT CAST(day AS BIGINT) AS window_start, pattern, CAST(count(*) AS BIGINT) AS count
FROM k, m WHERE to_timestamp(day)::TIMESTAMP + INTERVAL 1 DAY <= mark GROUP BY 1, 2
""")
def q_stream_key_templates_append(spark, sf):
    """Append mode with late rows: events of the first days by some users come in a
    second run of the query, past the watermark of the first."""
    root = _two_runs(spark, sf, lambda stream, root: run_available_now(
        stream_key_templates(stream, "ts", "key", "1 day", "1 hour"), root))
    return key_template_counts(spark, root, finished=True).select(
        F.unix_seconds("window_start").alias("window_start"), "pattern", F.col("count").cast("bigint"))


def _two_runs(spark, sf, run) -> str:
    """All events but the late ones, then the late ones, each written by Spark's own tasks before a run on one checkpoint."""
    ev = read_table(spark, sf, "events").withColumn(
        "key", F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")))
    first = ev.select(F.min("ts") + F.expr("INTERVAL 5 DAYS")).scalar()
    late = (F.col("user_id") % 10 == 3) & (F.col("ts") < first)
    path, root = f"{ensure_checkpoint_dir(spark)}/late-{uuid.uuid4().hex}", new_root(spark)
    rows = ev.select("ts", "key", "event_type")
    for part in (~late, late):
        rows.where(part).write.mode("append").parquet(path)
        run(spark.readStream.schema(StructType(rows.schema.fields)).parquet(path), root)
    return root


@query("stream_key_groups", f"""
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type, concat(event_type, ':', CAST(user_id AS VARCHAR)) AS key,
                  user_id % 10 = 3 AND CAST(ts AS TIMESTAMP) < {LATE_CUT} AS late FROM events),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e WHERE NOT late),
k AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, {duck.key_template("key")} AS pattern, key, event_type AS type
      FROM e, m WHERE NOT late OR date_trunc('day', ts) + INTERVAL 1 DAY > mark),
t AS (SELECT window_start, pattern, type, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT window_start, pattern, key FROM k QUALIFY row_number() OVER (PARTITION BY window_start, pattern ORDER BY key) <= 10),
s AS (SELECT window_start, pattern, string_agg(key, ', ' ORDER BY key) AS sample_keys FROM r GROUP BY ALL)
SELECT window_start, pattern, CAST(sum(n) AS BIGINT) AS count,
       string_agg(type || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY type) AS types, any_value(sample_keys) AS sample_keys
FROM t JOIN s USING (window_start, pattern) GROUP BY window_start, pattern
""")
def q_stream_key_groups(spark, sf):
    """Counts, types and sample keys per window, over the same two runs."""
    out = []
    _two_runs(spark, sf, lambda stream, root: out.append(run_key_groups(stream, "ts", "key", "event_type", root)))
    entries = F.transform(F.sort_array(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    return out[-1].select(F.unix_seconds("window_start").alias("window_start"), "pattern", F.col("count").cast("bigint"),
                          F.array_join(entries, ", ").alias("types"), F.array_join("sample_keys", ", ").alias("sample_keys"))

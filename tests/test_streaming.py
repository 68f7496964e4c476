import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shapelens.operators.documents import field_profile
from shapelens.operators.keys import key_template_groups
from shapelens.streaming import profiles
from shapelens.streaming.profiles import (KeyGroupState, field_counts, key_template_counts, profile_percentages, run_available_now,
                                          run_key_groups, state_rows, stream_field_profile, stream_key_templates)

SCHEMA = "key string, ts timestamp_ntz, body string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


#: One run each: the late row of the third comes after the watermark (day 2, 9:30) has passed its window.
RUNS = [[("a:1", at(1, 8), "{}"), ("a:2", at(2, 10), "{}")], [("a:5", at(2, 10, 30), "{}")],
        [("a:3", at(1, 9), "{}"), ("a:4", at(2, 11), "{}")]]


def test_late_rows_are_dropped_past_the_watermark(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in RUNS:
        _write(spark, src, rows)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        run_available_now(stream_key_templates(stream, "ts", "key", "1 day", "1 hour"), root)
    got = sorted((r.day, r.pattern, r["count"]) for r in key_template_counts(spark, root).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "pattern", "count").collect())
    assert got == [("2024-01-01", "a:*", 1), ("2024-01-02", "a:*", 3)]
    # The closed window is in the files, the open one in the state: nothing twice, nothing but the state is kept.
    assert key_template_counts(spark, root, finished=True).count() == 1
    assert state_rows(spark, root, "w struct<s:timestamp,e:timestamp>, pattern string, count bigint").count() == 1


def test_a_restart_goes_on_from_the_state(spark, tmp_path):
    """Many micro-batches and restarts: the result has a row for each (path, type), and equals the batch profile."""
    src, root = f"{tmp_path}/docs", f"{tmp_path}/out"
    bodies = ['{"a": 1, "b": {"c": null}}', '{"a": 1.5}', "not json", '{"a": 2, "d": [1]}', "[1]", '{"a": "x"}']
    for i in range(4):
        for body in bodies[i:]:
            _write(spark, src, [("k", at(1, 1), body)])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        run_available_now(stream_field_profile(stream, "body"), root, "update")
    counts = field_counts(spark, root)
    assert counts.count() == counts.select("path", "type").distinct().count() == 7
    got = sorted(map(str, profile_percentages(counts).collect()))
    assert got == sorted(map(str, field_profile(spark.read.schema(SCHEMA).parquet(src), "body").collect()))


def test_nothing_to_read(spark, tmp_path):
    os.makedirs(f"{tmp_path}/none")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/none")
    run_available_now(stream_key_templates(stream, "ts", "key"), f"{tmp_path}/a")
    run_available_now(stream_field_profile(stream, "body"), f"{tmp_path}/b", "update")
    assert key_template_counts(spark, f"{tmp_path}/a").count() == 0 and field_counts(spark, f"{tmp_path}/b").count() == 0
    assert run_key_groups(stream, "ts", "key", "body", f"{tmp_path}/c").count() == 0


def grouped(df):
    return sorted(((r.window_start.day, r.pattern, r["count"], sorted(r.types.items()), r.sample_keys) for r in df.collect()), key=str)


def test_key_groups_by_window(spark, tmp_path):
    """Late rows dropped, the rest as the batch operator groups each window's rows; the state is bounded."""
    src, root = f"{tmp_path}/in", f"{tmp_path}/out"
    runs = [[(f"user:{i}", at(1, 8), "x" if i % 3 else "y") for i in range(40, 0, -1)] + [("user:1", at(2, 10), None)],
            [(f"user:{i}", at(2, 9), "z") for i in range(30)], [("user:0", at(1, 9), "late"), ("k7", at(2, 11), "x"), (None, at(2, 11), "x")]]
    for rows in runs:
        _write(spark, src, rows)
        got = run_key_groups(spark.readStream.schema(SCHEMA).parquet(src), "ts", "key", "body", root, n=4)
    want = []
    for day in (1, 2):
        rows = [r for run in runs for r in run if r[1].day == day and r[2] != "late"]
        batch = key_template_groups(spark.createDataFrame(rows, SCHEMA), "key", "body", n=4).collect()
        want += [(day, r.pattern, r["count"], sorted(r.types.items()), r.sample_keys) for r in batch if r.pattern is not None]
    # Keys without a name are a group too, as their rows count.
    assert [g for g in grouped(got) if g[1] is not None] == sorted(want, key=str)
    assert [g for g in grouped(got.where("pattern is null"))] == [(2, None, 1, [("x", 1)], [])]
    state = KeyGroupState(spark, root, 4, "1 hour")
    samples = state._read("samples", state.SAMPLES, state.last())
    assert samples.groupBy(*state.GROUP).count().agg(F.max("count")).first()[0] <= 4
    assert state.last() == 2 and len(os.listdir(f"{root}/state")) == 2
    assert samples.select("window_start").distinct().count() == 1  # day 1 has left the state


def test_key_groups_repeat_a_failed_batch(spark, tmp_path, monkeypatch):
    """A batch that fails half-way and runs again leaves what one run would."""
    src = f"{tmp_path}/in"
    _write(spark, src, [("user:1", at(1, 8), "x"), ("user:2", at(3, 8), "x")])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    run_key_groups(stream(), "ts", "key", "body", f"{tmp_path}/out")
    _write(spark, src, [("user:3", at(3, 9), "y"), ("user:4", at(1, 9), "late")])
    real = profiles.top_n_per_group

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(profiles, "top_n_per_group", fails)
    with pytest.raises(Exception, match="lost"):
        run_key_groups(stream(), "ts", "key", "body", f"{tmp_path}/out")
    before = grouped(KeyGroupState(spark, f"{tmp_path}/out", 10, "1 hour").groups())
    assert before == [(1, "user:*", 1, [("x", 1)], ["user:1"]), (3, "user:*", 1, [("x", 1)], ["user:2"])]
    monkeypatch.setattr(profiles, "top_n_per_group", real)
    got = run_key_groups(stream(), "ts", "key", "body", f"{tmp_path}/out")
    assert grouped(got) == [(1, "user:*", 1, [("x", 1)], ["user:1"]), (3, "user:*", 2, [("x", 1), ("y", 1)], ["user:2", "user:3"])]

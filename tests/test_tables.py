"""Sketches, keys, inclusions, footers and samples against exact results."""

import os
import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from shapelens.operators.documents import sample_documents, sample_documents_per_group, sample_order
from shapelens.operators.objects import storage_stats
from shapelens.operators import tables
from shapelens.operators.tables import (column_profile, column_ranges, column_sketches, inclusions, merge_sketches, minimal_keys,
                                        store_sketches, stored_profile)

SMALL = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SMALL}/lineitem.parquet")


def test_merged_sketches_equal_one_pass(spark, lineitem, tmp_path):
    """Exact columns are equal; estimates are near the exact numbers, merged or not; a partition is replaced, not added."""
    store = f"{tmp_path}/sketches"
    for day in range(3):
        store_sketches(lineitem.where(F.col("l_orderkey") % 3 == day), store, str(day))
    store_sketches(lineitem.where(F.col("l_orderkey") % 3 == 1), store, "1")
    merged = {r.column: r for r in stored_profile(spark, store).collect()}
    one = {r.column: r for r in merge_sketches(column_sketches(lineitem)).collect()}
    exact = {r.column: r for r in column_profile(lineitem, approx=False).collect()}
    assert merged.keys() == one.keys() == exact.keys()
    for c, r in exact.items():
        for got in (merged[c], one[c]):
            assert (got.type, got.non_null, got.nulls, got.nullable, got.max_length) == (r.type, r.non_null, r.nulls, r.nullable, r.max_length)
            n = lineitem.select(c).distinct().count()
            assert abs(got.distinct_approx - n) <= 0.03 * n
            if r.type in ("int", "bigint", "double"):
                for share, q in zip((0.25, 0.5, 0.75), got.quantiles):
                    below, upto = lineitem.agg(F.avg((F.col(c) < q).cast("int")), F.avg((F.col(c) <= q).cast("int"))).first()
                    assert below <= share + 0.03 and upto >= share - 0.03
            else:
                assert got.quantiles is None


def test_sketches_edge_cases(spark):
    df = spark.createDataFrame([(None, None, [1.0], "x"), (None, float("nan"), None, "")], "a int, `b c` double, v array<double>, s string")
    got = {r.column: r for r in merge_sketches(column_sketches(df)).collect()}
    assert (got["a"].non_null, got["a"].nulls, got["a"].distinct_approx, got["a"].quantiles) == (0, 2, 0, None)
    assert got["v"].distinct_approx == 1 and got["s"].max_length == 1 and got["b c"].nulls == 1
    assert merge_sketches(column_sketches(df.limit(0))).count() == 0
    assert column_sketches(df, F.col("s")).select("part").distinct().count() == 2


def brute_keys(rows, names, most):
    keys = []
    for n in range(1, most + 1):
        for s in combinations(range(len(names)), n):
            own = [tuple(r[i] for i in s) for r in rows]
            if not any(set(k) <= set(s) for k in keys) and len(set(own)) == len(rows) and all(x is not None for o in own for x in o):
                keys.append(s)
    return sorted(", ".join(names[i] for i in k) for k in keys)


@pytest.mark.parametrize("seed", range(3))
def test_minimal_keys_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d x", "e", "f"]
    rows = list({(i % 20, i // 20, rng.randint(0, 50), rng.choice("pqrs"), i if i != 7 else None, rng.random() if seed else 1.0)
                 for i in range(400)})
    df = spark.createDataFrame(rows, "a int, b int, c int, `d x` string, e int, f double").repartition(4)
    got = minimal_keys(df, per_pass=5, per_test=2)
    assert sorted(r.columns for r in got.collect()) == brute_keys(rows, names, 3)
    assert sorted(r.columns for r in minimal_keys(df, ["a", "b"]).collect()) == brute_keys([r[:2] for r in rows], names[:2], 3)
    assert {r.columns for r in minimal_keys(df.limit(0)).collect()} == set(names)
    assert minimal_keys(df.unionAll(df)).count() == 0


def test_minimal_keys_compares_few_rows(spark, monkeypatch):
    """Sets of columns that are almost unique are put out on slices of the rows; none but rows whose hash repeats are compared in all of them."""
    rng = random.Random(5)
    names, n = ["a", "b", "c", "d", "e", "f", "g"], 40_000
    rows = [(i // 2, i * 7919 % n // 2, rng.randint(0, n), rng.randint(0, 300), rng.randint(0, 30), rng.randint(0, 6), "x" if i % 3 else "y") for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'g' else 'int'}" for c in names)).repartition(4).localCheckpoint()
    compared, count = [], tables.unique_keys
    monkeypatch.setattr(tables, "unique_keys", lambda rows, sets, *a: (compared.append(rows.count() * len(sets)), count(rows, sets, *a))[1])
    assert sorted(r.columns for r in minimal_keys(df).collect()) == brute_keys(rows, names, 3)
    assert sum(compared) < 10 * n


def test_repeated_sets_despite_equal_hashes(spark, monkeypatch):
    """Where hashes of different values are equal the values decide; names of columns and many repeats don't matter."""
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 40), i // 30, i % 30, rng.randint(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "_h int, h int, i int, `d x` int, n int")
    sets = {("_h",): ("_h",), ("i", "d x"): ("i", "d x"), ("h", "i"): ("h", "i"), ("h", "i", "n"): ("h", "i"), ("i", "d x", "n"): ("d x", "i")}
    want = {("h", "i"), ("h", "i", "n")}
    assert tables._repeated(df, sets) == want and tables._repeated(df.repartition(3), sets, 2) <= want
    monkeypatch.setattr(tables, "_hash", lambda *names: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(7)))
    monkeypatch.setattr(tables, "FEW_HASHES", 3)
    assert tables._repeated(df, sets) == want


def test_minimal_keys_of_collated_texts(spark):
    df = spark.createDataFrame([("a", 1), ("A", 2), ("b", 1)], "s string, n int").withColumn("s", F.collate("s", "UTF8_LCASE"))
    assert [r.columns for r in minimal_keys(df).collect()] == ["s, n"]


def test_inclusions_against_brute_force(spark):
    """Columns of three tables, more than fit one word of bits, a value in all of them, nulls, long texts, numbers beside texts."""
    rng = random.Random(4)
    tables, values = {}, {}
    for t, width in (("t", 50), ("u v", 20), ("w", 3)):
        rows = [tuple(rng.choice([None, 0, rng.randint(0, 3 + i % 7)]) for i in range(width - 1)) + (
            rng.choice(["0", "1", "x" * 100, "x" * 101, None]),) for _ in range(30)]
        names = [f"c.{i}" for i in range(width)]
        tables[t] = spark.createDataFrame(rows, ", ".join(f"`{c}` {'int' if i < width - 1 else 'string'}" for i, c in enumerate(names)))
        for i, c in enumerate(names):
            values[t, c] = {(i == width - 1, r[i]) for r in rows if r[i] is not None}
    want = {(*a, *b, len(x), len(y)) for a, x in values.items() for b, y in values.items() if a != b and x and x <= y}
    got = [tuple(r) for r in inclusions(tables).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    assert "CartesianProduct" not in plan(inclusions(tables)) and "BroadcastNestedLoop" not in plan(inclusions(tables))
    some = inclusions(tables, {"w": ["c.0", "c.1"]}).collect()
    assert {(r.child_table, r.child_column, r.parent_column) for r in some} <= {("w", "c.0", "c.1"), ("w", "c.1", "c.0")}


def test_footers_answer_counts_and_ranges(spark, lineitem, tmp_path):
    paths = {"l": f"{SMALL}/lineitem.parquet", "parts": f"{tmp_path}/parts", "none": f"{tmp_path}/none"}
    lineitem.repartition(5).write.parquet(paths["parts"])
    lineitem.limit(0).write.parquet(paths["none"])
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    stats = storage_stats(paths, spark)
    # Counts come from pushed aggregates, and the caller's session keeps its settings.
    assert plan(stats).count("PushedAggregation: [COUNT(*)]") == 3 and spark.conf.get("spark.sql.sources.useV1SourceList") == before
    got = {r.table: (r.total_rows, r.total_bytes) for r in stats.collect()}
    own = [f"{tmp_path}/parts/{f}" for f in os.listdir(f"{tmp_path}/parts") if f.endswith(".parquet")]
    bytes_of = lambda files: duckdb.sql(f"SELECT sum(size) FROM read_blob({files!r})").fetchall()[0][0]
    n = lineitem.count()
    assert got["l"] == (n, bytes_of([paths["l"]])) and got["parts"] == (n, bytes_of(own))
    assert got["none"][0] == 0 and got["none"][1] == sum(
        os.path.getsize(f"{paths['none']}/{f}") for f in os.listdir(paths["none"]) if f.endswith(".parquet"))
    ranges = column_ranges({"parts": paths["parts"], "none": paths["none"]}, spark)
    assert "MIN(" in plan(ranges) and "MAX(" in plan(ranges)
    found = {(r.table, r.column): (r.rows, r.min, r.max) for r in ranges.collect()}
    assert found["none", "l_tax"] == (0, None, None) and found["parts", "l_partkey"] == (n, *lineitem.agg(F.min("l_partkey"), F.max("l_partkey")).first())


@pytest.mark.parametrize("n", [0, 1, 7, 500, 999, 1000, 5000])
def test_samples_are_the_first_in_order(spark, n):
    df = spark.range(1000).selectExpr("id % 997 AS id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS g", "'x' AS `_slice`", "1 AS `__end`")
    order = [sample_order(F.col("id"), "5"), F.col("id")]
    want = sorted(r.id for r in df.orderBy(*order).limit(n).collect())
    got = sample_documents(df, "id", n, "5")
    assert sorted(r.id for r in got.collect()) == want and got.columns == df.columns
    per = sample_documents_per_group(df, "g", "id", n, "5").collect()
    for g in (None, 1, 2):
        own = df.where(F.col("g").eqNullSafe(F.lit(g))).orderBy(*order).limit(n)
        assert sorted(r.id for r in per if r.g == g) == sorted(r.id for r in own.collect())


def test_samples_rank_one_slice(spark):
    """No row of the whole table is sorted or gathered in one task; null ids come first, as in an order."""
    df = spark.range(5000).selectExpr("CASE WHEN id % 100 > 0 THEN id END AS id")
    got = sample_documents(df, "id", 60)
    assert "TakeOrdered" not in plan(got) and "GlobalLimit" not in plan(got)
    assert sum(r.id is None for r in got.collect()) == 50 and got.count() == 60

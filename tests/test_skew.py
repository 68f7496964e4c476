"""A third of all rows on one key: results stay whole and exact."""

from pyspark.sql import functions as F

from shapelens.operators.catalog import normalise_indexes
from shapelens.operators.documents import field_profile
from shapelens.operators.keys import key_template_groups, prefix_rollup
from shapelens.operators.tables import check_foreign_key, unique_keys
from shapelens.sources.keys import scan_keys


def _skewed_keys(spark, n=30000):
    # every third key is the same hot key; the rest are distinct
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot:1:x"))
                                 .otherwise(F.concat(F.lit("k:"), F.col("id"))).alias("key"),
                                 F.lit("string").alias("type"))


def test_hot_template_counts_every_key(spark):
    rows = {r.pattern: r for r in key_template_groups(_skewed_keys(spark), n=10).collect()}
    assert rows["hot:*"]["count"] == 10000 and rows["k:*"]["count"] == 20000
    assert rows["hot:*"].sample_keys == ["hot:1:x"] * 10
    assert len(rows["k:*"].sample_keys) == 10


def test_hot_prefix_and_keys(spark):
    keys = _skewed_keys(spark).select(F.concat(F.lit("/"), F.regexp_replace("key", ":", "/"))
                                      .alias("key"))
    roll = {r.prefix: r["count"] for r in prefix_rollup(keys, samples=False).collect()}
    assert roll["/hot/"] == 1 and roll["/k/"] == 20000
    u = unique_keys(_skewed_keys(spark), [["key"]]).collect()[0]
    assert (u.rows, u.distinct_rows, u.is_unique) == (30000, 20001, False)


def test_hot_foreign_key(spark):
    child = _skewed_keys(spark).select("key")
    parent = spark.createDataFrame([("hot:1:x",)], "key string")
    r = check_foreign_key(child, ["key"], parent, ["key"]).collect()[0]
    assert (r.child_rows, r.orphan_rows, r.holds) == (30000, 20000, False)


def test_hot_path_in_documents(spark):
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit('{"a": 1}'))
                                    .otherwise(F.concat(F.lit('{"b": {"c": '), F.col("id"),
                                                        F.lit("}}"))).alias("json"))
    rows = {(r.path, r.type): (r.type_count, r.occurrence_pct)
            for r in field_profile(docs, "json").collect()}
    assert rows == {("a", "number"): (3000, 33), ("b.c", "number"): (6000, 67)}


def test_scan_keys_prefix_filter(spark):
    keys = _skewed_keys(spark, 30)
    assert scan_keys(keys, glob="hot:*").count() == 10
    assert scan_keys(keys, glob="k:1?").count() == 7  # k:10..k:19 minus hot ids 12, 15, 18


def test_synthetic_primary_index(spark):
    listed = spark.createDataFrame([("t1", "idx_a", ["a"], False, False, None),
                                    ("t2", "sqlite_autoindex", ["id"], True, True, None)],
                                   "table string, name string, columns array<string>, "
                                   "is_unique boolean, is_primary boolean, type string")
    primary = spark.createDataFrame([("t1", ["id", "k"]), ("t2", ["id"])],
                                    "table string, columns array<string>")
    got = sorted((r.table, r.name, tuple(r.columns)) for r in
                 normalise_indexes(listed, "sqlite", primary).collect())
    assert got == [("t1", "PRIMARY", ("id", "k")), ("t1", "idx_a", ("a",)),
                   ("t2", "sqlite_autoindex", ("id",))]

from pyspark.sql import functions as F

from shapelens.functions.values import extract_version, format_bytes, pct, thousands
from shapelens.operators.catalog import (assemble_foreign_keys,
                                         assemble_foreign_keys_positional,
                                         assemble_indexes, join_index_columns, normalise_columns,
                                         normalise_indexes, normalise_topology)
from shapelens.operators.objects import (cache_totals, config_map, flatten_mapping, storage_stats,
                                         topic_rollup, unparsable_mappings)
from shapelens.operators.tables import check_foreign_key, column_profile, unique_keys


def test_format_bytes(spark):
    vals = [0, 1, 1023, 1024, 1536, 1048576, 1073741824, 1099511627776 * 3, 1500000, None]
    df = spark.createDataFrame([(v,) for v in vals], "n bigint")
    got = [r.t for r in df.select(format_bytes("n").alias("t")).collect()]
    assert got == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "1 GB", "3 TB",
                   "1.43 MB", None]


def test_scalar_helpers(spark):
    r = spark.sql("select 1234567 n, 'x\\r\\nredis_version:7.2.4\\r\\ny' i, '' e").select(
        thousands("n").alias("t"), extract_version("i").alias("v"),
        extract_version("e").alias("none"), pct(F.lit(1), F.lit(3)).alias("p"),
        pct(F.lit(1), F.lit(2)).alias("half")).collect()[0]
    assert (r.t, r.v, r.none, r.p, r.half) == ("1,234,567", "Redis 7.2.4", None, 33, 50)


def test_mysql_columns(spark):
    dump = spark.createDataFrame([
        ("users", 1, "id", "int", "NO", None, "", "PRI", "auto_increment", None),
        ("users", 2, "email", "varchar(255)", "NO", None, "mail", "UNI", "", 255),
        ("users", 3, "age", "int", "YES", "0", None, "", "", 0)],
        "table_name string, ordinal_position int, column_name string, column_type string, "
        "is_nullable string, column_default string, column_comment string, column_key string, "
        "extra string, character_maximum_length bigint")
    rows = normalise_columns(dump, "mysql").orderBy("ordinal").collect()
    assert [(r.name, r.nullable, r.is_primary_key, r.is_auto_increment, r.max_length, r.comment)
            for r in rows] == [("id", False, True, True, None, None),
                               ("email", False, False, False, 255, "mail"),
                               ("age", True, False, False, None, None)]


def test_sqlite_composite_key_flags_first_column_only(spark):
    dump = spark.createDataFrame([("composite_pk_test", 0, "field1", "TEXT", 1, None, 1),
                                  ("composite_pk_test", 1, "field2", "TEXT", 1, None, 2),
                                  ("t", 0, "id", "integer", 0, "", 1)],
                                 "table_name string, cid int, name string, type string, "
                                 "notnull int, dflt_value string, pk int")
    rows = {(r.table, r.name): r for r in normalise_columns(dump, "sqlite").collect()}
    assert rows[("composite_pk_test", "field1")].is_primary_key is True
    assert rows[("composite_pk_test", "field2")].is_primary_key is False
    assert rows[("t", "id")].is_auto_increment is True and rows[("t", "id")].default_value is None


def test_assemble_indexes_order_and_flags(spark):
    rows = spark.createDataFrame([
        ("orders", "idx_ud", "order_date", 2, 1, "BTREE"),
        ("orders", "idx_ud", "user_id", 1, 1, "BTREE"),
        ("orders", "PRIMARY", "id", 1, 0, "BTREE")],
        "table string, index_name string, column_name string, seq int, non_unique int, "
        "index_type string")
    got = {r.name: r for r in assemble_indexes(rows).collect()}
    assert got["idx_ud"].columns == ["user_id", "order_date"]
    assert got["PRIMARY"].is_primary and got["PRIMARY"].is_unique
    assert not got["idx_ud"].is_unique


def test_foreign_keys_aligned(spark):
    ku = spark.createDataFrame([
        ("s", "fk_oi", "order_items", "product_id", 2, "orders", "pid"),
        ("s", "fk_oi", "order_items", "order_id", 1, "orders", "id")],
        "schema string, constraint_name string, table string, column_name string, ordinal int, "
        "referenced_table string, referenced_column string")
    rules = spark.createDataFrame([("s", "fk_oi", "RESTRICT", "CASCADE")],
                                  "schema string, constraint_name string, update_rule string, "
                                  "delete_rule string")
    r = assemble_foreign_keys(ku, rules).collect()[0]
    assert (r.columns, r.referenced_columns, r.on_delete, r.on_update) == (
        ["order_id", "product_id"], ["id", "pid"], "CASCADE", "RESTRICT")


def test_positional_foreign_keys(spark):
    cons = spark.createDataFrame([
        ("S", "FK1", "ITEMS", "R", "S", "PK1", "CASCADE"),
        ("S", "PK1", "ORDERS", "P", None, None, None)],
        "owner string, constraint_name string, table string, constraint_type string, "
        "r_owner string, r_constraint_name string, delete_rule string")
    cols = spark.createDataFrame([
        ("S", "FK1", "ITEMS", "O_ID", 1), ("S", "FK1", "ITEMS", "O_LINE", 2),
        ("S", "PK1", "ORDERS", "ID", 1), ("S", "PK1", "ORDERS", "LINE", 2)],
        "owner string, constraint_name string, table string, column_name string, position int")
    r = assemble_foreign_keys_positional(cons, cols).collect()[0]
    assert (r.columns, r.referenced_table, r.referenced_columns) == (
        ["O_ID", "O_LINE"], "ORDERS", ["ID", "LINE"])


def test_topology_drops_default_exchange(spark):
    ex = spark.createDataFrame([("", "/", "direct", True, False, False, None),
                                ("test-exchange", "/", "direct", True, False, False, None)],
                               "name string, vhost string, type string, durable boolean, "
                               "auto_delete boolean, internal boolean, arguments string")
    assert [r.name for r in normalise_topology(ex, "exchanges").collect()] == ["test-exchange"]


def test_mongodb_indexes(spark):
    df = spark.createDataFrame([("users", "_id_", ["_id"], None),
                                ("users", "email_1", ["email"], True),
                                ("users", "a_1_b_-1", ["a", "b"], None)],
                               "table string, name string, key_names array<string>, unique boolean")
    got = {r.name: (r.is_unique, r.is_primary) for r in normalise_indexes(df, "mongodb").collect()}
    assert got == {"_id_": (True, True), "email_1": (True, False), "a_1_b_-1": (False, False)}


def test_topics_and_configs(spark):
    parts = spark.createDataFrame([("test-users", p, [1]) for p in range(3)]
                                  + [("test-orders", p, [1]) for p in range(2)]
                                  + [("test-events", 0, [1])],
                                  "topic string, partition_id int, replicas array<int>")
    got = {r.topic: (r.partitions, r.replication_factor) for r in topic_rollup(parts).collect()}
    assert got == {"test-users": (3, 1), "test-orders": (2, 1), "test-events": (1, 1)}
    cfg = spark.createDataFrame([("test-users", "retention.ms", "86400000", False),
                                 ("test-users", "cleanup.policy", "delete", False),
                                 ("test-users", "segment.ms", "1", True),
                                 ("test-users", "x", "", False)],
                                "topic string, name string, value string, is_default boolean")
    assert dict(config_map(cfg).collect()[0].config) == {
        "retention.ms": "86400000", "cleanup.policy": "delete"}


def test_cache_totals_sum_all_servers(spark):
    stats = spark.createDataFrame([("a", 10), ("b", 5)], "server string, curr_items bigint")
    r = cache_totals(stats).collect()[0]
    assert (r.pattern, r["count"]) == ("*", 15)


def test_flatten_mapping(spark):
    m = ('{"properties": {"title": {"type": "text", "analyzer": "english", '
         '"fields": {"raw": {"type": "keyword"}, "x": {}}}, '
         '"user": {"properties": {"name": {"type": "text"}, "email": {"type": "keyword"}}}}}')
    df = spark.createDataFrame([("test-nested", m)], "index string, mapping string")
    got = {r.path: (r.type, r.comment) for r in flatten_mapping(df).collect()}
    assert got == {"title": ("text", "Analyzer: english"), "title.raw": ("keyword", None),
                   "title.x": ("unknown", None), "user": ("object", None),
                   "user.name": ("text", None), "user.email": ("keyword", None)}


def test_unique_and_foreign_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, k string")
    got = {r.columns: (r.rows, r.distinct_rows, r.has_null, r.is_unique)
           for r in unique_keys(df, [["id"], ["k"]]).collect()}
    assert got == {"id": (3, 3, False, True), "k": (3, 2, True, False)}
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1,), (1,), (5,), (None,)], "pid int")
    r = check_foreign_key(child, ["pid"], parent, ["id"]).collect()[0]
    assert (r.child_rows, r.null_rows, r.orphan_rows, r.holds) == (4, 1, 1, False)


def test_same_names_in_two_databases(spark):
    rows = spark.createDataFrame([("db1", "users", "PRIMARY", "id", 1), ("db2", "users", "PRIMARY", "uid", 1),
                                  (None, "users", "PRIMARY", "x", 1)],
                                 "database string, table string, index_name string, column_name string, seq int") \
        .selectExpr("*", "0 AS non_unique", "'BTREE' AS index_type")
    got = sorted((str(r.database), r["columns"]) for r in assemble_indexes(rows).collect())
    assert got == [("None", ["x"]), ("db1", ["id"]), ("db2", ["uid"])]
    headers = rows.selectExpr("database", "table", "index_name", "array(1) AS indkey", "true AS is_unique", "index_type")
    numbers = rows.selectExpr("database", "table", "1 AS attnum", "column_name")
    constraints = rows.where("database = 'db1'").selectExpr(
        "database", "table", "index_name AS constraint_name", "'PRIMARY KEY' AS constraint_type")
    got = sorted((str(r.database), r["columns"], r.is_primary) for r in join_index_columns(headers, numbers, constraints).collect())
    assert got == [("None", ["x"], False), ("db1", ["id"], True), ("db2", ["uid"], False)]
    listed = spark.createDataFrame([("db1", "t", "p", ["a"], True, True, ""), ("db2", "t", "i", ["a"], True, False, "")],
                                   "database string, table string, name string, columns array<string>, is_unique boolean, "
                                   "is_primary boolean, type string")
    primary = spark.createDataFrame([("db1", "t", ["k"]), ("db2", "t", ["k"])], "database string, table string, columns array<string>")
    got = sorted((r.database, r.name) for r in normalise_indexes(listed, "sqlite", primary).collect())
    assert got == [("db1", "p"), ("db2", "PRIMARY"), ("db2", "i")]


def test_same_named_foreign_keys_of_two_tables(spark):
    usage = spark.createDataFrame([("s", "t1", "fk", "c1", 1, "r", "x"), ("s", "t2", "fk", "c2", 1, "r", "y")],
                                  "schema string, table string, constraint_name string, column_name string, ordinal int, "
                                  "referenced_table string, referenced_column string")
    rules = spark.createDataFrame([("s", "fk", "CASCADE", "CASCADE")] * 2,
                                  "schema string, constraint_name string, update_rule string, delete_rule string")
    got = sorted((r.table, r["columns"]) for r in assemble_foreign_keys(usage, rules).collect())
    assert got == [("t1", ["c1"]), ("t2", ["c2"])]


def test_column_names_with_any_characters(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "`a{b}` int, `c``d.e` string")
    got = {r["column"]: (r.non_null, r.nulls, r.max_length) for r in column_profile(df).collect()}
    assert got == {"a{b}": (2, 0, None), "c`d.e": (1, 1, 1)}
    keys = {r["columns"]: (r.rows, r.distinct_rows, r.has_null, r.is_unique)
            for r in unique_keys(df, [["a{b}", "c`d.e"], ["c`d.e", "a{b}"], ["a{b}"], ["c`d.e"]]).collect()}
    assert keys == {"a{b}, c`d.e": (2, 2, True, False), "c`d.e, a{b}": (2, 2, True, False),
                    "a{b}": (2, 2, False, True), "c`d.e": (2, 2, True, False)}
    empty = [tuple(r) for r in unique_keys(df.limit(0), [["a{b}"]]).collect()]
    assert empty == [("a{b}", 0, 0, False, True)]


def test_storage_counts_empty_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0).coalesce(1).write.parquet(path)
    r = storage_stats({"t": path}, spark).first()
    assert r.total_rows == 0 and r.total_bytes > 0


def test_unparsable_mappings_are_listed(spark):
    df = spark.createDataFrame([("a", "{bad"), ("b", '{"properties":{"x":{},"y":{"type":"text","fields":{"raw":{}}}}}'), ("c", None)],
                               "index string, mapping string")
    assert [r["index"] for r in unparsable_mappings(df).collect()] == ["a"]
    assert sorted((r["index"], r.path, r.type) for r in flatten_mapping(df).collect()) == [
        ("b", "x", "object"), ("b", "y", "text"), ("b", "y.raw", "unknown")]

import os
import subprocess
import sys

import pytest
import os


from shapelens.operators.render import (collection_lines, nest_table_details, render_database,
                                        render_listing, render_objects, render_table_details,
                                        read_markdown, write_markdown)


def _tables(spark):
    tables = spark.createDataFrame([("users", None, "User accounts", 100),
                                    ("orders", None, None, None)],
                                   "table string, schema string, comment string, row_count bigint")
    cols = spark.createDataFrame([
        ("users", 1, "id", "INT", False, None, None, True, True),
        ("users", 2, "email", "VARCHAR(255)", False, None, "User email address", False, False)],
        "table string, ordinal int, name string, type string, nullable boolean, "
        "default_value string, comment string, is_primary_key boolean, is_auto_increment boolean")
    idx = spark.createDataFrame([("users", "PRIMARY", ["id"], True, True, None),
                                 ("users", "idx_email", ["email"], True, False, None)],
                                "table string, name string, columns array<string>, "
                                "is_unique boolean, is_primary boolean, type string")
    fks = spark.createDataFrame([("orders", "fk_user", ["user_id"], "users", ["id"], "CASCADE",
                                  "RESTRICT")],
                                "table string, name string, columns array<string>, "
                                "referenced_table string, referenced_columns array<string>, "
                                "on_delete string, on_update string")
    return tables, cols, idx, fks


def _text(lines):
    """The whole document, for small ones."""
    return "\n".join(r.text for r in lines.orderBy("section", "sort_key").collect())


def test_table_blocks(spark):
    blocks = {r.sort_key: r.text for r in render_objects(nest_table_details(*_tables(spark)), "tables").collect()}
    users = blocks["users"].split("\n")
    for line in ["### Table: users", "**Description**: User accounts", "**Row Count**: 100",
                 "**Columns**:", "| Name | Type | Nullable | Default | Comment |",
                 "**Indexes**:", "- PRIMARY KEY: `PRIMARY` on (id)",
                 "- UNIQUE: `idx_email` on (email)", "**Foreign Keys**: None"]:
        assert line in users
    assert any(x.startswith("| **id** (PK) | INT AUTO_INCREMENT | NO |") for x in users)
    assert "| email | VARCHAR(255) | NO | - | User email address |" in users
    orders = blocks["orders"].split("\n")
    for line in ["**Foreign Keys**:", "- `fk_user`: (user_id) REFERENCES users(id)",
                 "  - ON DELETE: CASCADE", "  - ON UPDATE: RESTRICT"]:
        assert line in orders


def test_table_details_page(spark):
    page = render_table_details(*_tables(spark), "testdb", "users").collect()[0].text.split("\n")
    assert page[0] == "# Table: users" and "## Columns" in page and "## Indexes" in page
    missing = render_table_details(*_tables(spark), "testdb", "nope").collect()
    assert [r.text for r in missing] == ['Table "nope" not found in database "testdb".']


def test_collection_and_key_blocks(spark):
    profile = spark.createDataFrame(
        [("users", "_id", "ObjectId", 100, 100), ("users", "email", "string", 95, 100),
         ("users", "email", "null", 5, 100)],
        "collection string, path string, type string, type_pct int, occurrence_pct int")
    stats = spark.createDataFrame([("users", 1000, 100), ("empty", None, None)],
                                  "collection string, document_count bigint, sample_size bigint")
    indexes = spark.createDataFrame([("users", "_id_", [("_id", "1")], True)],
                                    "collection string, name string, keys array<struct<k:string,v:string>>, unique boolean")
    lines = collection_lines(profile, stats, indexes).orderBy("sort_key").collect()
    text = "\n".join(r.text for r in lines).split("\n")
    assert text[:4] == ["### Collection: empty", "**Document Count**: unknown", "", "---"]
    for line in ["### Collection: users", "**Document Count**: 1,000",
                 "**Fields** (inferred from 100 samples):", "| _id | ObjectId (100%) | 100% |",
                 "| email | string (95%), null (5%) | 100% |", "- `_id_` (UNIQUE): { _id: 1 }"]:
        assert line in text
    keys = spark.createDataFrame([("user:*", 1000, {"string": 800, "hash": 200},
                                   ["user:123", "user:456"])],
                                 "pattern string, count bigint, types map<string,bigint>, "
                                 "sample_keys array<string>")
    text = render_objects(keys, "key_patterns").collect()[0].text.split("\n")
    for line in ["### Pattern: user:*", "**Count**: 1,000", "**Types**:", "- string: 800",
                 "- hash: 200", "**Sample Keys**:", "- user:123"]:
        assert line in text


def test_database_document(spark, tmp_path):
    topics = spark.createDataFrame([("user-events", 3, 2, {"retention.ms": "604800000"})],
                                   "topic string, partitions bigint, replication_factor int, "
                                   "config map<string,string>")
    keys = spark.createDataFrame([("user:*", 1000, {"string": 1000}, ["user:1"]),
                                  ("session:*", 500, {"string": 500}, ["session:a"])],
                                 "pattern string, count bigint, types map<string,bigint>, "
                                 "sample_keys array<string>")
    total = spark.createDataFrame([(1500,)], "total bigint")
    lines = render_database({"topics": render_objects(topics, "topics"),
                             "key_patterns": render_objects(keys, "key_patterns")},
                            "kafka-cluster", "kafka", "Kafka", totals={"key_patterns": total})
    md = _text(lines)
    for s in ["# Database Schema: kafka-cluster", "**Database Type**: KAFKA", "## Topics (1)",
              "### Topic: user-events", "**Partitions**: 3", "**Replication Factor**: 2",
              "**Configuration**:", "- retention.ms: 604800000",
              "## Key Patterns (Total Keys: 1,500)"]:
        assert s in md
    assert md.index("### Pattern: user:*") < md.index("### Pattern: session:*")
    assert md.index("## Key Patterns") < md.index("## Topics")
    out = os.path.join(str(tmp_path), "doc")
    write_markdown(lines, out)
    back = [r.text for r in read_markdown(spark, out).orderBy("line").collect()]
    assert back == md.split("\n")
    empty = render_database({"topics": render_objects(topics.limit(0), "topics")}, "x", "redis")
    assert "**No schema data available**" in _text(empty)


def test_listing(spark):
    t = spark.createDataFrame([("users", "table", "accounts", 1234), ("q", "topic", None, None)],
                              "name string, type string, comment string, row_count bigint")
    lines = [r.text for r in render_listing(t, "db").orderBy("sort_key").collect()]
    assert lines == ["# Tables in db", "", "Found 2 table(s):", "",
                     "- **q** (topic)", "- **users**: accounts [1,234 rows]"]


def test_null_values_keep_their_lines(spark):
    tables, cols, idx, fks = _tables(spark)
    nulls = cols.selectExpr("table", "ordinal", "CAST(NULL AS STRING) AS name", "CAST(NULL AS STRING) AS type",
                            "CAST(NULL AS BOOLEAN) AS nullable", "default_value", "CAST(NULL AS STRING) AS comment",
                            "CAST(NULL AS BOOLEAN) AS is_primary_key", "is_auto_increment")
    blank = idx.selectExpr("table", "CAST(NULL AS STRING) AS name", "CAST(NULL AS ARRAY<STRING>) AS columns",
                           "is_unique", "is_primary", "type")
    text = render_table_details(tables, nulls, blank, fks, "db", "users").first().text
    assert "| unknown | unknown AUTO_INCREMENT | NO | - |  |" in text and "- UNIQUE: `unknown` on ()" in text
    kinds = {"topics": "topic string, partitions bigint, replication_factor int, config map<string,string>",
             "queues": "name string, durable boolean, auto_delete boolean, messages bigint, consumers bigint",
             "exchanges": "name string, type string, durable boolean, auto_delete boolean, internal boolean",
             "indices": "name string, health string, status string, docs_count bigint, store_size string, "
                        "primary_shards int, replica_shards int",
             "prefixes": "prefix string, depth int, count bigint, sample_keys array<string>",
             "key_patterns": "pattern string, count bigint, types map<string,bigint>, sample_keys array<string>",
             "views": "name string, schema string, definition string, comment string",
             "routines": "name string, schema string, return_type string, definition string"}
    for kind, ddl in kinds.items():
        n = ddl.count(",") + 1 - ddl.count("map<")
        full = spark.createDataFrame([(None,) * n], ddl)
        row = render_objects(full, kind).first()
        assert row.sort_key is not None and "unknown" in row.text, kind


def test_same_names_in_two_schemas(spark):
    tables = spark.createDataFrame([("a", "t", None, 1), ("b", "t", None, 2)],
                                   "schema string, table string, comment string, row_count bigint")
    cols = spark.createDataFrame([("a", "t", 1, "x"), ("b", "t", 1, "y")], "schema string, table string, ordinal int, name string") \
        .selectExpr("*", "'int' AS type", "true AS nullable", "'' AS default_value", "'' AS comment",
                    "false AS is_primary_key", "false AS is_auto_increment")
    idx = spark.createDataFrame([("a", "t", "i", ["x"]), ("b", "t", "i", ["y"])],
                                "schema string, table string, name string, columns array<string>") \
        .selectExpr("*", "true AS is_unique", "false AS is_primary", "'' AS type")
    fks = spark.createDataFrame([], "schema string, table string, name string, columns array<string>, referenced_table string, "
                                    "referenced_columns array<string>, on_delete string, on_update string")
    got = {r.schema: ([c.name for c in r.columns], [i["columns"] for i in r.indexes])
           for r in nest_table_details(tables, cols, idx, fks).collect()}
    assert got == {"a": (["x"], [["x"]]), "b": (["y"], [["y"]])}
    page = render_table_details(tables, cols, idx, fks, "db", "t", "b").collect()
    assert len(page) == 1 and "| y |" in page[0].text


def test_a_lost_or_repeated_part_is_an_error(spark, tmp_path):
    """Each way a task's file can go wrong after or while the document is written."""
    lines = spark.range(5000).selectExpr("CAST(id % 12 AS INT) AS section", "lpad(id, 6, '0') AS sort_key",
                                         "CASE WHEN id % 9 = 0 THEN 'two\\nlines' WHEN id % 7 > 0 THEN concat('line ', id) END AS text")
    want = [t for r in lines.orderBy("section", "sort_key").collect() for t in (r.text or "").split("\n")]
    out = f"{tmp_path}/doc"
    for _ in range(2):  # written again, it is replaced
        write_markdown(lines, out)
        assert [r.text for r in read_markdown(spark, out).orderBy("line").collect()] == want
    files = sorted(str(f) for f in (tmp_path / "doc" / "document").rglob("part-*.txt"))
    assert len(files) >= 12
    with open(files[3]) as f:
        body = f.read()
    for bad in ("", body + body, body.replace("line", "lime")):
        with open(files[3], "w") as f:
            f.write(bad)
        with pytest.raises(Exception, match="lost, added or changed|checksum|Checksum"):
            read_markdown(spark, out)


def test_a_failed_task_runs_again(tmp_path):
    """Tasks that fail at first, in a session that tries them again: every line once, in order."""
    code = f"""
import os, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession, functions as F
from shapelens.operators.render import read_markdown, write_markdown
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
def fails_once(batches):
    from pyspark import TaskContext
    for n, b in enumerate(batches):
        yield b
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2:
        raise RuntimeError("lost")
lines = spark.range(0, 2000, 1, 4).selectExpr("lpad(id, 6, '0') AS sort_key", "concat('line ', id) AS text")
write_markdown(lines.mapInArrow(fails_once, lines.schema), {str(tmp_path / "again")!r})
got = [r.text for r in read_markdown(spark, {str(tmp_path / "again")!r}).orderBy("line").collect()]
print("whole" if got == [f"line {{i}}" for i in range(2000)] else "broken")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]

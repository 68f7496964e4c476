"""Checked queries for object statistics and lake-table profiles
(O-15, O-24..O-30, O-38..O-42)."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from shapelens.functions.values import extract_version, format_bytes
from shapelens.operators.objects import (cache_totals, config_map, flatten_mapping,
                                         object_counts, row_counts, storage_stats,
                                         topic_rollup, vector_profile)
from shapelens.operators.tables import (check_foreign_key, column_profile, column_ranges, column_sketches,
                                        inclusions, merge_sketches, minimal_keys, unique_keys)
from shapelens.plans.registry import duck_sql, query, spark_sql
from shapelens.session import TESTDATA_TABLES, read_table, union_all

# Column names and Spark type names of the testdata tables (for the oracle of
# column_profile, which cannot ask DuckDB for Spark's type names).
TESTDATA_COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
}


@query("topic_rollup", """
SELECT event_type AS topic, CAST(count(*) AS BIGINT) AS partitions,
       CAST(arg_min(1 + event_id % 3, event_id) AS INTEGER) AS replication_factor
FROM events GROUP BY event_type
""")
def q_topic_rollup(spark, sf):
    ev = read_table(spark, sf, "events")
    parts = ev.select(F.col("event_type").alias("topic"),
                      F.col("event_id").alias("partition_id"),
                      F.sequence(F.lit(1), (1 + F.col("event_id") % 3).cast("int"))
                      .alias("replicas"))
    return topic_rollup(parts)


TOPIC_CONFIGS = """
SELECT event_type AS topic, concat('c', CAST(user_id % 5 AS STRING)) AS name,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(event_id % 13 AS STRING) END AS value,
  event_id % 4 = 0 AS is_default
FROM {events}"""


@query("config_map", f"""
WITH k AS (SELECT topic, name, max(value) AS value FROM ({duck_sql(TOPIC_CONFIGS)})
           WHERE NOT coalesce(is_default, false) AND coalesce(value, '') <> ''
           GROUP BY topic, name)
SELECT topic, string_agg(name || ': ' || value, ', ' ORDER BY name) AS config
FROM k GROUP BY topic
""")
def q_config_map(spark, sf):
    cfg = config_map(spark_sql(spark, sf, TOPIC_CONFIGS))
    return cfg.select("topic", F.array_join(F.transform(
        F.sort_array(F.map_entries("config")),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ").alias("config"))


def _all_tables(spark, sf):
    return {t: read_table(spark, sf, t) for t in TESTDATA_TABLES}


@query("row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table, CAST(count(*) AS BIGINT) AS row_count FROM {t}"
    for t in TESTDATA_TABLES))
def q_row_counts(spark, sf):
    return row_counts(_all_tables(spark, sf))


@query("object_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS kind, CAST(count(*) AS BIGINT) AS count FROM {t} HAVING count(*) > 0"
    for t in TESTDATA_TABLES))
def q_object_counts(spark, sf):
    return object_counts(_all_tables(spark, sf))


@query("cache_totals", """
SELECT '*' AS pattern, CAST(coalesce(sum(s_nationkey), 0) AS BIGINT) AS count,
       'N/A (Memcached does not support key enumeration)' AS note
FROM supplier
""")
def q_cache_totals(spark, sf):
    stats = read_table(spark, sf, "supplier").select(
        F.col("s_name").alias("server"), F.col("s_nationkey").alias("curr_items"))
    return cache_totals(stats)


def table_paths(sf: str) -> dict[str, str]:
    return {t: os.path.join(sf, f"{t}.parquet") for t in TESTDATA_TABLES}


@query("storage_stats")
def q_storage_stats(spark, sf):
    return storage_stats(table_paths(sf), spark)


@query("storage_rows", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS total_rows FROM {t}" for t in TESTDATA_TABLES))
def q_storage_rows(spark, sf):
    return storage_stats(table_paths(sf), spark).select("table", "total_rows")


def _duck_format_bytes(x: str) -> str:
    e = (f"(CASE WHEN {x} >= 1024.0^4 THEN 4 WHEN {x} >= 1024.0^3 THEN 3 "
         f"WHEN {x} >= 1024.0^2 THEN 2 WHEN {x} >= 1024.0 THEN 1 ELSE 0 END)")
    v = f"(floor({x} / pow(1024.0, {e}) * 100 + 0.5) / 100)"
    text = (f"regexp_replace(regexp_replace(printf('%.2f', {v}), '(\\.[0-9]*?)0+$', '\\1'), "
            f"'\\.$', '')")
    unit = f"(['B', 'KB', 'MB', 'GB', 'TB'])[{e} + 1]"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN '0 B' "
            f"ELSE {text} || ' ' || {unit} END")


@query("format_bytes", f"""
SELECT p_partkey AS id, CAST(p_retailprice * 1000 AS BIGINT) AS bytes,
       {_duck_format_bytes('CAST(CAST(p_retailprice * 1000 AS BIGINT) AS DOUBLE)')} AS size_text
FROM part
UNION ALL
SELECT page_id AS id, CAST(length(html) AS BIGINT) * 4099 AS bytes,
       {_duck_format_bytes('CAST(CAST(length(html) AS BIGINT) * 4099 AS DOUBLE)')} AS size_text
FROM pages
""")
def q_format_bytes(spark, sf):
    part = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 1000).cast("bigint").alias("bytes"))
    pages = read_table(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        (F.length("html").cast("bigint") * 4099).alias("bytes"))
    both = part.unionByName(pages)
    return both.select("id", "bytes", format_bytes(F.col("bytes")).alias("size_text"))


@query("vector_profile", """
SELECT CAST(count(vec_id) AS BIGINT) AS entities,
  CASE WHEN min(len(embedding)) = max(len(embedding)) THEN min(len(embedding)) END AS dimension,
  min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
  CAST(count(*) FILTER (WHERE embedding IS NULL) AS BIGINT) AS null_vectors
FROM embeddings
""")
def q_vector_profile(spark, sf):
    return vector_profile(read_table(spark, sf, "embeddings"), "vec_id", "embedding")


MAPPINGS = """
SELECT n_name AS index, concat('{{"properties": {{',
  '"id": {{"type": "integer"}}, ',
  '"name": {{"type": "text"',
    CASE WHEN n_nationkey % 2 = 0 THEN ', "analyzer": "standard"' ELSE '' END,
    CASE WHEN n_nationkey % 3 = 0
         THEN ', "fields": {{"raw": {{"type": "keyword"}}, "alt": {{}}}}' ELSE '' END, '}}, ',
  '"region": {{',
    CASE WHEN n_regionkey % 2 = 0 THEN '"type": "nested", ' ELSE '' END,
    '"properties": {{"code": {{"type": "keyword"}}, "r', CAST(n_regionkey AS STRING),
    '": {{"properties": {{"deep": {{"type": "long"}}}}}}}}}}',
  CASE WHEN n_nationkey % 4 = 0 THEN ', "created": {{"type": "date"}}' ELSE '' END,
  '}}}}') AS mapping
FROM {nation}"""


@query("flatten_mapping", f"""
WITH m AS ({duck_sql(MAPPINGS)}),
t AS (SELECT m.index, j.fullkey AS fullkey, j.path AS parent, j.type AS jtype,
             j.value AS spec
      FROM m, json_tree(m.mapping) j)
SELECT index,
  replace(replace(substr(fullkey, 3), 'properties.', ''), 'fields.', '') AS path,
  CASE WHEN parent LIKE '%.fields' THEN coalesce(json_extract_string(spec, '$.type'), 'unknown')
       ELSE coalesce(json_extract_string(spec, '$.type'), 'object') END AS type,
  true AS nullable,
  CASE WHEN parent LIKE '%.fields' THEN NULL
       ELSE 'Analyzer: ' || json_extract_string(spec, '$.analyzer') END AS comment
FROM t
WHERE jtype = 'OBJECT' AND (parent LIKE '%.properties' OR parent LIKE '%.fields')
""")
def q_flatten_mapping(spark, sf):
    return flatten_mapping(spark_sql(spark, sf, MAPPINGS), "index", "mapping")


INFO_TEXT = """
SELECT s_suppkey AS id,
  CASE WHEN s_suppkey % 5 = 0 THEN concat('# Server', chr(13), chr(10), 'os:Linux')
       ELSE concat('# Server', chr(13), chr(10), 'redis_version:',
                   CAST(s_suppkey % 7 AS STRING), '.', CAST(s_nationkey AS STRING), '.',
                   substr(s_name, 10, 3), chr(13), chr(10), 'os:Linux') END AS info
FROM {supplier}"""


@query("extract_version", f"""
SELECT id, CASE WHEN regexp_extract(info, 'redis_version:([^\\r\\n]+)', 1) <> ''
                THEN 'Redis ' || regexp_extract(info, 'redis_version:([^\\r\\n]+)', 1) END
           AS version
FROM ({duck_sql(INFO_TEXT)})
""")
def q_extract_version(spark, sf):
    info = spark_sql(spark, sf, INFO_TEXT)
    return info.select("id", extract_version(F.col("info")).alias("version"))


@query("check_foreign_key", """
SELECT CAST(count(*) AS BIGINT) AS child_rows,
  CAST(count(*) FILTER (WHERE l_orderkey IS NULL) AS BIGINT) AS null_rows,
  CAST(count(*) FILTER (WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN
       (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)) AS BIGINT) AS orphan_rows,
  count(*) FILTER (WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN
       (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)) = 0 AS holds
FROM lineitem
""")
def q_check_foreign_key(spark, sf):
    return check_foreign_key(read_table(spark, sf, "lineitem"), ["l_orderkey"],
                             read_table(spark, sf, "orders"), ["o_orderkey"])


@query("check_foreign_key_events", """
SELECT CAST(count(*) AS BIGINT) AS child_rows,
  CAST(count(*) FILTER (WHERE user_id IS NULL) AS BIGINT) AS null_rows,
  CAST(count(*) FILTER (WHERE user_id IS NOT NULL AND user_id NOT IN
       (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)) AS BIGINT) AS orphan_rows,
  count(*) FILTER (WHERE user_id IS NOT NULL AND user_id NOT IN
       (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)) = 0 AS holds
FROM events
""")
def q_check_foreign_key_events(spark, sf):
    return check_foreign_key(read_table(spark, sf, "events"), ["user_id"],
                             read_table(spark, sf, "supplier"), ["s_suppkey"])


def _profile_oracle() -> str:
    parts = []
    for t, cols in TESTDATA_COLUMNS.items():
        for c, typ in cols:
            ml = (f"CAST(max(length({c})) AS INTEGER)" if typ == "string"
                  else "CAST(NULL AS INTEGER)")
            parts.append(
                f"SELECT '{t}' AS table, '{c}' AS column, '{typ}' AS type, "
                f"CAST(count({c}) AS BIGINT) AS non_null, "
                f"CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
                f"count(*) - count({c}) > 0 AS nullable, {ml} AS max_length FROM {t}")
    return "\nUNION ALL\n".join(parts)


@query("column_profile", _profile_oracle())
def q_column_profile(spark, sf):
    return union_all([column_profile(read_table(spark, sf, t), approx=False)
                      .select(F.lit(t).alias("table"), "*") for t in TESTDATA_COLUMNS])


def _sketches(spark, sf):
    """Sketches of every table, in four parts each by a hash of the first column."""
    return union_all([column_sketches(df, F.pmod(F.xxhash64(df.columns[0]), F.lit(4))).select(F.lit(t).alias("table"), "*")
                      for t, df in _all_tables(spark, sf).items()])


@query("column_profile_approx")
def q_column_profile_approx(spark, sf):
    return merge_sketches(_sketches(spark, sf), ["table"])


#: Largest difference of an estimate from the exact number of distinct values.
SKETCH_ERROR = 0.03


@query("column_sketch_errors", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table, '{c}' AS column, CAST(count({c}) AS BIGINT) AS non_null, CAST(count(DISTINCT {c}) AS BIGINT) AS exact, "
    f"true AS within FROM {t}" for t, cols in TESTDATA_COLUMNS.items() for c, _ in cols))
def q_column_sketch_errors(spark, sf):
    """Merged sketches against exact counts: every estimate is within 3 %."""
    exact = union_all([df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("h"))
                                                    for c in df.columns]))).distinct().groupBy("column").agg(F.count("h").alias("exact"))
                       .select(F.lit(t).alias("table"), "*") for t, df in _all_tables(spark, sf).items()])
    both = merge_sketches(_sketches(spark, sf), ["table"]).join(exact, ["table", "column"])
    near = F.abs(F.col("distinct_approx") - F.col("exact")) <= F.greatest(SKETCH_ERROR * F.col("exact"), F.lit(0.5))
    return both.select("table", "column", "non_null", "exact", near.alias("within"))


def _range_oracle() -> str:
    number = ("int", "bigint", "double")
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table, '{c}' AS column, CAST(count(*) AS BIGINT) AS rows, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max FROM {t}" for t, cols in TESTDATA_COLUMNS.items() for c, typ in cols if typ in number)


@query("column_ranges", _range_oracle())
def q_column_ranges(spark, sf):
    return column_ranges(table_paths(sf), spark)


#: Tables without long texts and vectors.
KEYED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")


def _minimal_keys_oracle() -> str:
    sets = [(t, s) for t in KEYED for n in (1, 2, 3) for s in combinations([c for c, _ in TESTDATA_COLUMNS[t]], n)]
    tests = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS t, [{', '.join(repr(c) for c in s)}] AS s, (SELECT count(*) = count(DISTINCT ({', '.join(s)})) "
        f"AND {' AND '.join(f'count({c}) = count(*)' for c in s)} FROM {t}) AS u" for t, s in sets)
    return f"""
WITH k AS (SELECT * FROM ({tests}) WHERE u)
SELECT t AS table, array_to_string(s, ', ') AS columns, CAST(len(s) AS INTEGER) AS n_columns FROM k
WHERE NOT EXISTS (SELECT 1 FROM k AS o WHERE o.t = k.t AND len(o.s) < len(k.s) AND list_has_all(k.s, o.s))
"""


@query("minimal_keys", _minimal_keys_oracle())
def q_minimal_keys(spark, sf):
    """The tables' searches start their jobs side by side: most are short."""
    with ThreadPoolExecutor(len(KEYED)) as pool:
        found = pool.map(inheritable_thread_target(spark)(lambda t: minimal_keys(read_table(spark, sf, t))), KEYED)
        return union_all([df.select(F.lit(t).alias("table"), "columns", "n_columns") for t, df in zip(KEYED, found)])


def _inclusion_oracle() -> str:
    parts = "\nUNION ALL\n".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{typ == 'string'}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, cols in TESTDATA_COLUMNS.items() for c, typ in cols if typ in ("int", "bigint", "string"))
    return f"""
WITH v AS MATERIALIZED ({parts}),
n AS (SELECT t, c, kind, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, count(*) AS n FROM v a JOIN v b ON a.kind = b.kind AND a.v = b.v
      WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT p.t AS child_table, p.c AS child_column, p.pt AS parent_table, p.pc AS parent_column,
       CAST(n.n AS BIGINT) AS child_values, CAST(m.n AS BIGINT) AS parent_values
FROM p JOIN n ON p.t = n.t AND p.c = n.c AND p.n = n.n JOIN n m ON p.pt = m.t AND p.pc = m.c
"""


@query("inclusions", _inclusion_oracle())
def q_inclusions(spark, sf):
    return inclusions(_all_tables(spark, sf))


UNIQUE_CANDIDATES = [
    ("orders", [["o_orderkey"], ["o_custkey"], ["o_custkey", "o_orderdate"]]),
    ("lineitem", [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey"]]),
    ("customer", [["c_custkey"], ["c_name"]]),
]


def _unique_oracle() -> str:
    parts = []
    for t, cands in UNIQUE_CANDIDATES:
        for cols in cands:
            label = f"{t}({', '.join(cols)})"
            keys = ", ".join(cols)
            null = " OR ".join(f"{c} IS NULL" for c in cols)
            parts.append(
                f"SELECT '{label}' AS columns, CAST(sum(n) AS BIGINT) AS rows, "
                f"CAST(count(*) AS BIGINT) AS distinct_rows, coalesce(bool_or(nul), false) "
                f"AS has_null, coalesce(max(n), 0) <= 1 AND NOT coalesce(bool_or(nul), false) "
                f"AS is_unique FROM (SELECT count(*) AS n, bool_or({null}) AS nul "
                f"FROM {t} GROUP BY {keys})")
    return "\nUNION ALL\n".join(parts)


@query("unique_keys", _unique_oracle())
def q_unique_keys(spark, sf):
    return union_all([unique_keys(read_table(spark, sf, t), cands, table=t)
                      for t, cands in UNIQUE_CANDIDATES])

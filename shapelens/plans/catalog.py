"""Checked catalogue queries (O-03, O-05..O-14, O-16, O-17, O-49).

Catalogue dumps are shape-mapped from testdata tables: the names mean nothing,
the sizes, groups, ties and nulls are real. Arrays are rendered as text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shapelens.operators.catalog import (VECTOR_TYPE_NAMES, assemble_foreign_keys,
                                         assemble_foreign_keys_positional,
                                         assemble_indexes, attach_comments,
                                         distinct_indexes, flag_primary_keys,
                                         foreign_keys_from_lists,
                                         join_index_columns, list_routines,
                                         list_tables, list_views, normalise_columns,
                                         normalise_indexes, normalise_search_indices,
                                         normalise_topology, place_of)
from shapelens.plans.registry import ORACLES, QUERIES, duck_sql, query, spark_sql
from shapelens.session import read_table

COLUMN_DUMPS = {
    "mysql": """
SELECT p_brand AS table_name, CAST(p_partkey AS INT) AS ordinal_position,
  p_name AS column_name, p_type AS column_type,
  CASE WHEN p_partkey % 3 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS column_default,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS column_comment,
  CASE WHEN p_size % 7 = 0 THEN 'PRI' WHEN p_size % 7 = 1 THEN 'UNI' ELSE '' END AS column_key,
  CASE WHEN p_partkey % 6 = 0 THEN 'auto_increment' ELSE '' END AS extra,
  CAST(p_size % 4 * 64 AS BIGINT) AS character_maximum_length
FROM {part}""",
    "postgresql": """
SELECT p_brand AS table_name, CAST(p_partkey AS INT) AS ordinal_position,
  p_name AS column_name, p_type AS data_type,
  CASE WHEN p_partkey % 3 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('nextval(', p_brand, '_seq)')
       ELSE CAST(p_size AS STRING) END AS column_default,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS comment,
  p_size % 7 = 0 AS is_primary_key,
  CAST(p_size % 4 * 64 AS BIGINT) AS character_maximum_length
FROM {part}""",
    "opengauss": """
SELECT p_brand AS table_name, CAST(p_partkey AS INT) AS ordinal_position,
  p_name AS column_name, p_type AS data_type,
  CASE WHEN p_partkey % 3 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS column_default,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS comment,
  CAST(p_size % 4 * 64 AS BIGINT) AS character_maximum_length
FROM {part}""",
    "sqlite": """
SELECT p_brand AS table_name, CAST(p_partkey AS INT) AS cid, p_name AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'integer' ELSE p_type END AS type,
  CAST(p_partkey % 2 AS INT) AS notnull,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CAST(p_size AS STRING) END
    AS dflt_value,
  CAST(p_size % 3 AS INT) AS pk
FROM {part}""",
    "oracle": """
SELECT p_brand AS table_name, CAST(p_partkey AS INT) AS column_id, p_name AS column_name,
  p_type AS data_type,
  CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS data_length,
  CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'Y' END AS nullable,
  CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat(' ', p_brand, ' ') END
    AS data_default,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS comments,
  CASE WHEN p_size % 7 = 0 THEN 'Y' ELSE 'N' END AS is_primary
FROM {part}""",
    "clickhouse": """
SELECT p_brand AS table, CAST(p_partkey AS INT) AS position, p_name AS name,
  CASE WHEN p_partkey % 3 = 0 THEN concat('Nullable(', p_type, ')') ELSE p_type END AS type,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('now_', p_brand) END AS default_expression,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS comment
FROM {part}""",
    "milvus": """
SELECT p_brand AS collection, CAST(p_partkey AS INT) AS field_id, p_name AS name,
  CASE p_partkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 101 WHEN 2 THEN 21 WHEN 3 THEN 10
       WHEN 4 THEN 999 ELSE 100 END AS data_type,
  CASE WHEN p_partkey % 6 IN (1, 5) THEN p_size ELSE NULL END AS dim,
  p_partkey % 50 = 0 AS is_primary_key,
  p_size % 2 = 0 AS auto_id,
  p_type AS description
FROM {part}""",
}

# The same table names in two databases with two schemas each.
COLUMN_DUMPS = {k: v.replace("\nFROM {part}", """,
  concat('db', CAST(p_partkey % 2 AS STRING)) AS database,
  concat('s', CAST(p_size % 2 AS STRING)) AS schema
FROM {part}""") for k, v in COLUMN_DUMPS.items()}

_VECTOR_NAME = ("CASE data_type " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in VECTOR_TYPE_NAMES.items())
    + " ELSE 'Unknown(' || CAST(data_type AS VARCHAR) || ')' END")

COLUMN_ORACLES = {
    "mysql": """
SELECT table_name AS table, ordinal_position AS ordinal, column_name AS name,
  column_type AS type, is_nullable = 'YES' AS nullable, column_default AS default_value,
  nullif(column_comment, '') AS comment, coalesce(column_key = 'PRI', false) AS is_primary_key,
  coalesce(contains(extra, 'auto_increment'), false) AS is_auto_increment,
  nullif(character_maximum_length, 0) AS max_length FROM d""",
    "postgresql": """
SELECT table_name AS table, ordinal_position AS ordinal, column_name AS name,
  data_type AS type, is_nullable = 'YES' AS nullable, column_default AS default_value,
  nullif(comment, '') AS comment, coalesce(is_primary_key, false) AS is_primary_key,
  coalesce(contains(column_default, 'nextval'), false) AS is_auto_increment,
  nullif(character_maximum_length, 0) AS max_length FROM d""",
    "opengauss": """
SELECT table_name AS table, ordinal_position AS ordinal, column_name AS name,
  data_type AS type, is_nullable = 'YES' AS nullable, column_default AS default_value,
  comment, false AS is_primary_key, false AS is_auto_increment,
  character_maximum_length AS max_length FROM d""",
    "sqlite": """
SELECT table_name AS table, cid AS ordinal, name, type, "notnull" = 0 AS nullable,
  nullif(dflt_value, '') AS default_value, CAST(NULL AS VARCHAR) AS comment,
  coalesce(pk = 1, false) AS is_primary_key,
  coalesce(pk = 1, false) AND upper(type) = 'INTEGER' AS is_auto_increment,
  CAST(NULL AS BIGINT) AS max_length FROM d""",
    "oracle": """
SELECT table_name AS table, column_id AS ordinal, column_name AS name,
  CASE WHEN coalesce(data_length, 0) <> 0
       THEN data_type || '(' || CAST(data_length AS VARCHAR) || ')' ELSE data_type END AS type,
  nullable = 'Y' AS nullable, nullif(trim(data_default), '') AS default_value,
  nullif(comments, '') AS comment, coalesce(is_primary = 'Y', false) AS is_primary_key,
  false AS is_auto_increment, CAST(NULL AS BIGINT) AS max_length FROM d""",
    "clickhouse": """
SELECT "table", position AS ordinal, name, type, contains(type, 'Nullable') AS nullable,
  nullif(default_expression, '') AS default_value, nullif(comment, '') AS comment,
  false AS is_primary_key, false AS is_auto_increment,
  CAST(NULL AS BIGINT) AS max_length FROM d""",
    "milvus": f"""
SELECT collection AS table, field_id AS ordinal, name,
  CASE WHEN coalesce(dim, 0) <> 0 THEN {_VECTOR_NAME} || '(' || CAST(dim AS VARCHAR) || ')'
       ELSE {_VECTOR_NAME} END AS type,
  NOT coalesce(is_primary_key, false) AS nullable, CAST(NULL AS VARCHAR) AS default_value,
  description AS comment, coalesce(is_primary_key, false) AS is_primary_key,
  coalesce(auto_id, false) AS is_auto_increment, CAST(NULL AS BIGINT) AS max_length FROM d""",
}


COLUMN_ORACLES = {k: v.replace("SELECT ", "SELECT database, schema, ", 1) for k, v in COLUMN_ORACLES.items()}


def _register_columns(dialect: str) -> None:
    template = COLUMN_DUMPS[dialect]

    @query(f"normalise_columns_{dialect}",
           f"WITH d AS ({duck_sql(template)}) {COLUMN_ORACLES[dialect]}")
    def q(spark, sf):
        return normalise_columns(spark_sql(spark, sf, template), dialect)


for _d in COLUMN_DUMPS:
    _register_columns(_d)


TABLE_LISTING = """
SELECT CASE WHEN p_partkey % 11 = 0 THEN concat('sqlite_', p_name)
            WHEN p_partkey % 13 = 0 THEN concat('.', p_name) ELSE p_name END AS name,
  p_brand AS schema,
  CASE p_partkey % 4 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'table' ELSE 'BASE TABLE' END AS table_type,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS comment,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS row_count
FROM {part}"""
_BASE = f"FROM ({duck_sql(TABLE_LISTING)}) WHERE upper(table_type) IN ('BASE TABLE', 'TABLE')"

# Listings of stores without base tables: the dump, and comment, type and row count as DuckDB text.
OBJECT_LISTINGS = {
    "mongodb": ("SELECT p_name AS name, CAST(p_size AS BIGINT) AS row_count FROM {part}",
                "collection", "CAST(NULL AS VARCHAR)", "row_count"),
    "milvus": ("SELECT p_name AS name, p_type AS comment, CAST(p_size AS BIGINT) AS row_count FROM {part}",
               "collection", "nullif(comment, '')", "row_count"),
    "kafka": ("SELECT concat('topic.', c_name) AS name FROM {customer}",
              "topic", "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)"),
    "rabbitmq": ("SELECT s_name AS name, CAST(s_nationkey AS BIGINT) AS row_count FROM {supplier}",
                 "queue", "CAST(NULL AS VARCHAR)", "row_count"),
    "redis": ("SELECT concat('user:', CAST(c_nationkey AS STRING), ':*') AS name, count(*) AS row_count "
              "FROM {customer} GROUP BY concat('user:', CAST(c_nationkey AS STRING), ':*')",
              "pattern", "CAST(NULL AS VARCHAR)", "row_count"),
    "etcd": ("SELECT concat('/', p_name, '/') AS name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END "
             "AS depth, CAST(p_partkey AS BIGINT) AS row_count FROM {part}",
             "prefix", "'Depth: ' || coalesce(CAST(depth AS VARCHAR), 'unknown')", "row_count"),
    "elasticsearch": ("SELECT concat('idx-', p_name) AS name, CASE p_partkey % 3 WHEN 0 THEN 'green' "
                      "WHEN 1 THEN 'red' END AS health, 'open' AS status, CAST(p_size AS BIGINT) AS row_count "
                      "FROM {part}", "index",
                      "'Health: ' || coalesce(health, 'unknown') || ', Status: ' || status", "row_count"),
    "clickhouse": ("SELECT CASE WHEN p_partkey % 13 = 0 THEN concat('.', p_name) ELSE p_name END AS name, "
                   "p_brand AS schema, p_type AS engine, CAST(p_size AS BIGINT) AS total_bytes, "
                   "CAST(p_partkey AS BIGINT) AS row_count FROM {part}", "table",
                   "'Engine: ' || engine || ', Size: ' || CAST(total_bytes AS VARCHAR) || ' B'", "row_count"),
}


def _register_listing(dialect: str, oracle: str, template: str) -> None:
    @query(f"list_tables_{dialect}", oracle)
    def q(spark, sf):
        return list_tables(spark_sql(spark, sf, template), dialect)


ORACLES["list_tables"] = f"""
SELECT name, schema, 'table' AS type, nullif(comment, '') AS comment,
       CAST(nullif(row_count, 0) AS BIGINT) AS row_count {_BASE}"""
QUERIES["list_tables"] = lambda spark, sf: list_tables(spark_sql(spark, sf, TABLE_LISTING))

for _d, _keep, _rows in (("mysql", "true", "nullif(row_count, 0)"), ("oracle", "true", "nullif(row_count, 0)"),
                         ("postgresql", "true", "row_count"), ("opengauss", "true", "NULL"),
                         ("sqlite", "NOT starts_with(name, 'sqlite_')", "NULL")):
    _register_listing(_d, f"""
SELECT name, schema, 'table' AS type, nullif(comment, '') AS comment,
       CAST({_rows} AS BIGINT) AS row_count {_BASE} AND {_keep}""", TABLE_LISTING)
for _d, (_t, _type, _comment, _rows) in OBJECT_LISTINGS.items():
    _schema = "schema" if "AS schema" in _t else "CAST(NULL AS VARCHAR)"
    _where = "WHERE NOT starts_with(name, '.')" if _d == "clickhouse" else ""
    _register_listing(_d, f"""
SELECT name, {_schema} AS schema, '{_type}' AS type, {_comment} AS comment, {_rows} AS row_count
FROM ({duck_sql(_t)}) {_where}""", _t)


VIEW_LISTING = """
SELECT concat('v', CAST(doc_id AS STRING)) AS name, lang AS schema,
  CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'VIEW' ELSE 'BASE TABLE' END AS kind,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS definition,
  source AS comment
FROM {documents}"""


@query("list_views", f"""
SELECT name, schema, coalesce(definition, '') AS definition, nullif(comment, '') AS comment
FROM ({duck_sql(VIEW_LISTING)}) WHERE upper(kind) = 'VIEW'
""")
def q_list_views(spark, sf):
    return list_views(spark_sql(spark, sf, VIEW_LISTING))


ROUTINE_LISTING = """
SELECT p_name AS name, p_brand AS schema,
  CASE p_partkey % 3 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'FUNCTION' ELSE 'PACKAGE' END
    AS routine_type,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS return_type,
  concat('BEGIN ', p_name, ' END') AS definition
FROM {part}"""


@query("list_routines", f"""
SELECT name, schema, nullif(return_type, '') AS return_type, definition
FROM ({duck_sql(ROUTINE_LISTING)}) WHERE upper(routine_type) IN ('PROCEDURE', 'FUNCTION')
""")
def q_list_routines(spark, sf):
    return list_routines(spark_sql(spark, sf, ROUTINE_LISTING), "oracle")


QUEUES = """
SELECT s_name AS name, '/' AS vhost, s_suppkey % 2 = 0 AS durable,
  s_suppkey % 3 = 0 AS auto_delete, false AS exclusive,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END AS messages,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 3 END AS consumers,
  concat('x-max-length=', CAST(s_nationkey AS STRING)) AS arguments
FROM {supplier}"""
EXCHANGES = """
SELECT CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS name, '/' AS vhost,
  CASE n_regionkey WHEN 0 THEN 'direct' WHEN 1 THEN 'topic' ELSE 'fanout' END AS type,
  n_nationkey % 2 = 0 AS durable, n_nationkey % 3 = 0 AS auto_delete,
  n_nationkey % 7 = 0 AS internal, CAST(NULL AS STRING) AS arguments
FROM {nation}"""
BINDINGS = """
SELECT n_name AS source, concat('q', CAST(n_regionkey AS STRING)) AS destination,
  'queue' AS destination_type, lower(n_name) AS routing_key,
  CAST(NULL AS STRING) AS arguments
FROM {nation}"""


@query("normalise_topology_queues", f"""
SELECT name, vhost, durable, auto_delete, exclusive,
  CAST(coalesce(messages, 0) AS BIGINT) AS messages,
  CAST(coalesce(consumers, 0) AS BIGINT) AS consumers, arguments
FROM ({duck_sql(QUEUES)})
""")
def q_topology_queues(spark, sf):
    return normalise_topology(spark_sql(spark, sf, QUEUES), "queues")


@query("normalise_topology_exchanges", f"""
SELECT name, vhost, type, durable, auto_delete, internal, arguments
FROM ({duck_sql(EXCHANGES)}) WHERE name <> ''
""")
def q_topology_exchanges(spark, sf):
    return normalise_topology(spark_sql(spark, sf, EXCHANGES), "exchanges")


@query("normalise_topology_bindings", f"""
SELECT source, destination, destination_type, routing_key, arguments
FROM ({duck_sql(BINDINGS)})
""")
def q_topology_bindings(spark, sf):
    return normalise_topology(spark_sql(spark, sf, BINDINGS), "bindings")


SEARCH_STATS = """
SELECT concat('idx-', CAST(o_orderkey AS STRING)) AS index,
  CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'yellow' ELSE 'red' END AS health,
  'open' AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS docs_count,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 10 AS STRING) END
    AS docs_deleted,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL
       ELSE concat(CAST(o_custkey % 900 AS STRING), 'kb') END AS store_size,
  CAST(o_orderkey % 5 + 1 AS STRING) AS pri,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE '1' END AS rep
FROM {orders}"""


def _duck_parse_int(x: str) -> str:
    return (f"CASE WHEN regexp_matches(coalesce({x}, '0'), '^\\s*[+-]?[0-9]+') THEN "
            f"CAST(regexp_extract(coalesce({x}, '0'), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) END")


@query("normalise_search_indices", f"""
SELECT index AS name, health, status,
  {_duck_parse_int('docs_count')} AS docs_count,
  {_duck_parse_int('docs_deleted')} AS docs_deleted,
  coalesce(store_size, '0b') AS store_size,
  CAST({_duck_parse_int('pri')} AS INTEGER) AS primary_shards,
  CAST({_duck_parse_int('rep')} AS INTEGER) AS replica_shards
FROM ({duck_sql(SEARCH_STATS)})
""")
def q_search_indices(spark, sf):
    return normalise_search_indices(spark_sql(spark, sf, SEARCH_STATS))


PK_COLUMNS = """
SELECT 'public' AS schema, CAST(l_orderkey AS STRING) AS table,
  concat('c', CAST(l_linenumber AS STRING)) AS name, l_partkey
FROM {lineitem}"""
PK_CONSTRAINTS = """
SELECT 'public' AS schema, concat('pk_', CAST(o_orderkey AS STRING)) AS constraint_name,
  CAST(o_orderkey AS STRING) AS table,
  CASE WHEN o_orderstatus = 'F' THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS constraint_type
FROM {orders}"""
PK_KEY_USAGE = """
SELECT 'public' AS schema, concat('pk_', CAST(o_orderkey AS STRING)) AS constraint_name,
  CAST(o_orderkey AS STRING) AS table,
  concat('c', CAST(o_orderkey % 7 + 1 AS STRING)) AS column_name
FROM {orders}
UNION ALL
SELECT 'public' AS schema, concat('pk_', CAST(o_orderkey AS STRING)) AS constraint_name,
  CAST(o_orderkey AS STRING) AS table,
  concat('c', CAST(o_custkey % 3 + 1 AS STRING)) AS column_name
FROM {orders}"""


@query("flag_primary_keys", f"""
WITH pk AS (
  SELECT DISTINCT tc.schema, tc.table, ku.column_name AS name
  FROM ({duck_sql(PK_CONSTRAINTS)}) tc
  JOIN ({duck_sql(PK_KEY_USAGE)}) ku
    ON tc.schema = ku.schema AND tc.constraint_name = ku.constraint_name
   AND tc.table = ku.table
  WHERE tc.constraint_type = 'PRIMARY KEY')
SELECT c.schema, c.table, c.name, c.l_partkey, pk.name IS NOT NULL AS is_primary_key
FROM ({duck_sql(PK_COLUMNS)}) c
LEFT JOIN pk ON c.schema = pk.schema AND c.table = pk.table AND c.name = pk.name
""")
def q_flag_primary_keys(spark, sf):
    return flag_primary_keys(spark_sql(spark, sf, PK_COLUMNS),
                             spark_sql(spark, sf, PK_CONSTRAINTS),
                             spark_sql(spark, sf, PK_KEY_USAGE))


# Two orders share a constraint name, in two schemas and in tables of their own.
FK_KEY_USAGE = """
SELECT concat('sales', CAST(l_orderkey % 4 AS STRING)) AS schema,
  concat('fk_', CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING)) AS constraint_name,
  concat('t', CAST(CAST(floor(l_orderkey / 4) AS BIGINT) AS STRING)) AS table,
  concat('c', CAST(l_partkey AS STRING)) AS column_name, l_linenumber AS ordinal,
  concat('ref', CAST(l_orderkey % 7 AS STRING)) AS referenced_table,
  concat('r', CAST(l_suppkey AS STRING)) AS referenced_column
FROM {lineitem}"""
FK_RULES = """
SELECT concat('sales', CAST(o_orderkey % 4 AS STRING)) AS schema,
  concat('fk_', CAST(CAST(floor(o_orderkey / 8) AS BIGINT) AS STRING)) AS constraint_name,
  concat('t', CAST(CAST(floor(o_orderkey / 4) AS BIGINT) AS STRING)) AS table,
  CASE o_orderstatus WHEN 'F' THEN 'CASCADE' WHEN 'O' THEN 'RESTRICT' ELSE 'NO ACTION' END
    AS update_rule,
  CASE WHEN o_orderkey % 2 = 0 THEN 'CASCADE' ELSE 'SET NULL' END AS delete_rule
FROM {orders}"""


def _fk_text(df):
    return df.select("schema", "table", "name",
                     F.array_join("columns", ", ").alias("columns"), "referenced_table",
                     F.array_join("referenced_columns", ", ").alias("referenced_columns"),
                     "on_delete", "on_update")


@query("assemble_foreign_keys", f"""
WITH j AS (SELECT k.*, r.update_rule, r.delete_rule
           FROM ({duck_sql(FK_KEY_USAGE)}) k JOIN ({duck_sql(FK_RULES)}) r
           ON k.schema = r.schema AND k."table" = r."table" AND k.constraint_name = r.constraint_name)
SELECT schema, "table", constraint_name AS name,
  string_agg(column_name, ', ' ORDER BY ordinal, column_name, referenced_column) AS columns,
  referenced_table,
  string_agg(referenced_column, ', ' ORDER BY ordinal, column_name, referenced_column)
    AS referenced_columns,
  delete_rule AS on_delete, update_rule AS on_update
FROM j GROUP BY schema, "table", constraint_name, referenced_table, delete_rule, update_rule
""")
def q_assemble_foreign_keys(spark, sf):
    return _fk_text(assemble_foreign_keys(spark_sql(spark, sf, FK_KEY_USAGE),
                                          spark_sql(spark, sf, FK_RULES)))


ORA_CONSTRAINTS = """
SELECT 'S' AS owner, concat('c', CAST(o_orderkey AS STRING)) AS constraint_name,
  concat('t', CAST(o_custkey AS STRING)) AS table,
  CASE WHEN o_orderkey % 2 = 0 THEN 'R' ELSE 'P' END AS constraint_type,
  'S' AS r_owner, concat('c', CAST(o_orderkey + 1 AS STRING)) AS r_constraint_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'CASCADE' ELSE 'NO ACTION' END AS delete_rule
FROM {orders}"""
ORA_CONS_COLUMNS = """
SELECT 'S' AS owner, concat('c', CAST(l_orderkey AS STRING)) AS constraint_name,
  concat('t', CAST(l_orderkey AS STRING)) AS table,
  concat('col', CAST(l_partkey AS STRING)) AS column_name, l_linenumber AS position
FROM {lineitem}"""


@query("assemble_foreign_keys_positional", f"""
WITH k AS ({duck_sql(ORA_CONSTRAINTS)}), cc AS ({duck_sql(ORA_CONS_COLUMNS)}),
j AS (
  SELECT k.owner AS schema, k.table, k.constraint_name, kc.column_name, kc.position AS ordinal,
         p.table AS referenced_table, pc.column_name AS referenced_column, k.delete_rule
  FROM k JOIN cc kc ON k.owner = kc.owner AND k.constraint_name = kc.constraint_name
  JOIN k p ON k.r_owner = p.owner AND k.r_constraint_name = p.constraint_name
  JOIN cc pc ON p.owner = pc.owner AND p.constraint_name = pc.constraint_name
            AND kc.position = pc.position
  WHERE k.constraint_type = 'R')
SELECT schema, "table", constraint_name AS name,
  string_agg(column_name, ', ' ORDER BY ordinal, column_name, referenced_column) AS columns,
  referenced_table,
  string_agg(referenced_column, ', ' ORDER BY ordinal, column_name, referenced_column)
    AS referenced_columns,
  delete_rule AS on_delete, CAST(NULL AS VARCHAR) AS on_update
FROM j GROUP BY schema, "table", constraint_name, referenced_table, delete_rule
""")
def q_assemble_foreign_keys_positional(spark, sf):
    return _fk_text(assemble_foreign_keys_positional(
        spark_sql(spark, sf, ORA_CONSTRAINTS), spark_sql(spark, sf, ORA_CONS_COLUMNS)))


LIST_FKS = """
SELECT concat('s', CAST(l_orderkey % 2 AS STRING)) AS schema,
  concat('t', CAST(CAST(floor(l_orderkey / 4) AS BIGINT) AS STRING)) AS table,
  CAST(floor(l_orderkey / 2) AS BIGINT) % 2 AS id, l_linenumber AS seq,
  concat('c', CAST(l_partkey AS STRING)) AS col_from, concat('r', CAST(l_suppkey AS STRING)) AS col_to,
  concat('ref', CAST(l_orderkey AS STRING)) AS referenced_table,
  'NO ACTION' AS on_delete, 'CASCADE' AS on_update
FROM {lineitem}"""


@query("foreign_keys_sqlite", f"""
SELECT schema, "table", 'fk_' || "table" || '_' || CAST(id AS VARCHAR) AS name,
  string_agg(col_from, ', ' ORDER BY seq, col_from, col_to) AS columns, referenced_table,
  string_agg(col_to, ', ' ORDER BY seq, col_from, col_to) AS referenced_columns, on_delete, on_update
FROM ({duck_sql(LIST_FKS)}) GROUP BY schema, "table", id, referenced_table, on_delete, on_update
""")
def q_foreign_keys_sqlite(spark, sf):
    dump = spark_sql(spark, sf, LIST_FKS).withColumnsRenamed({"col_from": "from", "col_to": "to"})
    return _fk_text(foreign_keys_from_lists(dump))


@query("attach_comments", """
SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_attach_comments(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return attach_comments(docs, read_table(spark, sf, "labels"), keys=("doc_id",))


# Ten orders per table, the same table and index names in two schemas; flags differ from row to row.
INDEX_ROWS = """
SELECT concat('s', CAST(CAST(floor(l_orderkey / 10) AS BIGINT) % 2 AS STRING)) AS schema,
  concat('t', CAST(CAST(floor(l_orderkey / 20) AS BIGINT) AS STRING)) AS table,
  CASE WHEN l_orderkey % 10 = 0 THEN 'PRIMARY'
       ELSE concat('idx_', CAST(l_orderkey % 10 AS STRING)) END AS index_name,
  concat('c', CAST(l_partkey AS STRING)) AS column_name, l_linenumber AS seq,
  CAST((l_orderkey + l_linenumber) % 2 AS INT) AS non_unique,
  CASE l_linenumber % 3 WHEN 0 THEN 'BTREE' WHEN 1 THEN 'HASH' ELSE 'FULLTEXT' END
    AS index_type
FROM {lineitem}"""


def _index_text(df):
    return df.select(*place_of(df), "name", F.array_join("columns", ", ").alias("columns"),
                     "is_unique", "is_primary", "type")


@query("assemble_indexes", f"""
SELECT schema, "table", index_name AS name,
  string_agg(column_name, ', ' ORDER BY seq, column_name) AS columns,
  first(non_unique ORDER BY seq, column_name) = 0 AS is_unique, index_name = 'PRIMARY' AS is_primary,
  first(index_type ORDER BY seq, column_name) AS type
FROM ({duck_sql(INDEX_ROWS)}) GROUP BY schema, "table", index_name
""")
def q_assemble_indexes(spark, sf):
    return _index_text(assemble_indexes(spark_sql(spark, sf, INDEX_ROWS)))


@query("distinct_indexes", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               l_shipdate) AS rn
  FROM lineitem) WHERE rn = 1
""")
def q_distinct_indexes(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return distinct_indexes(li, keys=("l_orderkey",), order=(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate")).select("l_orderkey", "l_linenumber", "l_partkey")


INDEX_HEADERS_DUCK = """
SELECT concat('s', CAST(o_orderkey % 2 AS VARCHAR)) AS schema, concat('t', CAST(o_custkey % 100 AS VARCHAR)) AS table,
  concat('i', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS VARCHAR)) AS index_name,
  [CAST(o_orderkey % 5 + 1 AS INTEGER), CAST(o_orderkey % 3 + 1 AS INTEGER)] AS indkey,
  o_orderkey % 2 = 0 AS is_unique,
  CASE WHEN o_orderkey % 3 = 0 THEN 'btree' ELSE 'hash' END AS index_type
FROM orders"""
INDEX_COLUMNS = """
SELECT concat('s', CAST(c_custkey % 2 AS STRING)) AS schema,
  concat('t', CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 100 AS STRING)) AS table,
  CAST(c_nationkey % 6 + 1 AS INT) AS attnum, min(c_name) AS column_name
FROM {customer}
GROUP BY concat('s', CAST(c_custkey % 2 AS STRING)),
  concat('t', CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 100 AS STRING)), CAST(c_nationkey % 6 + 1 AS INT)"""
INDEX_CONSTRAINTS = """
SELECT concat('s', CAST(o_orderkey % 2 AS STRING)) AS schema,
  concat('t', CAST(o_custkey % 100 AS STRING)) AS table,
  concat('i', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING)) AS constraint_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS constraint_type
FROM {orders}"""


@query("join_index_columns", f"""
WITH i AS ({INDEX_HEADERS_DUCK}),
k AS (SELECT schema, "table", index_name, is_unique, index_type, u.seq - 1 AS seq, indkey[u.seq] AS attnum
      FROM i, unnest(range(1, len(indkey) + 1)) AS u(seq)),
c AS (SELECT k.*, ic.column_name FROM k JOIN ({duck_sql(INDEX_COLUMNS)}) ic
      ON k.schema = ic.schema AND k.table = ic.table AND k.attnum = ic.attnum),
p AS (SELECT DISTINCT schema, "table", constraint_name AS index_name FROM ({duck_sql(INDEX_CONSTRAINTS)})
      WHERE constraint_type = 'PRIMARY KEY')
SELECT c.schema, c.table, c.index_name AS name,
  string_agg(column_name, ', ' ORDER BY seq, column_name) AS columns,
  first(is_unique ORDER BY seq, column_name) AS is_unique, count(p.index_name) > 0 AS is_primary,
  first(index_type ORDER BY seq, column_name) AS type
FROM c LEFT JOIN p ON c.schema = p.schema AND c.table = p.table AND c.index_name = p.index_name
GROUP BY c.schema, c.table, c.index_name
""")
def q_join_index_columns(spark, sf):
    orders = read_table(spark, sf, "orders")
    headers = orders.select(
        F.concat(F.lit("s"), (F.col("o_orderkey") % 2).cast("string")).alias("schema"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 100).cast("string")).alias("table"),
        F.concat(F.lit("i"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("index_name"),
        F.array((F.col("o_orderkey") % 5 + 1).cast("int"),
                (F.col("o_orderkey") % 3 + 1).cast("int")).alias("indkey"),
        (F.col("o_orderkey") % 2 == 0).alias("is_unique"),
        F.when(F.col("o_orderkey") % 3 == 0, "btree").otherwise("hash").alias("index_type"))
    return _index_text(join_index_columns(headers, spark_sql(spark, sf, INDEX_COLUMNS),
                                          spark_sql(spark, sf, INDEX_CONSTRAINTS)))


@query("normalise_indexes_mongodb", """
SELECT p_brand AS table,
  CASE WHEN p_partkey % 7 = 0 THEN '_id_' ELSE concat('ix_', p_name) END AS name,
  CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN '_id'
       ELSE p_type || ', ' || p_name END AS columns,
  coalesce(p_size % 5 = 0, false) OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS is_unique,
  p_partkey % 7 = 0 AS is_primary, CAST(NULL AS VARCHAR) AS type
FROM part
""")
def q_normalise_indexes_mongodb(spark, sf):
    part = read_table(spark, sf, "part")
    single = (F.col("p_partkey") % 7 == 0) | (F.col("p_partkey") % 11 == 0)
    dump = part.select(
        F.col("p_brand").alias("table"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("_id_"))
        .otherwise(F.concat(F.lit("ix_"), F.col("p_name"))).alias("name"),
        F.when(single, F.array(F.lit("_id"))).otherwise(
            F.array(F.col("p_type"), F.col("p_name"))).alias("key_names"),
        (F.col("p_size") % 5 == 0).alias("unique"))
    return _index_text(normalise_indexes(dump, "mongodb"))


@query("normalise_indexes_milvus", """
SELECT o_orderpriority AS table, concat('vi', CAST(o_orderkey AS VARCHAR)) AS name,
  'embedding' AS columns, false AS is_unique, false AS is_primary,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'IVF_FLAT' END, 'unknown') AS type,
  coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'L2' END, 'unknown') AS metric
FROM orders
""")
def q_normalise_indexes_milvus(spark, sf):
    o = read_table(spark, sf, "orders")
    dump = o.select(
        F.col("o_orderpriority").alias("table"),
        F.concat(F.lit("vi"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("embedding").alias("field_name"),
        F.when(F.col("o_orderkey") % 3 != 0, F.lit("IVF_FLAT")).alias("index_type"),
        F.when(F.col("o_orderkey") % 4 != 0, F.lit("L2")).alias("metric"))
    out = normalise_indexes(dump, "milvus")
    return out.select("table", "name", F.array_join("columns", ", ").alias("columns"),
                      "is_unique", "is_primary", "type", "metric")


LISTED_INDEXES = """
SELECT concat('s', CAST(p_size % 2 AS STRING)) AS schema,
  concat('t', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)) AS table, p_name AS name,
  p_type AS column_name, p_size % 2 = 0 AS is_unique, p_partkey % 97 = 0 AS is_primary, 'minmax' AS type
FROM {part}"""


def _register_listed(dialect: str) -> None:
    @query(f"normalise_indexes_{dialect}", f"""
WITH l AS ({duck_sql(LISTED_INDEXES)}),
pk AS (SELECT DISTINCT schema, "table", 'key_' || "table" AS columns FROM l)
SELECT schema, "table", name, column_name AS columns, is_unique, is_primary, type FROM l
UNION ALL
SELECT pk.schema, pk."table", 'PRIMARY' AS name, pk.columns, true AS is_unique, true AS is_primary,
       CAST(NULL AS VARCHAR) AS type
FROM pk WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.is_primary AND l.schema = pk.schema AND l."table" = pk."table")
""")
    def q(spark, sf):
        listed = spark_sql(spark, sf, LISTED_INDEXES).withColumn("columns", F.array("column_name"))
        primary = listed.select("schema", "table").distinct().withColumn(
            "columns", F.array(F.concat(F.lit("key_"), F.col("table"))))
        return _index_text(normalise_indexes(listed, dialect, primary))


for _d in ("clickhouse", "sqlite"):
    _register_listed(_d)

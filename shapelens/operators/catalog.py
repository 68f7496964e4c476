"""Catalogue assembly from system-table dumps (O-03, O-05..O-14, O-16, O-17, O-49).

Inputs are DataFrames holding rows of a store's system catalogue (columns,
indexes, key usage, constraints, ...) for any number of databases and tables;
every operator is one set-based job over all of them: no per-table loop.
Ordered lists (index columns, key columns) are collected as one array of
structs sorted by a total order, so aligned lists never drift apart, and only
small per-object groups are collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelens.functions.values import format_bytes

# Canonical column rows produced by normalise_columns.
COLUMN_FIELDS = ("database", "schema", "table", "ordinal", "name", "type", "nullable", "default_value",
                 "comment", "is_primary_key", "is_auto_increment", "max_length")

# Vector-store field type codes and their names.
VECTOR_TYPE_NAMES = {
    0: "None", 1: "Bool", 2: "Int8", 3: "Int16", 4: "Int32", 5: "Int64",
    10: "Float", 11: "Double", 21: "VarChar", 22: "Array", 23: "JSON",
    100: "BinaryVector", 101: "FloatVector", 102: "Float16Vector",
    103: "BFloat16Vector", 104: "SparseFloatVector",
}

DIALECTS = ("mysql", "postgresql", "opengauss", "sqlite", "oracle", "clickhouse",
            "milvus")


# Where an object lives: the parts of its name that a dump may give.
PLACE = ("database", "schema", "table")


def place_of(*frames: DataFrame) -> list[str]:
    """The parts of a table's name that all the frames have."""
    return [c for c in PLACE if all(c in f.columns for f in frames)]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null (a store without schemas has null ones)."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def _falsy_null(c: Column) -> Column:
    """Empty text or zero -> null (a lenient "or undefined")."""
    return F.when(c.cast("string").isin("", "0"), F.lit(None)).otherwise(c)


def _blank_null(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def vector_type_name(code: Column) -> Column:
    """Vector-store type code -> name, ``Unknown(code)`` otherwise."""
    names = F.create_map(*[x for k, v in VECTOR_TYPE_NAMES.items()
                           for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(names, code.cast("int")),
                      F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")")))


def normalise_columns(df: DataFrame, dialect: str) -> DataFrame:
    """A store's column-catalogue dump -> canonical ``columns`` rows (O-03).

    ``database`` and ``schema`` are taken over where the dump has them, else null.
    Expected input columns per dialect (system-catalogue names, lower case):

    * mysql: table_name, ordinal_position, column_name, column_type, is_nullable,
      column_default, column_comment, column_key, extra, character_maximum_length
    * postgresql: table_name, ordinal_position, column_name, data_type,
      is_nullable, column_default, comment, is_primary_key (from
      flag_primary_keys), character_maximum_length
    * opengauss: as postgresql without is_primary_key
    * sqlite: table_name, cid, name, type, notnull, dflt_value, pk
    * oracle: table_name, column_id, column_name, data_type, data_length,
      nullable, data_default, comments, is_primary ('Y'/'N')
    * clickhouse: table, position, name, type, default_expression, comment
    * milvus: collection, field_id, name, data_type (code), dim, is_primary_key,
      auto_id, description
    """
    c = F.col
    false = F.lit(False)
    null_long = F.lit(None).cast("bigint")
    if dialect == "mysql":
        cols = [c("table_name"), c("ordinal_position"), c("column_name"), c("column_type"),
                c("is_nullable") == "YES", c("column_default"),
                _blank_null(c("column_comment")), F.coalesce(c("column_key") == "PRI", false),
                F.coalesce(c("extra").contains("auto_increment"), false),
                _falsy_null(c("character_maximum_length"))]
    elif dialect == "postgresql":
        cols = [c("table_name"), c("ordinal_position"), c("column_name"), c("data_type"),
                c("is_nullable") == "YES", c("column_default"), _blank_null(c("comment")),
                F.coalesce(c("is_primary_key"), false),
                F.coalesce(c("column_default").contains("nextval"), false),
                _falsy_null(c("character_maximum_length"))]
    elif dialect == "opengauss":
        cols = [c("table_name"), c("ordinal_position"), c("column_name"), c("data_type"),
                c("is_nullable") == "YES", c("column_default"), c("comment"),
                false, false, c("character_maximum_length")]
    elif dialect == "sqlite":
        pk1 = F.coalesce(c("pk") == 1, false)
        cols = [c("table_name"), c("cid"), c("name"), c("type"), c("notnull") == 0,
                _blank_null(c("dflt_value")), F.lit(None).cast("string"), pk1,
                pk1 & (F.upper(c("type")) == "INTEGER"), null_long]
    elif dialect == "oracle":
        length = c("data_length")
        typ = F.when(F.coalesce(length, F.lit(0)) != 0, F.concat(
            c("data_type"), F.lit("("), length.cast("string"), F.lit(")"))) \
            .otherwise(c("data_type"))
        cols = [c("table_name"), c("column_id"), c("column_name"), typ,
                c("nullable") == "Y", _blank_null(F.trim(c("data_default"))),
                _blank_null(c("comments")), F.coalesce(c("is_primary") == "Y", false),
                false, null_long]
    elif dialect == "clickhouse":
        cols = [c("table"), c("position"), c("name"), c("type"),
                c("type").contains("Nullable"), _blank_null(c("default_expression")),
                _blank_null(c("comment")), false, false, null_long]
    elif dialect == "milvus":
        name = vector_type_name(c("data_type"))
        typ = F.when(F.coalesce(c("dim"), F.lit(0)) != 0, F.concat(
            name, F.lit("("), c("dim").cast("string"), F.lit(")"))).otherwise(name)
        pk = F.coalesce(c("is_primary_key"), false)
        cols = [c("collection"), c("field_id"), c("name"), typ, ~pk, F.lit(None).cast("string"),
                c("description"), pk, F.coalesce(c("auto_id"), false), null_long]
    else:
        raise ValueError(f"unknown dialect {dialect!r}; one of {DIALECTS}")
    cols = [c(n) if n in df.columns else F.lit(None) for n in PLACE[:2]] + cols
    types = ["string", "string", "string", "int", "string", "string", "boolean", "string", "string",
             "boolean", "boolean", "bigint"]
    return df.select(*[col.cast(t).alias(n) for col, t, n in zip(cols, types, COLUMN_FIELDS)])


# Names that a dialect keeps for itself, by how they begin.
INTERNAL_NAMES = {"sqlite": "sqlite_", "clickhouse": "."}
# What stores without tables list, and how the objects are called.
LISTED_TYPES = {"mongodb": "collection", "milvus": "collection", "kafka": "topic", "rabbitmq": "queue",
                "redis": "pattern", "memcached": "pattern", "etcd": "prefix", "elasticsearch": "index",
                "clickhouse": "table"}


def list_tables(df: DataFrame, dialect: str = "mysql",
                allow: Sequence[str] | None = None) -> DataFrame:
    """Object listing of a store -> (name, schema, type, comment, row_count) by name (O-05).

    Relational stores (mysql, postgresql, opengauss, oracle, sqlite): name,
    [schema], table_type, comment, row_count; base tables only, without names
    that the dialect keeps for itself; an empty comment is null. A row count of
    zero is unknown in mysql and oracle; opengauss and sqlite report none.

    Other stores list objects of their own type: mongodb and milvus
    collections (name, row_count), kafka topics (name), rabbitmq queues (name,
    row_count: messages), redis and memcached patterns (name, row_count), etcd
    prefixes (name, depth, row_count; ``Depth: n``), elasticsearch indices
    (name, health, status, row_count; ``Health: x, Status: y``), clickhouse
    tables (name, [schema], engine, total_bytes, row_count; ``Engine: x, Size: y``).
    Missing columns read as null.
    """
    def c(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None)

    def text(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("unknown")))

    out = df
    if dialect not in LISTED_TYPES:
        out = out.where(F.upper(c("table_type")).isin("BASE TABLE", "TABLE"))
    if dialect in INTERNAL_NAMES:
        out = out.where(~F.col("name").startswith(INTERNAL_NAMES[dialect]))
    if allow is not None:
        out = out.where(F.col("name").isin(list(allow)))
    rows = c("row_count").cast("bigint")
    if dialect in ("mysql", "oracle"):
        rows = F.when(rows != 0, rows)
    elif dialect in ("opengauss", "sqlite", "kafka"):
        rows = F.lit(None).cast("bigint")
    comment = {
        "etcd": lambda: text("Depth", c("depth")),
        "elasticsearch": lambda: F.concat_ws(", ", text("Health", c("health")), text("Status", c("status"))),
        "clickhouse": lambda: F.concat_ws(", ", text("Engine", c("engine")),
                                          text("Size", format_bytes(c("total_bytes")))),
    }.get(dialect, lambda: _blank_null(c("comment").cast("string")))()
    return out.select(F.col("name"), c("schema").cast("string").alias("schema"),
                      F.lit(LISTED_TYPES.get(dialect, "table")).alias("type"),
                      comment.alias("comment"), rows.alias("row_count")).orderBy("name", "schema")


def list_views(df: DataFrame) -> DataFrame:
    """Views with their definition (missing -> ``''``), ordered by name (O-06).

    Input: name, schema, kind, definition, comment.
    """
    c = F.col
    return df.where(F.upper(c("kind")) == "VIEW").select(
        "name", "schema", F.coalesce(c("definition"), F.lit("")).alias("definition"),
        _blank_null(c("comment")).alias("comment")).orderBy("name", "schema")


def list_routines(df: DataFrame, dialect: str = "mysql") -> DataFrame:
    """Procedures and functions (O-07).

    Input: name, schema, routine_type, return_type, definition. Oracle keeps
    only PROCEDURE / FUNCTION objects; empty return type -> null.
    """
    c = F.col
    out = df
    if dialect == "oracle":
        out = out.where(F.upper(c("routine_type")).isin("PROCEDURE", "FUNCTION"))
    return out.select("name", "schema", _blank_null(c("return_type")).alias("return_type"),
                      c("definition")).orderBy("name", "schema")


def normalise_topology(df: DataFrame, kind: str) -> DataFrame:
    """Message-broker objects -> canonical rows (O-08).

    kind ``queues``: name, vhost, durable, auto_delete, exclusive, messages,
    consumers (null counts -> 0), arguments; ``exchanges``: the unnamed default
    exchange is dropped; ``bindings``: source, destination, destination_type,
    routing_key, arguments.
    """
    c = F.col
    if kind == "queues":
        return df.select("name", "vhost", c("durable").cast("boolean"),
                         c("auto_delete").cast("boolean"), c("exclusive").cast("boolean"),
                         F.coalesce(c("messages"), F.lit(0)).cast("bigint").alias("messages"),
                         F.coalesce(c("consumers"), F.lit(0)).cast("bigint").alias("consumers"),
                         "arguments")
    if kind == "exchanges":
        return df.where(c("name") != "").select(
            "name", "vhost", "type", c("durable").cast("boolean"),
            c("auto_delete").cast("boolean"), c("internal").cast("boolean"), "arguments")
    if kind == "bindings":
        return df.select("source", "destination", "destination_type", "routing_key",
                         "arguments")
    raise ValueError(f"unknown topology kind {kind!r}")


def _parse_int(text: Column) -> Column:
    """Leading integer of a text (``'12'`` -> 12), 0 when missing."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("0")), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def normalise_search_indices(df: DataFrame) -> DataFrame:
    """Search-index stats (all text) -> typed rows (O-09).

    Input: index, health, status, docs_count, docs_deleted, store_size, pri, rep.
    Missing counts read as ``'0'``, missing size as ``'0b'``; text that is not a
    number gives null.
    """
    c = F.col
    return df.select(c("index").alias("name"), "health", "status",
                     _parse_int(c("docs_count")).alias("docs_count"),
                     _parse_int(c("docs_deleted")).alias("docs_deleted"),
                     F.coalesce(c("store_size"), F.lit("0b")).alias("store_size"),
                     _parse_int(c("pri")).cast("int").alias("primary_shards"),
                     _parse_int(c("rep")).cast("int").alias("replica_shards"))


def flag_primary_keys(columns: DataFrame, constraints: DataFrame,
                      key_usage: DataFrame) -> DataFrame:
    """Flag columns that belong to a PRIMARY KEY constraint (O-10).

    columns: [database,] schema, table, name, ...; constraints: [database,]
    schema, constraint_name, table, constraint_type; key_usage: [database,]
    schema, constraint_name, table, column_name. Joins on the full name of the
    table: a same-named constraint of another table never matches.
    """
    place = place_of(columns, constraints, key_usage)
    own = [*place, "constraint_name"]
    pk_cols = join_on(constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(*own),
                      key_usage.select(*own, "column_name"), own)
    pk_cols = pk_cols.select(*place, F.col("column_name").alias("name")).distinct() \
        .withColumn("_pk", F.lit(True))
    return join_on(columns, pk_cols, [*place, "name"], "left") \
        .withColumn("is_primary_key", F.coalesce(F.col("_pk"), F.lit(False))).drop("_pk")


def _ordered_pairs(first: str, second: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(
        F.col("ordinal"), F.col(first).alias("a"), F.col(second).alias("b"))))


def assemble_foreign_keys(key_usage: DataFrame, rules: DataFrame) -> DataFrame:
    """Key-column usage + referential rules -> one row per foreign key (O-11).

    key_usage: [database,] schema, table, constraint_name, column_name, ordinal,
    referenced_table, referenced_column; rules: [database,] schema, [table,]
    constraint_name, update_rule, delete_rule. A rule belongs to the constraint
    of its table where it names one; rules that say the same count once. Columns
    and referenced columns stay aligned, in ordinal order. Returns ([database,]
    schema, table, name, columns, referenced_table, referenced_columns,
    on_delete, on_update).
    """
    place = place_of(key_usage)
    keys = [*place_of(key_usage, rules), "constraint_name"]
    joined = join_on(key_usage, rules.select(*keys, "update_rule", "delete_rule").distinct(), keys)
    grouped = joined.groupBy(*place, "constraint_name", "referenced_table",
                             "delete_rule", "update_rule").agg(
        _ordered_pairs("column_name", "referenced_column").alias("_pairs"))
    return grouped.select(
        *place, F.col("constraint_name").alias("name"),
        F.transform("_pairs", lambda p: p["a"]).alias("columns"), "referenced_table",
        F.transform("_pairs", lambda p: p["b"]).alias("referenced_columns"),
        F.col("delete_rule").alias("on_delete"), F.col("update_rule").alias("on_update"))


def foreign_keys_from_lists(df: DataFrame) -> DataFrame:
    """Foreign keys of a file database, one row per key column -> one per key.

    Input: [database,] [schema,] table, id, seq, from, to, referenced_table,
    on_delete, on_update. A key is named ``fk_<table>_<id>``.
    """
    place = place_of(df)
    grouped = df.groupBy(*place, "id", "referenced_table", "on_delete", "on_update").agg(
        F.sort_array(F.collect_list(F.struct("seq", "from", "to"))).alias("_pairs"))
    return grouped.select(
        *place, F.concat(F.lit("fk_"), F.col("table"), F.lit("_"), F.col("id").cast("string")).alias("name"),
        F.transform("_pairs", lambda p: p["from"]).alias("columns"), "referenced_table",
        F.transform("_pairs", lambda p: p["to"]).alias("referenced_columns"), "on_delete", "on_update")


def assemble_foreign_keys_positional(constraints: DataFrame,
                                     cons_columns: DataFrame) -> DataFrame:
    """Foreign keys from constraint headers and positioned columns (O-12).

    constraints: owner, constraint_name, table, constraint_type ('R' for a
    foreign key), r_owner, r_constraint_name, delete_rule; cons_columns: owner,
    constraint_name, table, column_name, position. The child's columns are
    matched to the referenced constraint's columns by position.
    """
    child = constraints.where(F.col("constraint_type") == "R").alias("k")
    kc = cons_columns.alias("kc")
    parent = constraints.alias("p")
    pc = cons_columns.alias("pc")
    rows = (child
            .join(kc, (F.col("k.owner") == F.col("kc.owner"))
                  & (F.col("k.constraint_name") == F.col("kc.constraint_name")))
            .join(parent, (F.col("k.r_owner") == F.col("p.owner"))
                  & (F.col("k.r_constraint_name") == F.col("p.constraint_name")))
            .join(pc, (F.col("p.owner") == F.col("pc.owner"))
                  & (F.col("p.constraint_name") == F.col("pc.constraint_name"))
                  & (F.col("kc.position") == F.col("pc.position")))
            .select(F.col("k.owner").alias("schema"), F.col("k.table").alias("table"),
                    F.col("k.constraint_name").alias("constraint_name"),
                    F.col("kc.column_name").alias("column_name"),
                    F.col("kc.position").alias("ordinal"),
                    F.col("p.table").alias("referenced_table"),
                    F.col("pc.column_name").alias("referenced_column"),
                    F.col("k.delete_rule").alias("delete_rule")))
    grouped = rows.groupBy("schema", "table", "constraint_name", "referenced_table",
                           "delete_rule").agg(
        _ordered_pairs("column_name", "referenced_column").alias("_pairs"))
    return grouped.select(
        "schema", "table", F.col("constraint_name").alias("name"),
        F.transform("_pairs", lambda p: p["a"]).alias("columns"), "referenced_table",
        F.transform("_pairs", lambda p: p["b"]).alias("referenced_columns"),
        F.col("delete_rule").alias("on_delete"),
        F.lit(None).cast("string").alias("on_update"))


def attach_comments(columns: DataFrame, comments: DataFrame,
                    keys: Sequence[str] = ("table", "name")) -> DataFrame:
    """Left-join column comments by (table, column) or (table, ordinal) (O-13)."""
    return columns.join(comments, list(keys), "left")


def assemble_indexes(index_rows: DataFrame) -> DataFrame:
    """One row per index column -> one row per index (O-16).

    Input: [database,] [schema,] table, index_name, column_name, seq,
    non_unique, index_type. Columns in (seq, column) order; flags from the
    first row in that order; primary when the index is named ``PRIMARY``.
    Returns ([database,] [schema,] table, name, columns, is_unique, is_primary,
    type).
    """
    place = place_of(index_rows)
    first = F.struct(F.col("seq"), F.col("column_name"))
    grouped = index_rows.groupBy(*place, "index_name").agg(
        F.sort_array(F.collect_list(first)).alias("_cols"),
        F.min_by(F.col("non_unique"), first).alias("_non_unique"),
        F.min_by(F.col("index_type"), first).alias("type"))
    return grouped.select(
        *place, F.col("index_name").alias("name"),
        F.transform("_cols", lambda x: x["column_name"]).alias("columns"),
        (F.col("_non_unique") == 0).alias("is_unique"),
        (F.col("index_name") == "PRIMARY").alias("is_primary"), "type")


def distinct_indexes(df: DataFrame, keys: Sequence[str] = ("table", "name"),
                     order: Sequence[str] = ("columns_text",)) -> DataFrame:
    """Keep one row per index (``DISTINCT ON``) under a total order (O-17)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def join_index_columns(indexes: DataFrame, index_columns: DataFrame,
                       constraints: DataFrame) -> DataFrame:
    """Index headers x their columns, primary flag from constraints (O-14).

    indexes: [database,] [schema,] table, index_name, indkey (array<int> of
    column numbers, in index order), is_unique, index_type; index_columns:
    [...] table, attnum, column_name; constraints: [...] table, constraint_name,
    constraint_type. All are matched by the full name of the table that they
    have in common. The key array is exploded with positions, so the index order
    is kept. Returns ([...] table, name, columns, is_unique, is_primary, type).
    """
    place = place_of(indexes, index_columns, constraints)
    keyed = indexes.select(*place, "index_name", "is_unique", "index_type",
                           F.posexplode("indkey").alias("seq", "attnum"))
    cols = join_on(keyed, index_columns.select(*place, "attnum", "column_name"), [*place, "attnum"])
    pk = constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(
        *place, F.col("constraint_name").alias("index_name")).distinct().withColumn("_pk", F.lit(True))
    flagged = join_on(cols, pk, [*place, "index_name"], "left")
    first = F.struct(F.col("seq"), F.col("column_name"))
    return flagged.groupBy(*place, "index_name").agg(
        F.sort_array(F.collect_list(first)).alias("_cols"),
        F.min_by(F.col("is_unique"), first).alias("is_unique"),
        F.coalesce(F.max("_pk"), F.lit(False)).alias("is_primary"),
        F.min_by(F.col("index_type"), first).alias("type"),
    ).select(*place, F.col("index_name").alias("name"),
             F.transform("_cols", lambda x: x["column_name"]).alias("columns"),
             "is_unique", "is_primary", "type")


def normalise_indexes(df: DataFrame, dialect: str,
                      primary: DataFrame | None = None) -> DataFrame:
    """Index dumps that already hold whole indexes -> canonical rows (O-49).

    * ``mongodb``: table, name, key_names (array, key order), unique. Unique if
      flagged or the single key is ``_id``; primary when named ``_id_``.
    * ``milvus``: table, name, field_name, index_type, metric. Missing type and
      metric read ``unknown``.
    * ``clickhouse`` / ``sqlite``: ``df`` holds listed indexes (table, name,
      columns, is_unique, is_primary, type); ``primary`` holds (table,
      columns) key columns; a table with no listed primary index gets one
      synthetic ``PRIMARY`` index.
    Tables are told apart by database and schema where the dump has them.
    Returns ([database,] [schema,] table, name, columns, is_unique, is_primary,
    type[, metric]).
    """
    c = F.col
    place = place_of(df)
    if dialect == "mongodb":
        single_id = (F.size("key_names") == 1) & (F.element_at("key_names", 1) == "_id")
        return df.select(*place, "name", c("key_names").alias("columns"),
                         (F.coalesce(c("unique"), F.lit(False)) | single_id).alias("is_unique"),
                         (c("name") == "_id_").alias("is_primary"),
                         F.lit(None).cast("string").alias("type"))
    if dialect == "milvus":
        return df.select(*place, "name", F.array(c("field_name")).alias("columns"),
                         F.lit(False).alias("is_unique"), F.lit(False).alias("is_primary"),
                         F.coalesce(c("index_type"), F.lit("unknown")).alias("type"),
                         F.coalesce(c("metric"), F.lit("unknown")).alias("metric"))
    if dialect in ("clickhouse", "sqlite"):
        listed = df.select(*place, "name", "columns", "is_unique", "is_primary", "type")
        if primary is None:
            return listed
        has_primary = listed.where(c("is_primary")).select(*place).distinct()
        synthetic = join_on(primary.select(*place, "columns"), has_primary, place, "left_anti").select(
            *place, F.lit("PRIMARY").alias("name"), "columns",
            F.lit(True).alias("is_unique"), F.lit(True).alias("is_primary"),
            F.lit(None).cast("string").alias("type"))
        return listed.unionByName(synthetic)
    raise ValueError(f"unknown dialect {dialect!r}")

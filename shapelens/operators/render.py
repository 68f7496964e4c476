"""Markdown rendering computed on the cluster (O-04, O-43..O-46).

Every object becomes one text block built by ``concat_ws`` (only lines that are
optional may be null and are left out), next to a sort key that orders the
blocks of its section. A null value never deletes a line: names and types read
``unknown``, numbers ``unknown``, comments are empty. Collections, whose fields
may be many, are rendered line by line. A whole document is a DataFrame of
ordered lines (section, sort_key, text), written by a distributed, ordered text
write.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from shapelens.functions.values import format_bytes, thousands
from shapelens.operators.catalog import join_on, place_of

# The order of sections in a database document and the heading of
# each kind of object ("{n}" is the number of objects, "{total}" a key total).
SECTIONS = (
    ("tables", "## Tables ({n})"),
    ("views", "## Views ({n})"),
    ("routines", "## Stored Procedures ({n})"),
    ("collections", "## Collections ({n})"),
    ("key_patterns", "## Key Patterns (Total Keys: {total})"),
    ("cache_patterns", "## Cache Statistics (Total Keys: {total})"),
    ("topics", "## Topics ({n})"),
    ("queues", "## Queues ({n})"),
    ("exchanges", "## Exchanges ({n})"),
    ("indices", "## Indices ({n})"),
    ("prefixes", "## Key Prefixes (Total Keys: {total})"),
    ("storage_tables", "## Tables ({n})"),
    ("vector_collections", "## Collections ({n})"),
)
NO_DATA_LINES = ("**No schema data available**", "",
                 "The database appears to be empty or the schema extraction found no objects.")
BLOCK_END = ("---", "")

_c = F.col


def _lit(s: str) -> Column:
    return F.lit(s)


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


UNKNOWN = "unknown"


def _text(c: Column) -> Column:
    """The value as text, ``unknown`` when null."""
    return F.coalesce(c.cast("string"), F.lit(UNKNOWN))


def _number(c: Column) -> Column:
    return F.coalesce(thousands(c), F.lit(UNKNOWN))


def _names(arr: Column) -> Column:
    return F.array_join(_lines(arr), ", ", UNKNOWN)


def _opt(cond: Column, line: Column) -> Column:
    return F.when(cond, line)


def _yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), _lit("Yes")).otherwise(_lit("No"))


def _lines(arr: Column) -> Column:
    """An array of lines (strings), or an empty array."""
    return F.coalesce(arr, F.array().cast("array<string>"))


def _size(arr: Column) -> Column:
    """Number of elements, 0 for a null array."""
    return F.coalesce(F.size(arr), F.lit(0))


def _listed(title: str, arr: Column, fmt) -> Column:
    """``title`` + one line per element + blank line, or nothing when empty."""
    return F.when(_size(arr) > 0, F.concat(
        F.array(_lit(title)), F.transform(arr, fmt), F.array(_lit(""))))


def _map_lines(title: str, m: Column) -> Column:
    entries = F.sort_array(F.map_entries(m))
    return F.when(F.coalesce(F.size(m), F.lit(0)) > 0, F.concat(
        F.array(_lit(title)),
        F.transform(entries, lambda e: F.concat(_lit("- "), e["key"], _lit(": "),
                                                _text(e["value"]))),
        F.array(_lit(""))))


def _block(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _desc_key(n: Column, tie: Column) -> Column:
    """Sort key text: larger ``n`` first, then ``tie`` ascending."""
    size = F.coalesce(n.cast("bigint"), F.lit(0))
    return F.concat(F.lpad((F.lit(10 ** 18) - size).cast("string"), 19, "0"),
                    _lit("\u0000"), _text(tie))


def _asc_key(n: Column, tie: Column) -> Column:
    return F.concat(F.lpad(F.coalesce(n.cast("bigint"), F.lit(0)).cast("string"), 19, "0"), _lit("\u0000"), _text(tie))


def _column_line(col) -> Column:
    name = F.when(F.coalesce(col["is_primary_key"], F.lit(False)),
                  F.concat(_lit("**"), _text(col["name"]), _lit("** (PK)"))).otherwise(_text(col["name"]))
    typ = F.when(F.coalesce(col["is_auto_increment"], F.lit(False)),
                 F.concat(_text(col["type"]), _lit(" AUTO_INCREMENT"))).otherwise(_text(col["type"]))
    default = F.when(_nonempty(col["default_value"]), col["default_value"]).otherwise(_lit("-"))
    return F.concat(_lit("| "), name, _lit(" | "), typ, _lit(" | "),
                    F.when(col["nullable"], _lit("YES")).otherwise(_lit("NO")),
                    _lit(" | "), default, _lit(" | "), F.coalesce(col["comment"], _lit("")),
                    _lit(" |"))


def _index_line(idx) -> Column:
    kind = (F.when(idx["is_primary"], _lit("PRIMARY KEY"))
            .when(idx["is_unique"], _lit("UNIQUE")).otherwise(_lit("INDEX")))
    typ = F.when(_nonempty(idx["type"]), F.concat(_lit(" ("), idx["type"], _lit(")"))) \
        .otherwise(_lit(""))
    return F.concat(_lit("- "), kind, typ, _lit(": `"), _text(idx["name"]), _lit("` on ("),
                    _names(idx["columns"]), _lit(")"))


def _fk_lines(fk) -> Column:
    head = F.concat(_lit("- `"), _text(fk["name"]), _lit("`: ("), _names(fk["columns"]),
                    _lit(") REFERENCES "), _text(fk["referenced_table"]), _lit("("),
                    _names(fk["referenced_columns"]), _lit(")"))
    on_delete = F.when(_nonempty(fk["on_delete"]),
                       F.array(F.concat(_lit("  - ON DELETE: "), fk["on_delete"])))
    on_update = F.when(_nonempty(fk["on_update"]),
                       F.array(F.concat(_lit("  - ON UPDATE: "), fk["on_update"])))
    return F.concat(F.array(head), _lines(on_delete), _lines(on_update))


# The head of a table of columns.
COLUMNS_TABLE_HEAD = ("| Name | Type | Nullable | Default | Comment |",
                      "|------|------|----------|---------|---------|")


def _table_block(df: DataFrame) -> DataFrame:
    cols = _c("columns")
    columns = F.when(_size(cols) > 0, F.concat(
        F.array(_lit("**Columns**:"), _lit(""), *[_lit(x) for x in COLUMNS_TABLE_HEAD]),
        F.transform(cols, _column_line), F.array(_lit(""))))
    idx = _c("indexes")
    indexes = F.when(_size(idx) > 0, F.concat(
        F.array(_lit("**Indexes**:")), F.transform(idx, _index_line), F.array(_lit(""))))
    fks = _c("foreign_keys")
    foreign = F.when(_size(fks) > 0, F.concat(
        F.array(_lit("**Foreign Keys**:")), F.flatten(F.transform(fks, _fk_lines)),
        F.array(_lit("")))).otherwise(F.array(_lit("**Foreign Keys**: None"), _lit("")))
    text = _block(
        F.concat(_lit("### Table: "), _text(_c("name"))),
        _opt(_nonempty(_c("schema")), F.concat(_lit("**Schema**: "), _c("schema"))),
        _opt(_nonempty(_c("comment")), F.concat(_lit("**Description**: "), _c("comment"))),
        _opt(_c("row_count").isNotNull(),
             F.concat(_lit("**Row Count**: "), thousands(_c("row_count")))),
        _lit(""), columns, indexes, foreign, *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


def _view_block(df: DataFrame) -> DataFrame:
    text = _block(
        F.concat(_lit("### View: "), _text(_c("name"))),
        _opt(_nonempty(_c("schema")), F.concat(_lit("**Schema**: "), _c("schema"))),
        _opt(_nonempty(_c("comment")), F.concat(_lit("**Description**: "), _c("comment"))),
        _lit(""), _lit("**Definition**:"), _lit("```sql"), F.coalesce(_c("definition"), _lit("")),
        _lit("```"), _lit(""))
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


def _routine_block(df: DataFrame) -> DataFrame:
    params = _listed("**Parameters**:", _c("parameters") if "parameters" in df.columns
                     else F.lit(None).cast("array<struct<name:string,type:string,mode:string>>"),
                     lambda p: F.concat(_lit("- "), _text(p["name"]), _lit(" ("), _text(p["type"]),
                                        _lit(") "), F.coalesce(p["mode"], _lit(""))))
    params = F.when(params.isNotNull(), F.slice(params, 1, F.size(params) - 1))
    text = _block(
        F.concat(_lit("### "), _text(_c("name"))),
        _opt(_nonempty(_c("schema")), F.concat(_lit("**Schema**: "), _c("schema"))),
        _opt(_nonempty(_c("return_type")), F.concat(_lit("**Returns**: "), _c("return_type"))),
        params, _lit(""))
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


def collection_lines(profile: DataFrame, stats: DataFrame,
                     indexes: DataFrame | None = None) -> DataFrame:
    """Collections from a per-collection field profile, line by line (O-43).

    profile: field_profile(..., by=["collection"]); stats: (collection,
    document_count, sample_size); indexes (optional): (collection, name, keys
    array<struct<k,v>>, unique). Returns (sort_key, text), one row per line or
    fixed group of lines, fields by name, types by percent desc then name. No
    row holds more than one field, however many a collection has.
    """
    def key(part: int, *more: Column) -> Column:
        return F.concat_ws("\u0000", _text(_c("collection")), _lit(str(part)), *more)

    own = profile.select("collection").distinct().withColumn("_fields", F.lit(True))
    listed = None if indexes is None else indexes.select("collection").distinct().withColumn("_indexes", F.lit(True))
    known = join_on(stats, own, ["collection"], "left")
    known = known.withColumn("_indexes", F.lit(None)) if listed is None else join_on(known, listed, ["collection"], "left")
    head = known.select(key(0).alias("sort_key"), _block(
        F.concat(_lit("### Collection: "), _text(_c("collection"))),
        F.concat(_lit("**Document Count**: "), _number(_c("document_count"))), _lit(""),
        F.when(_c("_fields"), F.array(
            F.concat(_lit("**Fields** (inferred from "), _text(_c("sample_size")), _lit(" samples):")), _lit(""),
            _lit("| Field | Types | Occurrence |"), _lit("|-------|-------|------------|")))).alias("text"))
    per_path = profile.groupBy("collection", "path").agg(
        F.sort_array(F.collect_list(F.struct((-_c("type_pct")).alias("neg"), "type", "type_pct"))).alias("types"),
        F.first("occurrence_pct").alias("occurrence"))
    types = F.array_join(F.transform("types", lambda t: F.concat(
        _text(t["type"]), _lit(" ("), _text(t["type_pct"]), _lit("%)"))), ", ")
    fields = per_path.select(key(1, _text(_c("path"))).alias("sort_key"), F.concat(
        _lit("| "), _text(_c("path")), _lit(" | "), types, _lit(" | "), _text(_c("occurrence")), _lit("% |")).alias("text"))
    after = known.where(_c("_fields")).select(key(2).alias("sort_key"), _lit("").alias("text"))
    tail = known.select(key(6).alias("sort_key"), _lit("\n".join(BLOCK_END)).alias("text"))
    out = head.unionByName(fields).unionByName(after).unionByName(tail)
    if indexes is not None:
        named = known.where(_c("_indexes"))
        line = F.concat(_lit("- `"), _text(_c("name")), _lit("`"),
                        F.when(_c("unique"), _lit(" (UNIQUE)")).otherwise(_lit("")), _lit(": { "),
                        F.array_join(F.transform("keys", lambda kv: F.concat(_text(kv["k"]), _lit(": "), _text(kv["v"]))), ", "),
                        _lit(" }"))
        out = (out.unionByName(named.select(key(3).alias("sort_key"), _lit("**Indexes**:").alias("text")))
               .unionByName(indexes.select(key(4, _text(_c("name"))).alias("sort_key"), line.alias("text")))
               .unionByName(named.select(key(5).alias("sort_key"), _lit("").alias("text"))))
    return out


def _samples(title: str = "**Sample Keys**:", col: str = "sample_keys"):
    return _listed(title, _c(col), lambda k: F.concat(_lit("- "), _text(k)))


def _key_pattern_block(df: DataFrame) -> DataFrame:
    text = _block(
        F.concat(_lit("### Pattern: "), _text(_c("pattern"))),
        F.concat(_lit("**Count**: "), _number(_c("count"))), _lit(""),
        _map_lines("**Types**:", _c("types")), _samples(), *[_lit(x) for x in BLOCK_END])
    return df.select(_desc_key(_c("count"), _c("pattern")).alias("sort_key"), text.alias("text"))


def _cache_block(df: DataFrame) -> DataFrame:
    samples = _samples() if "sample_keys" in df.columns else F.lit(None).cast("array<string>")
    text = _block(
        F.concat(_lit("### Pattern: "), _text(_c("pattern"))),
        F.concat(_lit("**Count**: "), _number(_c("count"))), _lit(""),
        _opt(_nonempty(_c("note")), F.concat(_lit("**Note**: "), _c("note"))),
        _opt(_nonempty(_c("note")), _lit("")), samples, *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("pattern")).alias("sort_key"), text.alias("text"))


def _topic_block(df: DataFrame) -> DataFrame:
    config = _map_lines("**Configuration**:", _c("config")) if "config" in df.columns else None
    text = _block(
        F.concat(_lit("### Topic: "), _text(_c("topic"))),
        F.concat(_lit("**Partitions**: "), _text(_c("partitions"))),
        F.concat(_lit("**Replication Factor**: "), _text(_c("replication_factor"))),
        _lit(""), *([config] if config is not None else []), *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("topic")).alias("sort_key"), text.alias("text"))


def _arguments(df: DataFrame):
    if "arguments" in df.columns and dict(df.dtypes)["arguments"].startswith("map"):
        return [_map_lines("**Arguments**:", _c("arguments"))]
    return []


def _queue_block(df: DataFrame) -> DataFrame:
    text = _block(
        F.concat(_lit("### Queue: "), _text(_c("name"))),
        F.concat(_lit("**Durable**: "), _yes_no(_c("durable"))),
        F.concat(_lit("**Auto Delete**: "), _yes_no(_c("auto_delete"))),
        F.concat(_lit("**Messages**: "), _number(_c("messages"))),
        F.concat(_lit("**Consumers**: "), _text(_c("consumers"))),
        _lit(""), *_arguments(df), *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


def _exchange_block(df: DataFrame) -> DataFrame:
    text = _block(
        F.concat(_lit("### Exchange: "), _text(_c("name"))),
        F.concat(_lit("**Type**: "), _text(_c("type"))),
        F.concat(_lit("**Durable**: "), _yes_no(_c("durable"))),
        F.concat(_lit("**Auto Delete**: "), _yes_no(_c("auto_delete"))),
        F.concat(_lit("**Internal**: "), _yes_no(_c("internal"))),
        _lit(""), *_arguments(df), *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


def _index_block(df: DataFrame) -> DataFrame:
    text = _block(
        F.concat(_lit("### Index: "), _text(_c("name"))),
        F.concat(_lit("**Health**: "), _text(_c("health"))),
        F.concat(_lit("**Status**: "), _text(_c("status"))),
        F.concat(_lit("**Documents**: "), _number(_c("docs_count"))),
        F.concat(_lit("**Size**: "), _text(_c("store_size"))),
        F.concat(_lit("**Primary Shards**: "), _text(_c("primary_shards"))),
        F.concat(_lit("**Replica Shards**: "), _text(_c("replica_shards"))),
        _lit(""), *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


def _prefix_block(df: DataFrame) -> DataFrame:
    text = _block(
        F.concat(_lit("### Prefix: "), _text(_c("prefix"))),
        F.concat(_lit("**Count**: "), _number(_c("count"))),
        F.concat(_lit("**Depth**: "), _text(_c("depth"))),
        _lit(""), _samples(), *[_lit(x) for x in BLOCK_END])
    key = F.concat(_asc_key(_c("depth"), _lit("")), _desc_key(_c("count"), _c("prefix")))
    return df.select(key.alias("sort_key"), text.alias("text"))


def _storage_block(df: DataFrame) -> DataFrame:
    text = _block(
        F.concat(_lit("### Table: "), _text(_c("name"))),
        F.concat(_lit("**Engine**: "), _text(_c("engine"))),
        _opt(_nonempty(_c("partition_key")), F.concat(_lit("**Partition Key**: "), _c("partition_key"))),
        _opt(_nonempty(_c("sorting_key")), F.concat(_lit("**Sorting Key**: "), _c("sorting_key"))),
        _opt(_nonempty(_c("primary_key")), F.concat(_lit("**Primary Key**: "), _c("primary_key"))),
        _opt(_c("total_rows").isNotNull(),
             F.concat(_lit("**Total Rows**: "), thousands(_c("total_rows")))),
        _opt(_c("total_bytes").isNotNull(),
             F.concat(_lit("**Total Size**: "), format_bytes(_c("total_bytes")))),
        _lit(""), *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


def _vector_block(df: DataFrame) -> DataFrame:
    fields = _c("fields")
    field_part = F.when(_size(fields) > 0, F.concat(
        F.array(_lit("**Fields**:"), _lit(""), _lit("| Name | Type | Primary | Dimension |"),
                _lit("|------|------|---------|-----------|")),
        F.transform(fields, lambda f: F.concat(
            _lit("| "), F.when(f["is_primary"], F.concat(_lit("**"), _text(f["name"]), _lit("**")))
            .otherwise(_text(f["name"])), _lit(" | "), _text(f["type"]), _lit(" | "), _yes_no(f["is_primary"]),
            _lit(" | "), F.when(F.coalesce(f["dimension"], F.lit(0)) != 0,
                                f["dimension"].cast("string")).otherwise(_lit("-")),
            _lit(" |"))), F.array(_lit(""))))
    idx_part = _listed("**Indexes**:", _c("indexes"), lambda i: F.concat(
        _lit("- `"), _text(i["index_name"]), _lit("` on `"), _text(i["field_name"]), _lit("`: "),
        _text(i["index_type"]), _lit(" ("), _text(i["metric"]), _lit(")")))
    text = _block(
        F.concat(_lit("### Collection: "), _text(_c("name"))),
        _opt(_nonempty(_c("description")), F.concat(_lit("**Description**: "), _c("description"))),
        F.concat(_lit("**Entities**: "), _number(_c("entities"))),
        _opt(F.coalesce(_c("shards"), F.lit(0)) != 0,
             F.concat(_lit("**Shards**: "), _c("shards").cast("string"))),
        _lit(""), field_part, idx_part, *[_lit(x) for x in BLOCK_END])
    return df.select(_text(_c("name")).alias("sort_key"), text.alias("text"))


_BUILDERS = {
    "tables": _table_block, "views": _view_block, "routines": _routine_block,
    "key_patterns": _key_pattern_block,
    "cache_patterns": _cache_block, "topics": _topic_block, "queues": _queue_block,
    "exchanges": _exchange_block, "indices": _index_block, "prefixes": _prefix_block,
    "storage_tables": _storage_block, "vector_collections": _vector_block,
}
KINDS = tuple(_BUILDERS)


def render_objects(df: DataFrame, kind: str) -> DataFrame:
    """One Markdown block per object of ``kind`` -> (sort_key, text) (O-43).

    Collections have ``collection_lines``.
    Input columns per kind follow the canonical rows of the other operators;
    nested lists (columns, indexes, fields, sample keys) are arrays of structs.
    """
    if kind not in _BUILDERS:
        raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")
    return _BUILDERS[kind](df)


def nest_table_details(tables: DataFrame, columns: DataFrame, indexes: DataFrame,
                       foreign_keys: DataFrame) -> DataFrame:
    """Tables + their columns, indexes and foreign keys as nested arrays.

    tables: [database,] [schema,] table, comment, row_count; columns: canonical
    column rows (ordered by ordinal); indexes: ([...] table, name, columns,
    is_unique, is_primary, type); foreign_keys: ([...] table, name, columns,
    referenced_table, referenced_columns, on_delete, on_update). Tables are
    matched by all parts of the name that the four have in common; each list is
    grouped per table, so only one table's objects are ever collected together.
    """
    keys = place_of(tables, columns, indexes, foreign_keys)
    col_fields = [c for c in ("ordinal", "name", "type", "nullable", "default_value",
                              "comment", "is_primary_key", "is_auto_increment")]
    cols = columns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        *[_c(c) for c in col_fields]))).alias("columns"))
    idx = indexes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "name", "columns", "is_unique", "is_primary", "type"))).alias("indexes"))
    fks = foreign_keys.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "name", "columns", "referenced_table", "referenced_columns", "on_delete",
        "on_update"))).alias("foreign_keys"))
    out = join_on(join_on(join_on(tables, cols, keys, "left"), idx, keys, "left"), fks, keys, "left")
    out = out.withColumnRenamed("table", "name")
    return out if "schema" in out.columns else out.withColumn("schema", F.lit(None).cast("string"))


def render_table_details(tables: DataFrame, columns: DataFrame, indexes: DataFrame,
                         foreign_keys: DataFrame, database: str, name: str,
                         schema: str | None = None) -> DataFrame:
    """One table's page (O-44): ``##`` sections, no "None" for foreign keys.

    Takes the four inputs of ``nest_table_details``; each is filtered by table
    name (and schema, if given) before anything is grouped. An absent table
    yields the line ``Table "x" not found in database "y".``.
    """
    def own(df: DataFrame) -> DataFrame:
        out = df.where(_c("table") == name)
        return out if schema is None or "schema" not in df.columns else out.where(_c("schema") == schema)

    header = own(tables)
    one = nest_table_details(header, own(columns), own(indexes), own(foreign_keys))
    cols = _c("columns")
    columns_part = F.when(_size(cols) > 0, F.concat(
        F.array(_lit("## Columns"), _lit(""), *[_lit(x) for x in COLUMNS_TABLE_HEAD]),
        F.transform(cols, _column_line), F.array(_lit(""))))
    idx = _c("indexes")
    indexes_part = F.when(_size(idx) > 0, F.concat(
        F.array(_lit("## Indexes"), _lit("")), F.transform(idx, _index_line), F.array(_lit(""))))
    fks = _c("foreign_keys")
    foreign = F.when(_size(fks) > 0, F.concat(
        F.array(_lit("## Foreign Keys"), _lit("")), F.flatten(F.transform(fks, _fk_lines))))
    page = _block(
        F.concat(_lit("# Table: "), _text(_c("name"))), _lit(""),
        _opt(_nonempty(_c("schema")), F.concat(_lit("**Schema**: "), _c("schema"))),
        _opt(_nonempty(_c("comment")), F.concat(_lit("**Description**: "), _c("comment"))),
        _opt(_c("row_count").isNotNull(),
             F.concat(_lit("**Row Count**: "), thousands(_c("row_count")))),
        _lit(""), columns_part, indexes_part, foreign)
    found = one.select(page.alias("text"))
    missing = tables.sparkSession.range(1).select(
        _lit(f'Table "{name}" not found in database "{database}".').alias("text")) \
        .where(~F.lit(header.exists()))
    return found.unionByName(missing)


def render_listing(tables: DataFrame, database: str) -> DataFrame:
    """Listing of tables as lines (O-45): header, count, one bullet per table.

    tables: name, type, comment, row_count. Returns (sort_key, text); the
    bullet ``- **name** (type): comment [n rows]`` omits the parts it lacks and
    the type when it is ``table``.
    """
    bullet = F.concat(
        _lit("- **"), _text(_c("name")), _lit("**"),
        F.when(_c("type") != "table", F.concat(_lit(" ("), _c("type"), _lit(")"))).otherwise(_lit("")),
        F.when(_nonempty(_c("comment")), F.concat(_lit(": "), _c("comment"))).otherwise(_lit("")),
        F.when(_c("row_count").isNotNull(),
               F.concat(_lit(" ["), thousands(_c("row_count")), _lit(" rows]"))).otherwise(_lit("")))
    n = tables.select(F.count(F.lit(1))).scalar()
    spark = tables.sparkSession
    head = spark.range(1).select(F.array(
        F.struct(_lit("0").alias("sort_key"), _lit(f"# Tables in {database}").alias("text")),
        F.struct(_lit("1").alias("sort_key"), _lit("").alias("text")),
        F.struct(_lit("2").alias("sort_key"),
                 F.concat(_lit("Found "), n.cast("string"), _lit(" table(s):")).alias("text")),
        F.struct(_lit("3").alias("sort_key"), _lit("").alias("text"))).alias("h")) \
        .select(F.inline("h"))
    body = tables.select(F.concat(_lit("4"), _text(_c("name"))).alias("sort_key"), bullet.alias("text"))
    return head.unionByName(body)


def render_database(blocks: Mapping[str, DataFrame], name: str, db_type: str,
                    version: str | None = None,
                    totals: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A whole database document as ordered lines (section, sort_key, text) (O-46).

    ``blocks`` maps a kind to its ``render_objects`` output; ``totals`` maps
    key-pattern kinds to a one-row DataFrame with column ``total``. Sections
    come in fixed order with ``## Kind (n)`` headings; with no object at all
    the document says there is no schema data. Headings come from one grouped
    count over all blocks and joins with small fixed tables. Nothing runs before
    the caller's own action.
    """
    from shapelens.session import union_all

    spark = next(iter(blocks.values())).sparkSession
    header = [f"# Database Schema: {name}", "", f"**Database Type**: {db_type.upper()}"]
    if version:
        header.append(f"**Version**: {version}")
    header.append("")
    head = spark.createDataFrame([(0, f"{i:06d}", line) for i, line in enumerate(header)],
                                 "section int, sort_key string, text string")
    numbered = {kind: (s, heading) for s, (kind, heading) in enumerate(SECTIONS, start=1)}
    used = [(numbered[k][0], k) for k in blocks if k in numbered]
    body = union_all([blocks[k].select(F.lit(s).alias("section"),
                                       F.concat(_lit("\u0001"), _c("sort_key")).alias("sort_key"),
                                       "text") for s, k in used])
    counts = body.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    titles = spark.createDataFrame(
        [(s, numbered[k][1].split("{")[0], numbered[k][1].split("}")[-1], "{n}" in numbered[k][1])
         for s, k in used], "section int, title string, tail string, by_count boolean")
    total_rows = [t.select(F.lit(numbered[k][0]).alias("section"),
                           F.col("total").cast("bigint").alias("total"))
                  for k, t in (totals or {}).items() if k in numbered]
    with_totals = counts.join(titles, "section")
    if total_rows:
        with_totals = with_totals.join(union_all(total_rows), "section", "left")
    else:
        with_totals = with_totals.withColumn("total", F.lit(None).cast("bigint"))
    label = F.when(_c("by_count"), _c("n").cast("string")) \
        .otherwise(F.coalesce(thousands(_c("total")), _lit("Unknown")))
    heads = with_totals.select("section", F.inline(F.array(
        F.struct(_lit("").alias("sort_key"), F.concat(_c("title"), label, _c("tail")).alias("text")),
        F.struct(_lit("\u0000").alias("sort_key"), _lit("").alias("text")))))
    no_data = spark.createDataFrame(
        [(99, f"{i:06d}", line, 1) for i, line in enumerate(NO_DATA_LINES)],
        "section int, sort_key string, text string, _k int")
    any_object = counts.agg(F.sum("n").alias("n")).where(_c("n") > 0).select(F.lit(1).alias("_k"))
    no_data = no_data.join(any_object, "_k", "left_anti").drop("_k")
    return union_all([head, heads, body, no_data])


def _line_checks(text: Column) -> list[Column]:
    """Number of lines of all texts (a text may have several) and the sum of their hashes."""
    each = F.split(F.coalesce(text, _lit("")), "\n")
    return [F.sum(F.size(each)).alias("lines"), F.sum(F.aggregate(
        each, F.lit(0).cast("bigint"), lambda s, x: s + F.xxhash64(x).bitwiseAND(F.lit((1 << 31) - 1)))).alias("digest")]


def _file_checks(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, digest) of the text files below a folder; a file's name is that below the folder."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"((?:section=[^/]*/)?[^/]*)\z", 1)
    return spark.read.text(path).select(name.alias("file"), F.col("value")).groupBy("file").agg(*_line_checks(_c("value")))


def write_markdown(lines: DataFrame, path: str) -> None:
    """Write the ordered document as text files with a manifest (O-04).

    Lines are dealt into ranges of (section, sort_key) and sorted inside each, and a section
    has a folder of its own, so the document is its files in the order of section and file name.
    ``path/_manifest`` has name, lines and a digest of each file; the sums are held against those of
    the lines as they were written, so that a lost or repeated part is an error here, and one that
    is lost later is an error in ``read_markdown``.
    """
    order = [c for c in ("section", "sort_key") if c in lines.columns]
    spark, seen = lines.sparkSession, Observation()
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order).observe(seen, *_line_checks(_c("text")))
    if "section" in order:
        dealt.select("section", "text").write.mode("overwrite").partitionBy("section").text(f"{path}/document")
    else:
        dealt.select("text").write.mode("overwrite").text(f"{path}/document")
    files = [tuple(r) for r in _file_checks(spark, f"{path}/document").collect()]
    written, sent = [sum(f[1] for f in files), sum(f[2] for f in files)], [seen.get[c] or 0 for c in ("lines", "digest")]
    if written != sent:
        raise RuntimeError(f"{path}: {written[0]} lines in files, {sent[0]} were written, or their texts differ")
    spark.createDataFrame(files, "file string, lines bigint, digest bigint").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(line from 1, text) of a document that ``write_markdown`` wrote; an error if its files aren't those of the manifest."""
    own = {r.file: (r.lines, r.digest) for r in spark.read.schema("file string, lines bigint, digest bigint").json(f"{path}/_manifest").collect()}
    there = {f: (n, d) for f, n, d in _file_checks(spark, f"{path}/document").collect()}
    if own != there:
        raise RuntimeError(f"{path}: files lost, added or changed: {sorted(f for f in own.keys() | there.keys() if own.get(f) != there.get(f))}")

    def rank(name: str) -> tuple:
        section = re.match(r"section=(-?[0-9]+)/", name)
        return (int(section[1]) if section else 0, name)

    before, starts = 0, []
    for name in sorted(own, key=rank):
        starts.append((name, before))
        before += own[name][0]
    name = F.regexp_extract(F.col("_metadata.file_path"), r"((?:section=[^/]*/)?[^/]*)\z", 1)
    # A file that is split is read in blocks; inside a block ids rise with the lines.
    rows = spark.read.text(f"{path}/document").select(
        name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    within = F.row_number().over(Window.partitionBy("file").orderBy("block", "id"))
    return (rows.withColumn("at", within).join(spark.createDataFrame(starts, "file string, start bigint"), "file")
            .select((F.col("start") + F.col("at")).alias("line"), "text"))

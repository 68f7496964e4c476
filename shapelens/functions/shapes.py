"""Shapes of documents: paths and types without Python, at any depth.

A document's shape is the text of ``schema_of_variant``: names and types, nested,
without values. Few documents have a shape of their own, so shapes are counted
first and each distinct one is walked once (``shape_leaves``). Only whether a
``DOUBLE`` is a whole number hangs on the value; ``whole_doubles`` names those
paths of a document, and is evaluated for shapes with doubles alone.

Values and shapes are walked alike, level by level: each step replaces the objects of
an array by their entries, so the work is in proportion to the leaves and the depth. A
shape is written as JSON first. (A fold that appends to an array copies it at each step.)
An expression that is named more than once is bound first (``_let``), since Spark
would compute it each time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name in a shape: quoted, or of letters, digits and underscores.
NAME = r"(?:`((?:[^`]|``)*)`|([A-Za-z0-9_]+)): "
#: Tokens of a shape: a name, an opened object or array, a plain type, an end, a comma.
TOKEN = rf"{NAME}|(?:OBJECT|ARRAY)<|[A-Z][A-Z_]*(?:\([0-9,]+\))?|>|, "
OBJECT = "OBJECT<"
MAP = "map<string,variant>"
#: In the JSON of a shape, names begin with this, and an array is an object with the one key ``[``.
KEY = "k"
ARRAY = "["
#: Shapes with up to so many objects are walked that many levels deep; of others the depth is counted.
FEW = 4


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shape(doc) -> Column:
    """The shape of a VARIANT; null for a null document."""
    return F.schema_of_variant(_col(doc))


def is_object(shape_text) -> Column:
    return F.coalesce(F.startswith(_col(shape_text), F.lit(OBJECT)), F.lit(False))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _fewest_levels(rows: Column) -> Column:
    """Of rows (path, level, ...) with the same path the first with the fewest levels."""
    def later(marked: Column) -> Column:
        return F.filter(F.transform(marked, lambda m, i: F.when(
            (i > 0) & (F.get(marked, i - 1)["path"] == m["path"]), m["at"])), lambda at: at.isNotNull())

    def first_ones(rows: Column) -> Column:
        marked = F.array_sort(F.transform(rows, lambda r, i: F.struct(r["path"].alias("path"), r["level"].alias("level"), i.alias("at"))))
        return _let(_let(marked, later), lambda gone: F.filter(rows, lambda r, i: ~F.array_contains(gone, i)))

    return _let(rows, lambda rows: F.when(
        F.size(F.array_distinct(F.transform(rows, lambda r: r["path"]))) == F.size(rows), rows).otherwise(first_ones(rows)))


def _shape_json(shape_text: Column) -> Column:
    """A shape as VARIANT: objects, with the names of plain types as texts."""
    json_text = F.replace(F.replace(shape_text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    control = reduce(lambda c, i: F.replace(c, F.lit(chr(i)), F.lit(f"\\u{i:04x}")), range(32), json_text)
    json_text = F.when(F.rlike(shape_text, F.lit(r"[\x00-\x1F]")), control).otherwise(json_text)

    def write(token: Column) -> Column:
        name = F.regexp_replace(token, rf"\A{NAME}\z", f'"{KEY}$1$2": ')
        return (F.when(F.endswith(token, F.lit(": ")), name).when(token == OBJECT, "{").when(token == "ARRAY<", f'{{"{ARRAY}": ')
                .when(token == ">", "}").when(token == ", ", token).otherwise(F.concat(F.lit('"'), token, F.lit('"'))))

    return F.try_parse_json(F.array_join(F.transform(F.regexp_extract_all(json_text, F.lit(TOKEN), F.lit(0)), write), ""))


def _walk(doc: Column, levels: Column, entries_of: Callable[[Column], Column]) -> Column:
    """array<struct<path, level, value>> of the leaves below a VARIANT."""
    start = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(0).alias("level"), doc.alias("value")))

    def below(row: Column) -> Column:
        return F.transform(entries_of(row["value"]), lambda e: F.struct(
            F.concat_ws(".", row["path"], e["key"]).alias("path"), (row["level"] + 1).alias("level"), e["value"].alias("value")))

    def step(rows: Column, _: Column) -> Column:
        return F.flatten(F.transform(rows, lambda r: F.coalesce(below(r), F.array(r))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, step)


def _shape_entries(value: Column) -> Column:
    return _let(F.try_variant_get(value, "$", MAP), lambda m: F.when(
        ~F.map_contains_key(m, ARRAY), F.transform(F.map_entries(m), lambda e: F.struct(
            F.replace(F.substring(e["key"], 2, 1 << 30), F.lit("``"), F.lit("`")).alias("key"), e["value"].alias("value")))))


def _unlike_paths(rows: Column, shape_text: Column) -> Column:
    """Two paths can be the same only where a key has a dot, and type names have none."""
    return F.when(F.contains(shape_text, F.lit(".")), _fewest_levels(rows)).otherwise(rows)


def shape_leaves(shape_text) -> Column:
    """array<struct<path, level, type>> of a shape, null unless it is an object's.

    Everything but an object is a leaf; ``type`` is Spark's name of it, ``ARRAY`` for any
    array. Empty objects yield nothing. Of equal paths the one with fewer levels stays.
    """
    text = _col(shape_text)
    found = F.transform(_walk(_shape_json(text), levels(text), _shape_entries), lambda r: F.struct(
        r["path"].alias("path"), r["level"].alias("level"),
        F.coalesce(F.try_variant_get(r["value"], "$", "string"), F.lit("ARRAY")).alias("type")))
    # try_variant_get writes an object as text too: that of an array.
    typed = F.transform(found, lambda r: F.struct(r["path"].alias("path"), r["level"].alias("level"), F.when(
        F.startswith(r["type"], F.lit("{")), "ARRAY").otherwise(r["type"]).alias("type")))
    return F.when(is_object(text), _unlike_paths(typed, text))


def levels(shape_text) -> Column:
    """How many levels of objects a walk may meet: few objects, or the depth of the brackets."""
    objects = F.regexp_count(_col(shape_text), F.lit(OBJECT))
    return F.when(objects <= FEW, objects).otherwise(depth(shape_text))


def depth(shape_text) -> Column:
    """Levels of brackets in a shape: no value of the document is deeper."""
    marks = F.regexp_extract_all(F.regexp_replace(_col(shape_text), "`(?:[^`]|``)*`", ""), F.lit("[<>]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark == "<", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(now, state["most"]).alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def entries(doc) -> Column:
    """array<struct<key, value VARIANT>> of an object, null for any other value."""
    return F.map_entries(F.try_variant_get(_col(doc), "$", MAP))


def leaves(doc) -> Column:
    """array<struct<path, level, value VARIANT>> of an object, null for any other value."""
    doc = _col(doc)
    return _let(shape(doc), lambda text: F.when(is_object(text), _unlike_paths(_walk(doc, levels(text), entries), text)))


def whole_doubles(doc, shape_text) -> Column:
    """Sorted paths of a document whose value is a whole ``DOUBLE`` or ``FLOAT``; null where the shape has neither."""
    found = F.filter(leaves(doc), lambda r: shape(r["value"]).isin("DOUBLE", "FLOAT")
                     & (F.try_variant_get(r["value"], "$", "double") % 1 == 0))
    return F.when(F.rlike(_col(shape_text), F.lit(r"\b(?:DOUBLE|FLOAT)\b")), F.array_sort(F.transform(found, lambda r: r["path"])))


def leaf_type(leaf: Column, wholes: Column) -> Column:
    """Type name (as of ``value_type``) of a row of ``shape_leaves``; decimals of a shape have no idle zeros."""
    kind = leaf["type"]
    whole = F.coalesce(F.array_contains(wholes, leaf["path"]), F.lit(False))
    return (F.when(kind == "VOID", "null").when(kind == "ARRAY", "array").when(kind == "BOOLEAN", "boolean")
            .when(kind == "STRING", "string").when(kind.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), "date")
            .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | F.endswith(kind, F.lit(",0)")), "number")
            .when(kind.isin("DOUBLE", "FLOAT"), F.when(whole, "number").otherwise("double"))
            .when(F.startswith(kind, F.lit("DECIMAL")), "double").otherwise("unknown"))

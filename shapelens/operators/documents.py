"""Schema inference over document collections (O-18..O-20, O-32, O-33).

Documents are VARIANT values; text is parsed by ``try_parse_json`` first, so one
rule says what is valid. Paths and types are those of a document's shape
(``functions.shapes``): documents are counted by shape, with partial counts
inside each task, and each distinct shape is walked once. So a profile costs one
parse of each document, its shuffle moves a row for each shape and task, and
nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapelens.functions.shapes import is_object, leaf_type, leaves, shape, shape_leaves, whole_doubles
from shapelens.functions.values import pct

#: Type given to documents that are no objects, in rows without a path.
NO_OBJECT = "no object"


def as_variant(docs: DataFrame, doc_col: str) -> Column:
    """The document as VARIANT; null for text that does not parse."""
    if isinstance(docs.schema[doc_col].dataType, T.VariantType):
        return F.col(doc_col)
    return F.try_parse_json(F.col(doc_col).cast("string"))


def flatten_documents(docs: DataFrame, doc_col: str = "doc",
                      keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Nested objects -> one row per dotted leaf path (O-33).

    Returns ``keep`` columns + ``(path, value VARIANT)``. Arrays, nulls and
    dates are leaves; empty objects yield nothing; any depth, any characters in
    keys. A key with a dot can collide with a nested path (``{"a.b": 1, "a":
    {"b": 2}}``): the one with fewer levels stays.
    """
    rows = docs.select(*keep, F.explode(leaves(as_variant(docs, doc_col))).alias("_leaf"))
    return rows.select(*keep, F.col("_leaf.path").alias("path"), F.col("_leaf.value").alias("value"))


def document_shapes(docs: DataFrame, doc_col: str = "doc", by: Sequence[str] = ()) -> DataFrame:
    """``by`` + ``(_shape, _wholes)`` of each document; null shape for a null document."""
    parsed = docs.select(*by, as_variant(docs, doc_col).alias("_doc"))
    shaped = parsed.withColumn("_shape", shape("_doc"))
    return shaped.select(*by, "_shape", whole_doubles("_doc", "_shape").alias("_wholes"))


def typed_paths(shapes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` + ``(path, type)`` for each leaf of each row's shape, and a row with null path for the row itself.

    The row with null path has a null type for an object and ``NO_OBJECT`` for anything else.
    """
    own = F.struct(F.lit(None).cast("string").alias("path"), F.when(~is_object("_shape"), NO_OBJECT).alias("type"))
    found = F.transform(F.coalesce(shape_leaves("_shape"), F.array()),
                        lambda r: F.struct(r["path"].alias("path"), leaf_type(r, F.col("_wholes")).alias("type")))
    return shapes.select(*keep, F.inline(F.array_append(found, own)))


def _shape_counts(docs: DataFrame, doc_col: str, by: Sequence[str]) -> DataFrame:
    return document_shapes(docs, doc_col, by).groupBy(*by, "_shape", "_wholes").agg(F.count(F.lit(1)).alias("_n"))


def _counted(shapes: DataFrame, by: Sequence[str]) -> DataFrame:
    return typed_paths(shapes, [*by, "_n"]).groupBy(*by, "path", "type").agg(F.sum("_n").alias("type_count"))


def path_type_counts(docs: DataFrame, doc_col: str = "doc",
                     by: Sequence[str] = ()) -> DataFrame:
    """``by`` + ``(path, type, type_count)`` in one pass over the documents.

    Rows without a path count the documents of each group: those that are
    objects under the null type, the others under ``NO_OBJECT``.
    """
    return _counted(_shape_counts(docs, doc_col, by), by)


def object_documents(docs: DataFrame, doc_col: str = "doc", by: Sequence[str] = ()) -> DataFrame:
    """``by`` + number of documents that are objects (``docs``) and that aren't (``others``)."""
    own = is_object(shape(as_variant(docs, doc_col)))
    return docs.select(*by, own.alias("_is")).groupBy(*by).agg(
        F.count_if("_is").alias("docs"), F.count_if(~F.col("_is")).alias("others"))


def with_percentages(counts: DataFrame, objects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Field-profile columns from the rows of ``path_type_counts`` and ``by`` + ``_docs`` of the object documents."""
    by = list(by)
    per_type = counts.where(F.col("path").isNotNull()).withColumn(
        "occurrences", F.sum("type_count").over(Window.partitionBy(*by, "path")))
    if by:
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
        per_type = per_type.alias("p").join(objects.alias("t"), same).select("p.*", "_docs")
    else:
        per_type = per_type.withColumn("_docs", objects.select("_docs").scalar())
    return per_type.select(
        *by, "path", "type",
        F.col("type_count").cast("bigint"),
        pct(F.col("type_count"), F.col("occurrences")).alias("type_pct"),
        F.col("occurrences").cast("bigint"),
        pct(F.col("occurrences"), F.col("_docs")).alias("occurrence_pct"))


def field_profile(docs: DataFrame, doc_col: str = "doc",
                  by: Sequence[str] = ()) -> DataFrame:
    """Per path and type: counts and percentages (O-18).

    ``doc_col`` is VARIANT or JSON text. Returns ``by`` + ``(path, type,
    type_count, type_pct, occurrences, occurrence_pct)``; ``type_pct`` is
    relative to the path's occurrences, ``occurrence_pct`` to all object
    documents (of the group). Documents that are no objects are not profiled;
    ``object_documents`` counts them. Totals come from the counts by shape
    (Spark reuses their exchange), so documents are parsed once and no job runs
    before the caller's own.
    """
    shapes = _shape_counts(docs, doc_col, by)
    # No filter, which Spark would push below the exchange that both sides share.
    objects = shapes.groupBy(*by).agg(F.coalesce(F.sum(F.when(is_object("_shape"), F.col("_n"))), F.lit(0)).alias("_docs"))
    return with_percentages(_counted(shapes, by), objects, by)


def document_columns(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Field profile -> canonical column rows (O-20).

    ``type`` reads ``string(95%) | null(5%)`` (percent desc, then type name);
    ``nullable`` when the path is missing from some documents; ``comment``
    ``Occurs in N% of documents``.
    """
    by = list(by)
    grouped = profile.groupBy(*by, "path").agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.col("type_pct")).alias("neg_pct"), F.col("type"),
            F.col("type_pct")))).alias("types"),
        F.first("occurrence_pct").alias("occurrence_pct"))
    type_text = F.array_join(F.transform(F.col("types"), lambda t: F.concat(
        t["type"], F.lit("("), t["type_pct"].cast("string"), F.lit("%)"))), " | ")
    return grouped.select(
        *by, F.col("path").alias("name"), type_text.alias("type"),
        (F.col("occurrence_pct") < 100).alias("nullable"),
        F.concat(F.lit("Occurs in "), F.col("occurrence_pct").cast("string"),
                 F.lit("% of documents")).alias("comment"))


def sample_order(id_col: Column, seed: str) -> Column:
    """Reproducible pseudo-random order key: md5 of seed and id."""
    return F.md5(F.concat(F.lit(seed), id_col.cast("string")))


def sample_documents(df: DataFrame, id_col: str = "doc_id", n: int = 1000,
                     seed: str = "0") -> DataFrame:
    """Exactly ``min(n, count)`` documents, the same ones on every run (O-32)."""
    return _first_in_order(df, [], id_col, n, seed)


def sample_documents_per_group(df: DataFrame, group: str, id_col: str,
                               n: int, seed: str = "0") -> DataFrame:
    """The same sample rule applied within each group; null is a group."""
    return _first_in_order(df, [group], id_col, n, seed)


def _first_in_order(df: DataFrame, by: Sequence[str], id_col: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows of each group that come first in ``sample_order``, then by id, without an order of them all.

    The order is cut into 65,536 slices by its first digits. Rows are counted by slice (ids alone are
    read), and the slice in which the sample ends follows from the running sum. Rows of
    earlier slices are taken as they are read; only those of the last slice are ranked.
    """
    if n <= 0:
        return df.limit(0)
    taken = {c.lower() for c in df.columns}
    mark = "_"  # so long that no column of the sample's own has a name of the table's
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    at, end, rest, rank = (mark + c for c in ("slice", "end", "rest", "rank"))
    order = sample_order(F.col(id_col), seed)
    slice_no = F.coalesce(F.conv(F.substring(order, 1, 4), 16, 10).cast("int"), F.lit(-1))
    keys = [f"{mark}by{i}" for i in range(len(by))]
    counts = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], slice_no.alias(at)).groupBy(*keys, at).agg(
        F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("reached", F.sum("n").over(Window.partitionBy(*keys).orderBy(at)))
    # One row a group: the slice in which the n-th row is, and how many rows of it belong to the sample.
    ends = counts.where((F.col("reached") >= n) & (F.col("reached") - F.col("n") < n)).select(
        *keys, F.col(at).alias(end), (n - F.col("reached") + F.col("n")).alias(rest))
    rows = df.withColumn(at, slice_no)
    if by:
        rows = rows.join(ends, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], "left")
    else:
        rows = rows.withColumns({end: ends.select(end).scalar(), rest: ends.select(rest).scalar()})
    whole = rows.where(F.col(end).isNull() | (F.col(at) < F.col(end)))
    ranked = rows.where(F.col(at) == F.col(end)).withColumn(rank, F.row_number().over(
        Window.partitionBy(*by, at).orderBy(order, F.col(id_col))))
    return whole.select(*df.columns).unionAll(ranked.where(F.col(rank) <= F.col(rest)).select(*df.columns))


def collection_profile(docs: DataFrame, collection_col: str = "collection",
                       doc_col: str = "doc") -> DataFrame:
    """Per collection: (collection, document_count, sample_size, field_count) (O-19).

    Every document is profiled, so ``sample_size`` is the number of documents.
    One pass: document and field counts follow from the same path counts.
    """
    per_path = path_type_counts(docs, doc_col, [collection_col]).groupBy(collection_col, "path").agg(
        F.sum("type_count").alias("n"))
    out = per_path.groupBy(collection_col).agg(
        F.sum(F.when(F.col("path").isNull(), F.col("n"))).cast("bigint").alias("document_count"),
        F.count("path").cast("bigint").alias("field_count"))
    return out.select(F.col(collection_col).alias("collection"), "document_count",
                      F.col("document_count").alias("sample_size"), "field_count")

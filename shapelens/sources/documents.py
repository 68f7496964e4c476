"""Document collections as VARIANT rows (O-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelens.functions.shapes import is_object, shape


def read_documents(df: DataFrame, json_col: str = "json", id_col: str = "doc_id",
                   collection_col: str | None = None) -> DataFrame:
    """Parse JSON text into ``doc VARIANT``; malformed text is kept and flagged.

    Returns ``(doc_id, [collection,] doc, is_valid, is_object)``. ``is_valid``
    is false for text that does not parse (including duplicate keys);
    ``is_object`` is true only for documents whose root is an object.
    """
    doc = F.try_parse_json(F.col(json_col))
    cols = [F.col(id_col).alias("doc_id")]
    if collection_col:
        cols.append(F.col(collection_col).alias("collection"))
    opens = F.coalesce(F.ltrim(F.col(json_col), F.lit(" \t\r\n")).startswith("{"), F.lit(False))
    return df.select(*cols, doc.alias("doc"), opens.alias("_opens")).select(
        "*",
        F.col("doc").isNotNull().alias("is_valid"),
        (F.col("doc").isNotNull() & F.col("_opens")).alias("is_object")).drop("_opens")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines at ``path`` as ``(doc VARIANT, malformed, is_valid, is_object)`` (O-01).

    Spark's JSON reader parses each record straight into a VARIANT, so files are split and
    read as they are, not as text first. ``malformed`` is the text of a line that does not parse (duplicate
    keys included), and null otherwise; blank lines are no records.
    """
    rows = (spark.read.schema("doc variant, _corrupt_record string")
            .options(singleVariantColumn="doc", columnNameOfCorruptRecord="_corrupt_record").json(path))
    valid = F.col("_corrupt_record").isNull() & F.col("doc").isNotNull()
    return rows.select("doc", F.col("_corrupt_record").alias("malformed"), valid.alias("is_valid"),
                       (valid & is_object(shape("doc"))).alias("is_object"))


def document_validity(docs: DataFrame) -> DataFrame:
    """(total, valid, objects) counts of a parsed collection (O-01 summary)."""
    return docs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_valid")).alias("valid"),
        F.count_if(F.col("is_object")).alias("objects"))

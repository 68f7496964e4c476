"""Checked queries for document schema inference (O-01, O-18..O-20, O-32..O-35)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shapelens.functions.values import pct
from shapelens.functions.values import value_type
from shapelens.operators.documents import (collection_profile, document_columns,
                                           field_profile, flatten_documents,
                                           object_documents, sample_documents)
from shapelens.plans import duck
from shapelens.plans.inputs import EVENT_DOCUMENTS, ORDER_DOCUMENTS
from shapelens.plans.registry import duck_sql, query, spark_sql
from shapelens.session import ensure_checkpoint_dir, read_table
from shapelens.sources.documents import document_validity, read_documents, read_json_lines

_ORDER_DOCS = duck_sql(ORDER_DOCUMENTS)
_EVENT_DOCS = duck_sql(EVENT_DOCUMENTS)

# Mixed validity: event bodies (objects), page HTML (not JSON) and one JSON
# array per order (valid, not an object).
MIXED_TEXT = """
SELECT event_id AS doc_id, props AS json FROM {events}
UNION ALL SELECT page_id AS doc_id, html AS json FROM {pages}
UNION ALL SELECT o_orderkey AS doc_id,
                 concat('[', CAST(o_orderkey AS STRING), ', "x"]') AS json FROM {orders}
"""


def order_docs(spark, sf):
    return read_documents(spark_sql(spark, sf, ORDER_DOCUMENTS), "json", "doc_id",
                          "collection")


def _profile_oracle(docs: str) -> str:
    return f"""
WITH d AS ({docs}),
l AS ({duck.json_leaves('d')}),
pt AS (SELECT path, type, count(*) AS type_count FROM l GROUP BY path, type),
pp AS (SELECT *, sum(type_count) OVER (PARTITION BY path) AS occurrences FROM pt),
n AS (SELECT count(*) AS docs FROM d)
SELECT path, type, CAST(type_count AS BIGINT) AS type_count,
       {duck.pct('type_count', 'occurrences')} AS type_pct,
       CAST(occurrences AS BIGINT) AS occurrences,
       {duck.pct('occurrences', 'docs')} AS occurrence_pct
FROM pp, n
"""


@query("read_documents", f"""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE json_valid(json)) AS BIGINT) AS valid,
       CAST(count(*) FILTER (WHERE CASE WHEN json_valid(json) THEN json_type(json) END = 'OBJECT')
            AS BIGINT) AS objects
FROM ({duck_sql(MIXED_TEXT)})
""")
def q_read_documents(spark, sf):
    docs = read_documents(spark_sql(spark, sf, MIXED_TEXT), "json", "doc_id")
    return document_validity(docs).select(
        *[F.col(c).cast("bigint") for c in ("total", "valid", "objects")])


# Lines as a log would have them: every seventh event is cut short, every eleventh is an array.
JSON_LINES = """
SELECT CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1)
            WHEN event_id % 11 = 0 THEN concat('[', props, ']') ELSE props END AS json FROM {events}
"""


@query("read_json_lines", f"""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE json_valid(json)) AS BIGINT) AS valid,
       CAST(count(*) FILTER (WHERE CASE WHEN json_valid(json) THEN json_type(json) END = 'OBJECT') AS BIGINT) AS objects
FROM ({duck_sql(JSON_LINES)})
""")
def q_read_json_lines(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    spark_sql(spark, sf, JSON_LINES).write.text(path)
    return document_validity(read_json_lines(spark, path)).select(*[F.col(c).cast("bigint") for c in ("total", "valid", "objects")])


@query("flatten_documents", f"""
WITH d AS ({_ORDER_DOCS}), l AS ({duck.json_leaves('d', 'CAST(t.value AS VARCHAR) AS v')})
SELECT doc_id, path, CASE WHEN type NOT IN ('number', 'double') THEN v END AS value,
       CASE WHEN type IN ('number', 'double') THEN CAST(v AS DOUBLE) END AS number, type FROM l
""")
def q_flatten_documents(spark, sf):
    flat = flatten_documents(order_docs(spark, sf))
    kind = value_type("value")
    number = F.when(kind.isin("number", "double"), F.try_variant_get("value", "$", "double"))
    # Engines print numbers differently (4 and 4.0): numbers are compared as numbers.
    text = F.when(~kind.isin("number", "double"), F.coalesce(F.to_json("value"), F.lit("null")))
    return flat.select("doc_id", "path", text.alias("value"), number.alias("number"), kind.alias("type"))


@query("value_type", f"""
WITH d AS ({_ORDER_DOCS}), l AS ({duck.json_leaves('d')})
SELECT type, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY type
""")
def q_value_type(spark, sf):
    flat = flatten_documents(order_docs(spark, sf))
    return flat.select(value_type("value").alias("type")).groupBy("type").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@query("object_documents", f"""
SELECT CAST(count(*) FILTER (WHERE CASE WHEN json_valid(json) THEN json_type(json) END = 'OBJECT')
            AS BIGINT) AS docs,
       CAST(count(*) FILTER (WHERE coalesce(CASE WHEN json_valid(json) THEN json_type(json) END, '')
            <> 'OBJECT') AS BIGINT) AS others
FROM ({duck_sql(MIXED_TEXT)})
""")
def q_object_documents(spark, sf):
    return object_documents(spark_sql(spark, sf, MIXED_TEXT), "json")


@query("pct", f"""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, CAST(n AS BIGINT) AS n,
       {duck.pct('n', '(SELECT count(*) FROM events)')} AS share_pct
FROM c
""")
def q_pct(spark, sf):
    ev = read_table(spark, sf, "events")
    total = ev.select(F.count(F.lit(1))).scalar()
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        "event_type", F.col("n").cast("bigint"), pct(F.col("n"), total).alias("share_pct"))


@query("field_profile", _profile_oracle(_ORDER_DOCS))
def q_field_profile(spark, sf):
    # JSON text straight into the profile: one parse per document.
    return field_profile(spark_sql(spark, sf, ORDER_DOCUMENTS), "json")


@query("field_profile_events", _profile_oracle(_EVENT_DOCS))
def q_field_profile_events(spark, sf):
    return field_profile(spark_sql(spark, sf, EVENT_DOCUMENTS), "json")


@query("document_columns", f"""
WITH p AS ({_profile_oracle(_ORDER_DOCS)})
SELECT path AS name,
       string_agg(type || '(' || CAST(type_pct AS VARCHAR) || '%)', ' | '
                  ORDER BY type_pct DESC, type) AS type,
       max(occurrence_pct) < 100 AS nullable,
       'Occurs in ' || CAST(max(occurrence_pct) AS VARCHAR) || '% of documents' AS comment
FROM p GROUP BY path
""")
def q_document_columns(spark, sf):
    return document_columns(field_profile(spark_sql(spark, sf, ORDER_DOCUMENTS), "json"))


@query("sample_documents", """
SELECT event_id, event_type FROM events
ORDER BY md5(concat('0', CAST(event_id AS VARCHAR))), event_id LIMIT 1000
""")
def q_sample_documents(spark, sf):
    ev = read_table(spark, sf, "events")
    return sample_documents(ev, "event_id", 1000, seed="0").select("event_id", "event_type")


@query("collection_profile", f"""
WITH d AS ({_ORDER_DOCS}),
c AS (SELECT collection, count(*) AS document_count FROM d GROUP BY collection),
l AS ({duck.json_leaves('d', 'd.collection')}),
f AS (SELECT collection, count(DISTINCT path) AS field_count FROM l GROUP BY collection)
SELECT c.collection, CAST(document_count AS BIGINT) AS document_count,
       CAST(document_count AS BIGINT) AS sample_size,
       CAST(coalesce(field_count, 0) AS BIGINT) AS field_count
FROM c LEFT JOIN f USING (collection)
""")
def q_collection_profile(spark, sf):
    return collection_profile(order_docs(spark, sf), "collection", "doc")

"""Shape-mapped inputs built from the testdata tables.

Each template is SQL that Spark and DuckDB both run unchanged (``{table}``
names a testdata table), so operator and oracle start from identical rows.
Column names of the testdata are meaningless here; the sizes, groups, ties and
nulls are real. Literal braces are doubled for ``str.format``.
"""

# Key listing: event keys, page URLs, customer and nation names, each with a
# store type.
KEY_LISTING = """
SELECT concat('user:', CAST(user_id AS STRING), ':', event_type) AS key,
       'string' AS type FROM {events}
UNION ALL SELECT url AS key, 'hash' AS type FROM {pages}
UNION ALL SELECT c_name AS key, 'list' AS type FROM {customer}
UNION ALL SELECT n_name AS key, 'zset' AS type FROM {nation}
"""

# Hierarchical keys: page URLs without scheme, query and fragment, plus
# /<source>/<lang>/<doc_id> for every document.
PREFIX_KEYS = """
SELECT concat('/', regexp_replace(regexp_replace(url, '^[a-z]+://', ''),
                                  '[?#].*$', '')) AS key FROM {pages}
UNION ALL
SELECT concat('/', source, '/', lang, '/', CAST(doc_id AS STRING)) AS key
FROM {documents}
"""

# Nested JSON documents, one per order, with nulls, mixed types, missing keys,
# empty objects, arrays and three levels of nesting chosen by o_orderkey.
ORDER_DOCUMENTS = """
SELECT o_orderkey AS doc_id, o_orderstatus AS collection,
  concat('{{"_id": ', CAST(o_orderkey AS STRING),
    ', "cust": ', CAST(o_custkey AS STRING),
    ', "status": "', o_orderstatus, '"',
    ', "prio": ', CASE o_orderkey % 5 WHEN 0 THEN 'null'
                   WHEN 1 THEN CAST(o_orderkey % 7 AS STRING)
                   ELSE concat('"', o_orderpriority, '"') END,
    ', "total": ', CASE WHEN o_orderkey % 4 = 0
                   THEN concat(CAST(o_custkey % 9 AS STRING), '.0')
                   ELSE concat(CAST(o_custkey % 100 AS STRING), '.25') END,
    ', "date": "', CAST(CAST(o_orderdate AS DATE) AS STRING), '"',
    ', "tags": [', CAST(o_orderkey % 3 AS STRING), ', "x"]',
    ', "flag": ', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END,
    CASE o_orderkey % 6 WHEN 0 THEN ', "meta": null'
      WHEN 1 THEN ', "meta": {{}}'
      WHEN 2 THEN ''
      ELSE concat(', "meta": {{"level": ', CAST(o_orderkey % 10 AS STRING),
                  ', "owner": {{"id": ', CAST(o_custkey AS STRING),
                  ', "name": "c', CAST(o_custkey AS STRING), '"}}',
                  CASE WHEN o_orderkey % 3 = 0 THEN ', "note": null'
                       ELSE ', "note": "n"' END, '}}') END,
    '}}') AS json
FROM {orders}
"""

# Event bodies: flat {"k": n} documents grouped by event type.
EVENT_DOCUMENTS = """
SELECT event_id AS doc_id, event_type AS collection, props AS json FROM {events}
"""

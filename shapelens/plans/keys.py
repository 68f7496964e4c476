"""Checked queries for key-space analysis (O-02, O-21..O-23, O-31, O-36, O-37)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapelens.functions.keys import key_prefixes, key_template
from shapelens.operators.keys import (key_template_groups, key_totals,
                                      prefix_rollup, top_n_per_group)
from shapelens.plans import duck
from shapelens.plans.inputs import KEY_LISTING, PREFIX_KEYS
from shapelens.plans.registry import duck_sql, query, spark_sql
from shapelens.session import read_table
from shapelens.sources.keys import scan_keys

_KEYS = duck_sql(KEY_LISTING)
_PREFIX_KEYS = duck_sql(PREFIX_KEYS)


def _text_list(col: str):
    return F.array_join(F.col(col), ", ")


def _text_map(col: str):
    return F.array_join(F.transform(F.sort_array(F.map_entries(F.col(col))),
                                    lambda e: F.concat(e["key"], F.lit(": "),
                                                       e["value"].cast("string"))),
                        ", ")


@query("scan_keys", f"""
SELECT key FROM ({_KEYS}) WHERE key GLOB 'user:1*'
""")
def q_scan_keys(spark, sf):
    return scan_keys(spark_sql(spark, sf, KEY_LISTING), "key", glob="user:1*") \
        .select("key")


@query("key_template", f"""
SELECT key, type, {duck.key_template('key')} AS pattern FROM ({_KEYS})
""")
def q_key_template(spark, sf):
    keys = spark_sql(spark, sf, KEY_LISTING)
    return keys.select("key", "type", key_template("key").alias("pattern"))


@query("key_template_groups", f"""
WITH t AS (SELECT key, type, {duck.key_template('key')} AS pattern FROM ({_KEYS})),
pt AS (SELECT pattern, type, count(*) AS n FROM t GROUP BY pattern, type),
c AS (SELECT pattern, CAST(sum(n) AS BIGINT) AS count,
             string_agg(type || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY type) AS types
      FROM pt GROUP BY pattern),
r AS (SELECT pattern, key, row_number() OVER (PARTITION BY pattern ORDER BY key) AS rn
      FROM t),
s AS (SELECT pattern, string_agg(key, ', ' ORDER BY key) AS sample_keys
      FROM r WHERE rn <= 10 GROUP BY pattern)
SELECT c.pattern, c.count, c.types, s.sample_keys FROM c JOIN s USING (pattern)
""")
def q_key_template_groups(spark, sf):
    groups = key_template_groups(spark_sql(spark, sf, KEY_LISTING), "key", "type", 10)
    return groups.select("pattern", F.col("count").cast("bigint"),
                         _text_map("types").alias("types"),
                         _text_list("sample_keys").alias("sample_keys"))


@query("top_n_per_group", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               l_shipdate) AS rn
  FROM lineitem) WHERE rn <= 2
""")
def q_top_n_per_group(spark, sf):
    li = read_table(spark, sf, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey",
                                "l_quantity", "l_extendedprice", "l_shipdate")]
    return top_n_per_group(li, "l_orderkey", order, 2).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_DUCK_PREFIXES = f"""
k AS (SELECT DISTINCT key FROM ({_PREFIX_KEYS}) WHERE key IS NOT NULL),
p AS (SELECT key, list_filter(string_split(key, '/'), lambda x: x <> '') AS parts FROM k),
e AS (SELECT key, d AS depth,
             '/' || array_to_string(list_slice(parts, 1, d), '/') || '/' AS prefix
      FROM p, unnest(range(1, len(parts) + 1)) AS u(d))
"""


@query("key_prefixes", f"""
WITH {_DUCK_PREFIXES}
SELECT key, CAST(depth AS INTEGER) AS depth, prefix FROM e
""")
def q_key_prefixes(spark, sf):
    keys = spark_sql(spark, sf, PREFIX_KEYS).where(F.col("key").isNotNull()).distinct()
    return keys.select("key", F.inline(key_prefixes("key")))


_DUCK_ROLLUP = f"""
WITH {_DUCK_PREFIXES},
c AS (SELECT prefix, CAST(depth AS INTEGER) AS depth, count(*) AS count
      FROM e GROUP BY prefix, depth),
kept AS (SELECT * FROM c WHERE depth = 1 OR count >= 2),
r AS (SELECT e.prefix, e.key,
             row_number() OVER (PARTITION BY e.prefix ORDER BY e.key) AS rn
      FROM e JOIN kept USING (prefix)),
s AS (SELECT prefix, string_agg(key, ', ' ORDER BY key) AS sample_keys
      FROM r WHERE rn <= 5 GROUP BY prefix)
"""


@query("prefix_rollup", _DUCK_ROLLUP + """
SELECT kept.prefix, kept.depth, CAST(kept.count AS BIGINT) AS count, s.sample_keys
FROM kept JOIN s USING (prefix)
""")
def q_prefix_rollup(spark, sf):
    roll = prefix_rollup(spark_sql(spark, sf, PREFIX_KEYS), "key", n=5)
    return roll.select("prefix", "depth", F.col("count").cast("bigint"),
                       _text_list("sample_keys").alias("sample_keys"))


@query("key_totals", _DUCK_ROLLUP + f"""
SELECT (SELECT CAST(count(key) AS BIGINT) FROM ({_PREFIX_KEYS})) AS scanned_keys,
       (SELECT CAST(count(DISTINCT key) AS BIGINT) FROM ({_PREFIX_KEYS})) AS distinct_keys,
       (SELECT CAST(sum(count) AS BIGINT) FROM kept) AS overlapped_total
""")
def q_key_totals(spark, sf):
    keys = spark_sql(spark, sf, PREFIX_KEYS)
    return key_totals(keys, prefix_rollup(keys, "key", samples=False), "key")

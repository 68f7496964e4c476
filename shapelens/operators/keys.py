"""Key-space analysis: templates, prefix roll-ups, totals (O-21..O-23, O-31).

Skew: one template or prefix may own most keys (``user:*``). Counts go through
partial (map-side) aggregation and samples through a ranked window that Catalyst
turns into a ``WindowGroupLimit`` before the shuffle, so a hot group never moves
more than ``n`` sample rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelens.functions.keys import key_template, normal_path
from shapelens.functions.tries import fold_paths


def top_n_per_group(df: DataFrame, group: str | Sequence[str],
                    order: Sequence[Column], n: int) -> DataFrame:
    """Keep the first ``n`` rows of each group under a total order (O-31)."""
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(w))
            .filter(F.col("_rank") <= n)
            .drop("_rank"))


def sample_keys_per_group(df: DataFrame, group: str, key: str, n: int,
                          alias: str = "sample_keys") -> DataFrame:
    """(group, sorted array of the ``n`` smallest keys) for each group."""
    top = top_n_per_group(df.select(group, key), group, [F.col(key).asc()], n)
    return top.groupBy(group).agg(
        F.sort_array(F.collect_list(key)).alias(alias))


def key_template_groups(keys: DataFrame, key_col: str = "key",
                        type_col: str | None = "type", n: int = 10) -> DataFrame:
    """Group keys by template (O-21).

    Returns ``(pattern, count, types map<string,bigint>, sample_keys array<string>)``
    ordered by count desc, pattern. Sample keys are the ``n`` smallest keys of
    the template; every input key is counted.
    """
    typed = keys.select(
        F.col(key_col).alias("key"),
        (F.col(type_col) if type_col else F.lit(None).cast("string")).alias("type"),
    ).withColumn("pattern", key_template(F.col("key")))

    per_type = typed.groupBy("pattern", "type").agg(F.count(F.lit(1)).alias("n"))
    counts = per_type.groupBy("pattern").agg(
        F.sum("n").alias("count"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.when(F.col("type").isNotNull(),
                   F.struct(F.col("type"), F.col("n")))))).alias("types"),
    )
    samples = sample_keys_per_group(typed, "pattern", "key", n)
    return (counts.join(samples, "pattern")
            .select("pattern", "count", "types", "sample_keys")
            .orderBy(F.col("count").desc(), F.col("pattern")))


def distinct_keys(keys: DataFrame, key_col: str = "key") -> DataFrame:
    """(key, n): every distinct key, null included, with its number of rows."""
    return keys.groupBy(F.col(key_col).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def prefix_rollup(keys: DataFrame, key_col: str = "key", n: int = 5,
                  samples: bool = True) -> DataFrame:
    """Distinct keys under every ``/`` prefix (O-22).

    Kept: depth 1, or prefixes with at least two keys; ordered by depth,
    count desc, prefix. Returns ``(prefix, depth, count, sample_keys
    array<string>)``, the ``n`` smallest keys; without ``samples`` that column is
    left out.

    Distinct keys are sorted into ranges, so the keys under a prefix are neighbours and
    each task folds its part of the trie on the way (``functions.tries``): a prefix that ends
    inside a range is complete there, and one with a single key goes no further. So a key
    is moved once, whatever its depth, and what is moved after that are kept
    prefixes and those at the edges of ranges. A hot prefix spreads over as many ranges as it has keys for.
    """
    named = distinct_keys(keys, key_col).where(F.col("key").isNotNull()).select("key", normal_path("key").alias("path"))
    folded = fold_paths(named.where(F.col("path") != "//").repartitionByRange("path").sortWithinPartitions("path"), n if samples else 0)
    whole = folded.groupBy("prefix", "depth").agg(
        F.sum("count").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("sample_keys"))), 1, n).alias("sample_keys"))
    kept = whole.where((F.col("depth") == 1) | (F.col("count") >= 2))
    return kept.select("prefix", "depth", "count", *["sample_keys"] * samples).orderBy("depth", F.col("count").desc(), "prefix")


def key_totals(keys: DataFrame, rollup: DataFrame,
               key_col: str = "key") -> DataFrame:
    """(scanned_keys, distinct_keys, overlapped_total) (O-23).

    ``overlapped_total`` is the sum of counts over the kept prefixes, which
    counts a key once per kept prefix above it. Null keys count in neither.
    """
    totals = distinct_keys(keys, key_col).where(F.col("key").isNotNull()).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("scanned_keys"),
        F.count(F.lit(1)).alias("distinct_keys"))
    overlapped = rollup.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint")
                            .alias("overlapped_total"))
    return totals.select(
        F.col("scanned_keys").cast("bigint"),
        F.col("distinct_keys").cast("bigint"),
        overlapped.scalar().alias("overlapped_total"))

"""Profiles of lake tables measured from data (O-15, O-39, O-40).

Lake schemas declare every column nullable and no keys; these operators
measure nullability, lengths, key uniqueness and key inclusion instead.
``column_sketches`` uses mergeable sketches, so that a new partition costs a
scan of itself; ``minimal_keys`` moves all rows only for sets of columns that no slice of the rows rules out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapelens.session import footer_session, no_less, shared_table, union_all

#: Shares of the values below which ``quantiles`` of a profile lie.
QUANTILES = (0.25, 0.5, 0.75)
#: Longer texts are compared by a digest.
LONG_TEXT = 64
#: Rows in the first slice that a possible key is tested on, how much larger each further one is, and the least slices in all rows.
SLICE_ROWS, SLICE_STEP, SLICE_LEAST = 1 << 13, 8, 4
#: A table of so many hashes is sent to every task.
FEW_HASHES = 1 << 16
#: ``GROUPING SETS`` takes 64 columns.
GROUPED_COLUMNS = 60

def check_foreign_key(child: DataFrame, child_cols: Sequence[str],
                      parent: DataFrame, parent_cols: Sequence[str]) -> DataFrame:
    """Does every child key occur in the parent? (O-15)

    Returns (child_rows, null_rows, orphan_rows, holds) from one scan of each
    side: child rows are counted per distinct key first (a hot key becomes one
    row before any shuffle), the distinct parent keys are left-joined, and one
    aggregate yields all totals. Keys with a null part never match.
    """
    child_cols, parent_cols = list(child_cols), list(parent_cols)
    keys = [f"_k{i}" for i in range(len(child_cols))]
    keyed = child.select(*[F.col(c).alias(k) for c, k in zip(child_cols, keys)])
    per_key = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parent_keys = parent.select(*[F.col(c).alias(k) for c, k in zip(parent_cols, keys)]) \
        .distinct().withColumn("_found", F.lit(True))
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    joined = per_key.join(parent_keys, keys, "left")
    totals = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("child_rows"),
        F.coalesce(F.sum(F.when(any_null, F.col("_n"))), F.lit(0)).cast("bigint")
        .alias("null_rows"),
        F.coalesce(F.sum(F.when(~any_null & F.col("_found").isNull(), F.col("_n"))), F.lit(0))
        .cast("bigint").alias("orphan_rows"))
    return totals.withColumn("holds", F.col("orphan_rows") == 0)


def _string_like(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def _at(name: str) -> str:
    """The name as a column reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column_profile(df: DataFrame, approx: bool = True) -> DataFrame:
    """One row per column: (column, type, non_null, nulls, nullable, max_length
    [, distinct_approx]) from a single aggregation pass (O-39).

    One wide aggregate and one unpivot, so a table with hundreds of columns is
    scanned and analysed once, not per column.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    rows = []
    for i, f in enumerate(df.schema.fields):
        col = F.col(_at(f.name))
        longest = F.max(F.length(col)) if _string_like(f.dataType) else F.lit(None).cast("int")
        aggs += [F.count(col).alias(f"_nn{i}"), longest.alias(f"_ml{i}")]
        nulls = F.col("_rows") - F.col(f"_nn{i}")
        parts = [F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f"_nn{i}").cast("bigint").alias("non_null"),
                 nulls.cast("bigint").alias("nulls"), (nulls > 0).alias("nullable"),
                 F.col(f"_ml{i}").cast("int").alias("max_length")]
        if approx:
            aggs.append(F.approx_count_distinct(col).alias(f"_ad{i}"))
            parts.append(F.col(f"_ad{i}").cast("bigint").alias("distinct_approx"))
        rows.append(F.struct(*parts))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def unique_keys(df: DataFrame, candidates: Sequence[Sequence[str]],
                table: str | None = None) -> DataFrame:
    """Test candidate keys on data (O-40).

    Returns one row per candidate: (columns, rows, distinct_rows, has_null,
    is_unique). All candidates of a table come from one scan: a GROUPING SETS
    aggregate (partial, map-side, so a hot key value is one row per task) and a
    second small aggregate per set. Keys are grouped, not count-distinct, so the
    work spills instead of failing; ``is_unique`` needs no duplicate and no null.

    A candidate is a set of columns: permuted candidates share one grouping and
    each gets its own line. An empty table gives a line of zeros for each.
    """
    labels = list(dict.fromkeys(tuple(c) for c in candidates))
    cols = sorted({c for own in labels for c in own})
    sets = list(dict.fromkeys(tuple(c for c in cols if c in own) for own in labels))
    gid = {own: sum(1 << (len(cols) - 1 - j) for j, c in enumerate(cols) if c not in own)
           for own in sets}
    any_null = F.lit(False)
    for own in sets:
        null = reduce(lambda a, b: a | b, [F.col(_at(c)).isNull() for c in own])
        any_null = F.when(F.col("_gid") == gid[own], null).otherwise(any_null)
    per_key = df.groupingSets([[F.col(_at(c)) for c in own] for own in sets],
                              *[F.col(_at(c)) for c in cols]).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n"))
    per_set = per_key.withColumn("_null", any_null).groupBy("_gid").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_keys"), F.max("_n").alias("_most"),
        F.max("_null").alias("_null"))
    names = [(", ".join(own) if table is None else f"{table}({', '.join(own)})",
              gid[tuple(c for c in cols if c in own)]) for own in labels]
    listed = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(text).alias("columns"), F.lit(g).cast("bigint").alias("_gid"))
        for text, g in names])))
    zero, no = F.lit(0), F.lit(False)
    return listed.join(per_set, "_gid", "left").select(
        "columns", F.coalesce("_rows", zero).cast("bigint").alias("rows"),
        F.coalesce("_keys", zero).cast("bigint").alias("distinct_rows"),
        F.coalesce("_null", no).alias("has_null"),
        ((F.coalesce("_most", zero) <= 1) & ~F.coalesce("_null", no)).alias("is_unique"))


def _hash(*names: str) -> Column:
    """64 bits for the values of some columns; null where one is null."""
    return F.when(~reduce(lambda a, b: a | b, [F.col(_at(c)).isNull() for c in names]), F.xxhash64(*[F.col(_at(c)) for c in names]))


def column_sketches(df: DataFrame, part: Column | None = None, lg_k: int = 14) -> DataFrame:
    """Mergeable profile of each column (O-39), one row per ``part`` (an expression; one part if None) and column.

    Returns (part, column, type, rows, non_null, max_length, distinct binary, quantiles
    binary): a HyperLogLog sketch of the values' hashes and, for numbers, a KLL sketch. One
    pass, one wide aggregate. ``merge_sketches`` turns any set of rows into a profile.
    """
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            continue  # these can't be hashed
        col = F.col(_at(f.name))
        number = isinstance(f.dataType, T.NumericType)
        aggs += [F.count(col).alias(f"_n{i}"),
                 (F.max(F.length(col)) if _string_like(f.dataType) else F.max(F.lit(None).cast("int"))).alias(f"_l{i}"),
                 F.hll_sketch_agg(_hash(f.name), lg_k).alias(f"_d{i}"),
                 (F.kll_sketch_agg_double(col.cast("double")) if number else F.max(F.lit(None).cast("binary"))).alias(f"_q{i}")]
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                             F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("non_null"), F.col(f"_l{i}").cast("int").alias("max_length"),
                             F.col(f"_d{i}").alias("distinct"), F.col(f"_q{i}").alias("quantiles")))
    own = (part if part is not None else F.lit(0)).cast("string").alias("part")
    return df.select("*", own).groupBy("part").agg(*aggs).select("part", F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by`` + (column, type, non_null, nulls, nullable, max_length, distinct_approx, quantiles array<double>)."""
    merged = sketches.groupBy(*by, "column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.max("max_length").alias("max_length"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    nulls = F.col("rows") - F.col("non_null")
    # A column without numbers has an empty sketch here, as one of NaN has.
    number = F.regexp_extract("type", "^[a-z]+", 0).isin("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    points = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(q)) for q in QUANTILES])
    return merged.select(
        *by, "column", "type", "non_null", nulls.alias("nulls"), (nulls > 0).alias("nullable"), "max_length",
        F.hll_sketch_estimate("distinct").alias("distinct_approx"),
        F.when(number & (F.kll_sketch_get_n_double("quantiles") > 0), points).alias("quantiles"))


def store_sketches(df: DataFrame, path: str, part: str) -> None:
    """Sketch one partition of a table into the sketch table at ``path``; written again, it replaces its own rows."""
    column_sketches(df).drop("part").write.mode("overwrite").parquet(f"{path}/part={part}")


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile of all partitions that ``store_sketches`` wrote; no data is read."""
    return merge_sketches(spark.read.parquet(path))


def _together(sets: Sequence[tuple[str, ...]]) -> list[list[tuple[str, ...]]]:
    """The sets in lists whose columns are few enough for one ``unique_keys``."""
    out: list[list[tuple[str, ...]]] = []
    for s in sets:
        if not out or len(set(s).union(*out[-1])) > GROUPED_COLUMNS:
            out.append([])
        out[-1].append(s)
    return out


def _slice(df: DataFrame, column: str, slices: int) -> DataFrame:
    """All rows of some of the column's values."""
    return df if slices == 1 else df.where(F.pmod(F.xxhash64(F.col(_at(column))), F.lit(slices)) == 0)


def _repeated(df: DataFrame, sets: Mapping[tuple[str, ...], tuple[str, ...]], slices: int = 1) -> set[tuple[str, ...]]:
    """The sets of columns (each with some of its columns, its base) whose values repeat in ``df``.

    Rows that agree in a set agree in its base and in a hash of that. So the hashes of each base are counted
    over all rows (or one of ``slices`` by the base's first column), and only rows whose hash repeats are compared by the
    values of the sets with that base.
    """
    bases = list(dict.fromkeys(sets.values()))
    key = "_h" + "_" * max(map(len, df.columns))
    hashed = [_slice(df, b[0], slices).withColumn(key, _hash(*b)) for b in bases]
    twice = shared_table(union_all([own.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(i).alias("i"), key)
                                    for i, own in enumerate(hashed)]), "repeated-hashes")
    tests = []
    for i, n in twice.groupBy("i").count().collect():
        own = twice.where(F.col("i") == i).select(key)
        rows = hashed[i].join(F.broadcast(own) if n <= FEW_HASHES else own, key, "left_semi")
        tests += [unique_keys(rows, some).select(F.lit(i).alias("i"), "columns", "is_unique")
                  for some in _together([s for s, b in sets.items() if b == bases[i]])]
    found = {(r["i"], r["columns"]) for r in union_all(tests).where("NOT is_unique").collect()} if tests else set()
    return {s for s, b in sets.items() if (bases.index(b), ", ".join(s)) in found}


def minimal_keys(df: DataFrame, columns: Sequence[str] | None = None, most: int = 3, slack: float = 0.1,
                 per_pass: int = 128, per_test: int = 8) -> DataFrame:
    """All minimal unique keys of up to ``most`` columns (O-40): (columns, n_columns, rows).

    Sets of columns are searched level by level. A set is out if it holds a smaller key or a column with nulls, or
    if the product of its columns' distinct counts is below the rows by more than ``slack`` (six standard errors
    of the sketches). Rows that agree in a set agree in its column of most values, so the rows with some of that
    column's values have all duplicates of theirs: the sets left are tested (``unique_keys``, then ``_repeated``) on
    such slices, small ones first, and a duplicate puts a set out. What no slice puts out, every key among them, is
    tested over all rows; a table too small for slices at once. One pass takes ``per_pass`` sets (``per_test`` pairs of columns over all rows), and
    nothing but counts comes to the driver. Columns that can't be grouped (maps, VARIANT) are no keys; in an empty
    table every column is one.
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    names = [c for c in columns or names if c in names]

    def estimates(cols: list[str]) -> dict[str, int]:
        out = {}
        for i in range(0, len(cols), per_pass):
            own = cols[i:i + per_pass]
            row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(_hash(c), 12)).alias(f"_{j}") for j, c in enumerate(own)]).first()
            out |= dict(zip(own, row))
        return out

    def refuted(sets: list[tuple[str, ...]], slices: int) -> set[tuple[str, ...]]:
        """The sets with duplicates in one of so many slices."""
        out = set()
        for i in range(0, len(sets), per_pass):
            own = [part for c in usable for part in _together([s for s in sets[i:i + per_pass] if max(s, key=single.get) == c])]
            tests = [unique_keys(_slice(df, max(part[0], key=single.get), slices), part).select(F.lit(j).alias("j"), "columns", "is_unique")
                     for j, part in enumerate(own)]
            bad = {(r["j"], r["columns"]) for r in union_all(tests).where("NOT is_unique").collect()}
            out |= {s for j, part in enumerate(own) for s in part if (j, ", ".join(s)) in bad}
        return out

    def repeated(sets: list[tuple[str, ...]], slices: int) -> set[tuple[str, ...]]:
        """The same by hashes of the sets' two columns of most values; values with collations may be equal and have different ones."""
        out = set()
        base = {s: tuple(sorted(s, key=lambda c: -single[c])[:2]) for s in sets if collated.isdisjoint(s)}
        bases = list(dict.fromkeys(base.values()))
        for i in range(0, len(bases), per_test):
            out |= _repeated(df, {s: b for s, b in base.items() if b in bases[i:i + per_test]}, slices)
        other = [s for s in sets if s not in base]
        return out | refuted(other, slices) if other else out

    first = df.agg(F.count(F.lit(1)), *[F.count(F.col(_at(c))) for c in names]).first()
    rows = first[0]
    usable = [c for c, n in zip(names, first[1:]) if n == rows]
    single = estimates(usable)
    collated = {f.name for f in df.schema.fields if "collate" in f.dataType.simpleString()}
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        left = [s for s in combinations(usable, size) if not any(set(k) <= set(s) for k in keys)]
        if size == 1:
            left = [s for s in left if single[s[0]] >= (1 - slack) * rows]
        else:
            left = [s for s in left if prod((1 + slack) * single[c] for c in s) >= rows]
        part, test = SLICE_ROWS, refuted
        while left and SLICE_LEAST * part <= rows:
            out = test(left, rows // part)
            left = [s for s in left if s not in out]
            part, test = part * SLICE_STEP, repeated
        out = test(left, 1) if left else set()
        keys += [s for s in left if s not in out]
    return df.sparkSession.createDataFrame([(", ".join(k), len(k), rows) for k in keys], "columns string, n_columns int, rows bigint")


def inclusions(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Every column whose values all occur in another column of its kind (O-15, for all pairs at once).

    Whole numbers are compared with whole numbers and texts with texts, in the named columns or all of
    them. Returns (child_table, child_column, parent_table, parent_column, child_values, parent_values), the
    numbers of distinct values; nulls don't count and a column without values is in none.

    One shuffle for all pairs: a value's columns are gathered as bits (combined inside each task, so a
    value that is in every row or column is one row for a task), equal sets of columns are counted, and pairs come from the few
    distinct sets: a column is included in another where all its values are in sets that hold both.
    """
    named, parts = [], []
    for table, df in tables.items():
        values = []
        for f in df.schema.fields:
            if columns is not None and f.name not in columns.get(table, ()):
                continue
            text = F.col(_at(f.name)).cast("string")
            if isinstance(f.dataType, T.IntegralType):
                kind = "number"
            elif _string_like(f.dataType):
                kind, text = "text", F.when(F.length(text) <= LONG_TEXT, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))
            else:
                continue
            values.append(F.struct(F.lit(kind).alias("kind"), text.alias("value"), F.lit(len(named)).alias("id")))
            named.append((table, f.name))
        if values:
            parts.append(df.select(F.inline(F.array(*values))).where("value IS NOT NULL"))
    words = [f"_w{i}" for i in range(-(-len(named) // 63))]
    own_word, own_bit = F.floor(F.col("id") / 63), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("id") % 63)
    sets = union_all(parts).groupBy("kind", "value").agg(
        *[F.bit_or(F.when(own_word == i, own_bit).otherwise(F.lit(0).cast("bigint"))).alias(w) for i, w in enumerate(words)])
    sets = sets.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    word_of = lambda i: F.element_at(F.array(*words), F.floor(i / 63).cast("int") + 1)
    held = F.filter(F.sequence(F.lit(0), F.lit(len(named) - 1)), lambda i: word_of(i).bitwiseAND(F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), i % 63)) != 0)
    sets = sets.select("n", held.alias("ids"))
    pairs = sets.select("n", "ids", F.explode("ids").alias("a")).select("n", "a", F.explode("ids").alias("b")) \
        .groupBy("a", "b").agg(F.sum("n").alias("n"))
    sizes = pairs.where("a = b").select("a", F.col("n").alias("values"))
    both = pairs.where("a <> b").join(sizes, "a").where("n = values").drop("n") \
        .join(sizes.select(F.col("a").alias("b"), F.col("values").alias("parent_values")), "b")
    name = lambda c, side: F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in named]), F.col(c) + 1)[side]
    return both.select(name("a", "t").alias("child_table"), name("a", "c").alias("child_column"), name("b", "t").alias("parent_table"),
                       name("b", "c").alias("parent_column"), F.col("values").alias("child_values"), "parent_values")


def column_ranges(paths: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """(table, column, rows, min, max) of the number, date and truth columns of Parquet tables, from their footers alone.

    ``min`` and ``max`` are doubles (days since 1970 of a date). No data page is read: the aggregates are pushed to the footers.
    """
    own, parts = footer_session(spark), []
    for name, path in paths.items():
        df = own.read.parquet(path)
        fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType))]
        if not fields:
            continue
        found = df.agg(F.count(F.lit(1)).alias("_rows"), *[x for i, f in enumerate(fields) for x in (
            F.min(_at(f.name)).alias(f"_a{i}"), F.max(_at(f.name)).alias(f"_z{i}"))])
        number = lambda c, f: (F.unix_date(c) if isinstance(f.dataType, T.DateType) else F.col(c)).cast("double")
        parts.append(found.select(F.inline(F.array(*[F.struct(
            F.lit(name).alias("table"), F.lit(f.name).alias("column"), no_less(F.col("_rows")).alias("rows"),
            number(f"_a{i}", f).alias("min"), number(f"_z{i}", f).alias("max")) for i, f in enumerate(fields)]))))
    return union_all(parts)

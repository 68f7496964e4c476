"""How far the sources of a language are apart, term by term.

Each (language, source) group has a smoothed share of every term that the language keeps
(the terms in ``least`` or more of its documents). Two groups differ by the sum over all
kept terms of the difference of their shares; a group's telling terms are those with a
larger share than in its language.

The sums are done as a cube of cells (group block, group block, term block). A language's
groups are dealt into blocks of some ``block`` groups by a hash of the source, its terms into
blocks by a hash of the term, so many that a slice (a group block's counts in a term
block) has some ``slice_rows`` rows. A slice is copied to each cell of its row and column
of the cube; a cell computes the partial sums of its pairs of groups; the sums are then added up
along the term axis. Terms that neither group of a pair has differ by a constant, so cells hold
only counts above 0 and one row for each group.

Shares are whole numbers, p = 1 + floor(SCALE (count + a) / (N + a V)), with N the group's
occurrences of kept terms, V the number of kept terms and a = ``smooth``; all arithmetic is exact.

Edge cases: null text, language and source read as empty text, so rows without a source are a
group; a group without terms occurs with counts of 0; a language without kept terms has pairs
of value 0 and no terms; equal values rank by item; equal rows count as often as they come; a very
long text is counted bit by bit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelens.llm.common import as_bytes, byte_table, pieces, shared_table, tidy, tidy_group, word_lists

#: Terms are runs of letters and what is beyond ASCII.
TERMS = byte_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
SCALE = 10 ** 9
#: (group, term) pairs that a task counts before it hands them on.
HELD = 1 << 18


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs) for each group and term, and a row with null term for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[dict, dict]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                     pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                for group in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), as_bytes(piece.column("text"))):
                    n, df = groups.setdefault(group[:2], ({}, {}))
                    before, seen = len(n), set()
                    for words in word_lists(group[2], TERMS):
                        for w in words:
                            n[w] = n.get(w, 0) + 1
                        seen.update(words)
                    for w in seen:
                        df[w] = df.get(w, 0) + 1
                    held += len(n) - before
                    if held >= HELD:
                        yield from out()
                        held = 0
        yield from out()

    blank = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), blank).alias("lang"),
                       F.coalesce(F.col(source).cast("string"), blank).alias("source"), F.col(text).alias("text"))
    return (rows.mapInArrow(tidy(run), "lang string, source string, term string, n bigint, docs bigint")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, total: Column, terms: Column, smooth: int) -> Column:
    """1 + floor(SCALE (n + smooth) / (total + smooth terms)); null without kept terms."""
    exact = "decimal(38,0)"
    over = (total + smooth * terms).cast(exact)
    return F.when(terms > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + smooth).cast("decimal(20,0)"), over) + 1)


def _cell(table: pa.Table) -> pa.Table:
    """Partial sums of the pairs of groups of one cell."""
    left, right, part = (table.column(c)[0].as_py() for c in ("i", "j", "t"))
    own = pa.compute.is_null(table.column("term"))
    groups = table.filter(own)
    names = groups.column("source").to_pylist()
    number = {s: x for x, s in enumerate(names)}
    block = np.array(groups.column("block").to_pylist())
    base = groups.column("p").to_numpy()
    rows = table.filter(pa.compute.invert(own))
    terms = rows.column("term").combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    held = len(terms.dictionary)
    sources = rows.column("source").combine_chunks().dictionary_encode()
    of = np.array([number[s] for s in sources.dictionary.to_pylist()], np.int64)
    p = np.repeat(base[:, None], held, axis=1)
    if held:
        p[of[sources.indices.to_numpy()], terms.indices.to_numpy()] = rows.column("p").to_numpy()
    # Beside the terms held here, the two differ by the same in each kept term; the first term block adds that for all of them.
    rest = (groups.column("v")[0].as_py() if part == 0 else 0) - held
    a, b, value = [], [], []
    at = {side: np.flatnonzero(block == side) for side in (left, right)}
    for k, x in enumerate(at[left].tolist()):
        others = at[right][k + 1:] if left == right else at[right]
        value += (np.abs(p[others] - p[x]).sum(axis=1) + rest * np.abs(base[others] - base[x])).tolist()
        a += [names[x]] * len(others)
        b += [names[y] for y in others.tolist()]
    return pa.table([pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                     pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least: int = 30, smooth: int = 5,
          top: int = 50, block: int = 64, slice_rows: int = 1 << 16) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language and how far it is,
    part ``term`` the ``top`` terms by which the group's share is above its language's. Rank 1 has the largest value."""
    counts = shared_table(term_counts(docs, lang, source, text), "group-terms")
    kept = shared_table(counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept-terms")
    cells = shared_table(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "v", "lang_total"])
    # How the cube is cut: blocks of groups, then blocks of terms by the rows of the fullest block of groups.
    cut = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    groups = groups.join(cut, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    deep = groups.groupBy("lang", "block").agg(F.sum("terms").alias("rows")).groupBy("lang").agg(
        F.greatest(F.ceil(F.max("rows") / slice_rows), F.lit(1)).cast("int").alias("parts"))
    groups = shared_table(groups.join(deep, "lang").withColumn(
        "p0", F.coalesce(share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"), smooth), F.lit(0))), "groups")

    shares = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"), smooth))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"), smooth)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = (shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value"))
             .where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))

    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    columns = ["lang", "source", "block", "blocks"]
    slices = shares.select(*columns, "term", "p", F.lit(0).cast("bigint").alias("v"), part.alias("t")).unionByName(
        groups.select(*columns, F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "v",
                      F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("t")))
    copies = slices.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "lang", "source", "block", "term", "p", "v", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    partial = copies.groupBy("lang", "i", "j", "t").applyInArrow(tidy_group(_cell), "lang string, a string, b string, value bigint")
    pairs = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                            F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", both).select("lang", "source", F.lit("pair").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)

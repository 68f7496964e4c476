"""Mixing sources to target weights by capped water-filling.

The mix is to hold ``budget`` times all words. Each source gets its weight's
share, but at most ``epochs`` times its own words; what a source can't take is
shared out again by weight among the others until no target is above its cap. A
source's texts are all taken floor(target / size) times; for the fraction that
remains, the texts whose words come first in a seeded hash order are taken once
more, so that the words taken miss the target by half a text at most.

Running sums are built in two steps: by (source, slice of the hash order), then
row by row inside the one slice in which a source's fraction ends. Rows of other
slices are taken or not as a whole, so only a sliver of the rows is exchanged
and no source passes through one task.

Edge cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; a source without words has target
0; a row without key gets its place from its text alone; rows with equal hashes
are ordered by key and text, equal rows in turn; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelens.llm.common import scratch_name, shared_table

#: A word of a text, for its size.
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, epochs: float) -> list[float]:
    """Target of each source; the sum is ``budget``, or all caps if they hold less."""
    targets = [0.0] * len(sizes)
    left, budget = [i for i, n in enumerate(sizes) if n > 0], float(budget)
    while left:
        total = sum(weights[i] for i in left)
        full = [i for i in left if weights[i] * budget / total > epochs * sizes[i]]
        for i in full or left:
            targets[i] = epochs * sizes[i] if full else weights[i] * budget / total
        if not full:
            break
        budget -= sum(epochs * sizes[i] for i in full)
        left = [i for i in left if targets[i] == 0]
    return [float(t) for t in targets]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, epochs: float = 2.0, seed: int = 10,
        keep: list[str] | None = None, slices: int = 1024) -> DataFrame:
    """Append size, source_size, target and copies (times taken) to the ``keep`` columns (all but the text) of every row.

    ``weights`` go to the sources by code point, in turn, a null source last.
    The driver gets one row for each source.
    """
    added = ("size", "source_size", "target", "copies")
    kept = [c for c in keep or docs.columns if c.lower() not in added]
    own, at, end, rank, before = (scratch_name(docs, c) for c in ("own_source", "slice", "end", "rank", "before"))
    # md5 text in ascending order is the order of the mix; its beginning is the slice.
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.md5(text)).cast("binary"))
    rows = docs.select(*kept, F.concat(F.lit("s"), F.col(source)).alias(own), words(F.col(text)).alias("size"),
                       place.alias(rank)).fillna("", [own])
    first = F.conv(F.substring(rank, 1, 6), 16, 10).cast("long")
    rows = rows.withColumn(at, F.floor(first * slices / (1 << 24)).cast("int"))

    part = shared_table(rows.groupBy(own, at).agg(F.sum("size").alias("n")), "mix-slices")
    totals = sorted(part.groupBy(own).agg(F.sum("n")).collect(), key=lambda r: (r[0] == "", r[0]))
    sizes = [r[1] for r in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget * sum(sizes), epochs)
    whole = [math.floor(t / n) if n else 0 for t, n in zip(targets, sizes)]
    plan = docs.sparkSession.createDataFrame(
        [(r[0], n, t, w, t - w * n) for r, n, t, w in zip(totals, sizes, targets, whole)],
        f"{own} string, source_size bigint, target double, whole int, more double")
    up_to = Window.partitionBy(own).orderBy(at)  # one row for a slice
    reach = part.withColumn(before, F.sum("n").over(up_to) - F.col("n")).join(F.broadcast(plan), own)
    ends = reach.where((F.col(before) <= F.col("more")) & (F.col(before) + F.col("n") > F.col("more")))
    ends = ends.select(own, F.col(at).alias(end), before).collect()  # one row for a source at most
    plan = plan.join(F.broadcast(docs.sparkSession.createDataFrame(ends, f"{own} string, {end} int, {before} bigint")), own, "left")
    joined = rows.join(F.broadcast(plan), own)  # one row for a source, as the driver holds them
    split = F.coalesce(F.col(at) == F.col(end), F.lit(False))
    plain = F.when((F.col(at) < F.col(end)) | F.col(end).isNull(), F.when(F.col("more") > 0, 1).otherwise(0)).otherwise(0)
    inside = Window.partitionBy(own, at).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col(before) + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    extra = joined.where(~split).withColumn("extra", plain).unionByName(
        joined.where(split).withColumn("extra", (reached <= F.col("more")).cast("int")))
    return extra.select(*kept, "size", "source_size", "target",
                        F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).alias("copies"))

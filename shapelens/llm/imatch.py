"""I-Match fingerprints with randomised lexicons, in DataFrame operations only.

The lexicon holds the terms whose share of documents lies in a band, that is
those of medium inverse document frequency, counted over all documents. A
fingerprint has one part for each of 64 random subsets of the lexicon: a hash of
the text's distinct terms in the subset, or nothing where it has none. Terms are
distinct and their hashes are joined by exclusive or, which gives one value for
a set of terms as hashing the sorted set does, in any order of rows. Large
subsets tell near copies, small ones keep some likeness under larger changes.
The likeness of two fingerprints is the share of equal parts among the subsets
of which either text has terms.

Size of the lexicon: shares of all terms add up to the mean number of distinct
terms of a document, so no more than mean / lowest share can reach the lowest
share. The band's lower edge is raised, if need be, to keep that below
``max_terms``; so the lexicon can be sent to every task.

Neighbours: documents are cut into ranges of the key by quantiles, one exchange
of the texts, and each range gets the first document of the next range as its
end, so that no document has to pass through one task.

Edge cases: a null text counts as empty; texts without a term of the lexicon
have the digest of the text as fingerprint, and likeness 1 to an equal text and
0 to another; null keys come last, in the order of their texts' digests, as do
rows with equal keys; a single document is its own neighbour; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelens.llm.common import shared_table

#: Of each random subset of the lexicon, one term in so many belongs to it.
ONE_IN = (4,) * 8 + (16,) * 8 + (64,) * 16 + (256,) * 32
NOT_IN_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    words = F.split(F.lower(text), NOT_IN_WORD)
    return F.array_remove(F.array_distinct(words), "")


def lexicon(docs: DataFrame, *, text: str = "text", share: tuple[float, float] = (0.001, 0.1), seed: int = 6) -> DataFrame:
    """(term, code, mask): terms in the band, a hash, and the subsets a term belongs to as bits.

    The band is one of shares of documents, whatever the length of texts or their number.
    """
    found = docs.select(terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    per_term = shared_table(found.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    total = max(1, docs.count())
    mask = F.lit(0).cast("bigint")
    for k, n in enumerate(ONE_IN):
        chosen = F.xxhash64("term", F.lit(seed * 1000 + k)).bitwiseAND(F.lit(n - 1)) == 0
        mask = mask.bitwiseOR(F.when(chosen, F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(0))
    own = per_term.where((F.col("n") >= share[0] * total) & (F.col("n") <= share[1] * total))
    return shared_table(own.select("term", F.xxhash64("term", F.lit(seed)).alias("code"), mask.alias("mask")), "lexicon")


def _ranges(docs: DataFrame, key: str, count: int) -> Column:
    """Number of the range of keys, from the largest keys on; null keys last, in 16 ranges by digest."""
    steps = [i / count for i in range(1, count)]
    edges = sorted(set(docs.agg(F.percentile_approx(key, steps, 100 * count)).first()[0] or ())) if steps else []
    width = max(1, math.isqrt(len(edges)))
    groups = [edges[i:i + width] for i in range(0, len(edges), width)]
    if not groups:
        below = F.lit(0)
    else:
        tops = F.array(*(F.lit(g[-1]) for g in groups))
        parts = F.array(*(F.array(*map(F.lit, g)) for g in [*groups, groups[-1][:1]]))
        full = F.size(F.filter(tops, lambda e: e <= F.col(key)))
        inside = F.size(F.filter(F.get(parts, full), lambda e: e <= F.col(key)))
        below = F.when(full < len(groups), full * width + inside).otherwise(len(edges))
    digit = F.conv(F.substring("digest", 1, 1), 16, 10).cast("int")
    return F.when(F.col(key).isNull(), len(edges) + 1 + digit).otherwise(len(edges) - below).cast("int")


def parts_of(side: int) -> Column:
    """The parts of the fingerprint of one side, as an array of texts ('' for no terms)."""
    def part(k: int) -> Column:
        own = (F.col("side") == side) & (F.shiftright("mask", k).bitwiseAND(F.lit(1)) == 1)
        code = F.bit_xor(F.when(own, F.col("code")))
        return F.coalesce(F.lpad(F.lower(F.hex(code.bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"), F.lit(""))
    return F.array(*(part(k) for k in range(len(ONE_IN))))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Share of equal parts; of two texts without any part, 1 if the texts are equal."""
    def share(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
    either = share(F.zip_with(a, b, lambda p, q: ((p != "") | (q != "")).cast("int")))
    same = share(F.zip_with(a, b, lambda p, q: ((p == q) & (p != "")).cast("int")))
    return F.when(either > 0, same / either).otherwise(equal.cast("double"))


def fingerprint(parts: Column, digest: Column) -> Column:
    joined = F.array_join(parts, ",")
    return F.when(F.translate(joined, ",", "") == "", F.concat(F.lit("="), digest)).otherwise(joined)


def neighbours(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(range, place, end, key, text, digest, next_text): documents in descending key order, in ranges.

    ``end`` marks the copy of the next range's first document at a range's end;
    the last range's is the first document of all.
    """
    count = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("range", _ranges(rows.select("key"), "key", count))
    order = F.struct(F.col("key").isNull(), -F.col("key"), "digest")
    first = rows.groupBy("range").agg(F.min(order).alias("o"))  # one row for a range
    every = Window.orderBy("range")
    first = first.select(F.coalesce(F.lag("range").over(every), F.max("range").over(every.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"), F.col("range").alias("at"),
        F.col("o.digest").alias("d"), (-F.col("o.col2")).alias("k"))
    ends = rows.join(F.broadcast(first), (F.col("range") == F.col("at")) & F.col("key").eqNullSafe(F.col("k"))
                     & (F.col("digest") == F.col("d")))
    ends = ends.dropDuplicates(["before"]).select(F.col("before").alias("range"), "key", "text", "digest", F.lit(True).alias("end"))
    line = Window.partitionBy("range").orderBy("end", F.desc_nulls_last("key"), "digest")
    return (rows.select("range", "key", "text", "digest", F.lit(False).alias("end")).unionByName(ends)
            .withColumn("place", F.row_number().over(line)).withColumn("next_text", F.lead("text").over(line)))


def compare(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_terms: int = 100_000, **options) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third replaced by the beginning of the next
    document's text, in descending key order; near_next compares with that document. A
    lexicon of ``max_terms`` terms or fewer is sent to every task; a larger one is joined by an
    exchange of the terms, with the same result.
    """
    words = lexicon(docs, text=text, **options)
    small = words.limit(max_terms + 1).count() <= max_terms
    blank = docs.sparkSession.sql("SELECT '' AS term, 0L AS code, 0L AS mask")
    rows = neighbours(docs, key=key, text=text)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third),
                      F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), third))
    rows = rows.withColumn("edited", edited).select(
        "range", "place", "end", "key", "digest", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")

    def sided(name: str, side: int) -> Column:  # the empty term keeps rows without any other
        return F.transform(F.concat(F.array(F.lit("")), terms(F.col(name))),
                           lambda t: F.struct(t.alias("term"), F.lit(side).alias("side")))

    carried = ["range", "place", "end", "key", "digest", "n_chars", "edited_sha256"]
    each = rows.select(*carried, F.explode(F.concat(sided("text", 0), sided("edited", 1))).alias("t"))
    each = each.select(*carried, "t.*").join((F.broadcast if small else lambda w: w)(words.unionByName(blank)), "term")
    # With a small lexicon, rows of a document lie in the partition of its range: no exchange from here on.
    own = each.groupBy(*carried).agg(parts_of(0).alias("a"), parts_of(1).alias("b"))
    line = Window.partitionBy("range").orderBy("place")
    own = own.withColumn("next_a", F.lead("a").over(line)).withColumn("next_digest", F.lead("digest").over(line))
    return own.where(~F.col("end")).select(
        F.col("key").alias(key), "n_chars", "edited_sha256",
        fingerprint(F.col("a"), F.col("digest")).alias("fingerprint"),
        fingerprint(F.col("b"), F.col("edited_sha256")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), F.col("digest") == F.col("edited_sha256")).alias("near_edited"),
        likeness(F.col("a"), F.col("next_a"), F.col("digest") == F.col("next_digest")).alias("near_next"))

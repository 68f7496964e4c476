"""Ranked lexical search by dense blocked matrix products.

Items are dealt into blocks, and a block's distinct terms are its vocabulary. One pass
over the documents keeps, for each, the number of its terms and how often it has each
term of the vocabulary (table 1). From it come the numbers of documents and terms, and
for each term the number of documents that hold it.

A term's weight in a document is a whole number (its impact). Documents are taken in
tiles, and so are items, whose terms are numbered anew within the tile. The scores of a
tile pair are the product of the documents' impacts and the items' zeros and ones, a BLAS
call in float64. It is exact: the vocabulary of a product has so few terms that no
partial sum reaches 2^53; the sums of several products are added as 64-bit integers.

Rows of a tile stand in the order of their keys, so a stable sort by score ranks ties by
key. Each task keeps the best ``k`` of each item, and Spark ranks those of all tasks.

Weights: N documents with a term, L terms in all, n terms of a document, df documents with
the term, tf its occurrences. w = floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles,
m = 100 - B + (B n N) div L, and impact = w ((10^9 tf) div (1000 tf + 8 m)), B = 90.

Edge cases: null and empty texts have no terms, are never found and don't count in N;
items without terms have no rows; equal scores go by key, null last; rows with equal
keys are ranked each; items are rows, so equal items have equal results; an empty table
gives no rows; a text of any length is counted whole, bit by bit; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shapelens.llm.common import as_bytes, byte_table, pieces, shared_table, tidy, word_lists
from shapelens.session import union_all

#: Terms are runs of letters, digits and what is beyond ASCII.
TERMS = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LENGTH_SHARE = 90
#: (10^9 tf) div (1000 tf + 8 m) is below this.
MOST_TF = 10 ** 6


class Block:
    """Items and their terms as numbers of the block's vocabulary."""

    def __init__(self):
        self.keys: list = []
        self.items: list[np.ndarray] = []
        self.vocabulary: dict[bytes, int] = {}

    def add(self, key, terms: list[bytes]) -> None:
        v = self.vocabulary
        self.keys.append(key)
        self.items.append(np.array([v.setdefault(t, len(v)) for t in terms], np.int64))


def blocks(items: DataFrame, key: str, text: str, most_items: int, most_terms: int) -> Iterator[Block]:
    """Blocks of ``most_items`` items, or of some more than ``most_terms`` distinct terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "t"):
                terms = [sorted({w for part in word_lists(raw, TERMS) for w in part}) for raw in as_bytes(piece.column("t"))]
                yield pa.RecordBatch.from_arrays([piece.column("k"), pa.array(terms, pa.list_(pa.binary()))], names=["k", "terms"])

    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = rows.mapInArrow(tidy(run), StructType([*rows.select("k").schema, *StructType.fromDDL("terms array<binary>")]))
    block = Block()
    for k, terms in found.where(F.size("terms") > 0).toLocalIterator():
        block.add(k, [bytes(t) for t in terms])
        if len(block.items) >= most_items or len(block.vocabulary) >= most_terms:
            yield block
            block = Block()
    if block.items:
        yield block


def term_counts(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(k, n, terms, tfs): a document's number of terms, and those of the vocabulary with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for piece in pieces(batch, "t"):
                ns, ends, terms, tfs = [], [0], [], []
                for raw in as_bytes(piece.column("t")):
                    counts: Counter = Counter()
                    for words in word_lists(raw, TERMS):
                        counts.update(words)
                    ns.append(counts.total())
                    for term in counts.keys() & known.keys():
                        terms.append(known[term])
                        tfs.append(counts[term])
                    ends.append(len(terms))
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("k"), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["k", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = StructType([*rows.select("k").schema, *StructType.fromDDL("n bigint, terms array<int>, tfs array<int>")])
    return shared_table(rows.mapInArrow(tidy(run), schema), "term-counts").where("n > 0")


def document_counts(counts: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary the number of documents that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in counts.select("terms").mapInArrow(tidy(run), "term bigint, df bigint").groupBy("term").sum("df").collect():
        out[term] = df
    return out


class Best:
    """The best ``k`` (score, key) of each item; equal scores by key, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.rows = k, np.ones(items, np.int64), [[] for _ in range(items)]

    def add(self, first: int, scores: np.ndarray, keys: list) -> None:
        """Scores of rows (in the order of their keys) for the items from ``first`` on."""
        least = self.least[first:first + scores.shape[1]]
        for j in np.flatnonzero(scores.max(axis=0) >= least).tolist():
            own = scores[:, j]
            top = np.argsort(-own, kind="stable")[:self.k]
            rows = self.rows[first + j]
            rows += [(-int(own[i]), keys[i] is None, keys[i]) for i in top[own[top] >= least[j]].tolist()]
            rows.sort(key=lambda r: r[:2] if r[1] else r)
            del rows[self.k:]
            if len(rows) == self.k:
                least[j] = -rows[-1][0]


def item_tiles(items: list[np.ndarray], size: int, per_tile: int, per_product: int) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first item, [(term -> its number in the product or -1, zeros and ones of terms and items)]) of each tile of items."""
    out = []
    for first in range(0, len(items), per_tile):
        own = items[first:first + per_tile]
        held = np.unique(np.concatenate(own))
        products = []
        for at in range(0, len(held), per_product):
            number = np.full(size, -1, np.int64)
            number[held[at:at + per_product]] = np.arange(len(held[at:at + per_product]))
            ones = np.zeros((len(held[at:at + per_product]), len(own)))
            for j, terms in enumerate(own):
                rows = number[terms]
                ones[rows[rows >= 0], j] = 1.0
            products.append((number, ones))
        out.append((first, products))
    return out


def impacts(tfs: np.ndarray, ms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights * ((10 ** 9 * tfs) // (1000 * tfs + 8 * ms))


def _scored(counts: DataFrame, block: Block, weights: np.ndarray, documents: int, words: int, k: int, first_item: int, key_type,
            item_type, doc_tile: int, item_tile: int, product: int) -> DataFrame:
    # Sums of a product stay below 2^53: it has no more terms than this.
    most = max(1, min(product, (1 << 53) // (int(weights.max(initial=1)) * MOST_TF + 1)))
    sent = counts.sparkSession.sparkContext.broadcast((block.keys, block.items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, weight = sent.value
        best, kind, kept = Best(len(items), k), None, None
        group = max(1, item_tile * 64)  # items whose tiles are held at once
        if len(items) <= group:
            kept = item_tiles(items, len(weight), item_tile, most)
        for batch in batches:
            kind = batch.schema.field("k").type
            for start in range(0, batch.num_rows, doc_tile):
                part = batch.slice(start, doc_tile)
                keys = part.column("k").to_pylist()
                order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, 0 if keys[i] is None else keys[i]))
                part, keys = part.take(pa.array(order, pa.int64())), [keys[i] for i in order]
                ns = part.column("n").to_pylist()
                lengths = np.diff(part.column("terms").offsets.to_numpy())
                row = np.repeat(np.arange(len(keys)), lengths)
                terms = part.column("terms").flatten().to_numpy(zero_copy_only=False)
                tfs = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // words for n in ns], np.int64)
                impact = impacts(tfs, m[row], weight[terms]).astype(np.float64)
                groups = [kept] if kept is not None else (
                    [(g + f, p) for f, p in item_tiles(items[g:g + group], len(weight), item_tile, most)] for g in range(0, len(items), group))
                for tiles in groups:
                    for first, products in tiles:
                        total = None
                        for number, ones in products:
                            column = number[terms]
                            at = column >= 0
                            dense = np.zeros((len(keys), len(ones)))
                            dense[row[at], column[at]] = impact[at]
                            own = (dense @ ones).astype(np.int64)
                            total = own if total is None else total + own
                        best.add(first, total, keys)
        rows = [(first_item + i, names[i], key, -score) for i, own in enumerate(best.rows) for score, _, key in own]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], item_kind), pa.array(columns[2], kind), pa.array(columns[3], pa.int64())],
                names=["item", "item_key", "k", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    item_kind = to_arrow_type(item_type)
    schema = StructType([StructField("item", LongType()), StructField("item_key", item_type), StructField("k", key_type),
                         StructField("score", LongType())])
    return counts.mapInArrow(tidy(run), schema)


def rank(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", k: int = 10, doc_tile: int = 256, item_tile: int = 256, product: int = 8192,
         block_items: int = 1 << 16, block_terms: int = 1 << 20) -> DataFrame:
    """(item key, rank, document key, score): the ``k`` best documents with a score above 0 of each item.

    The driver holds one block of items (``block_items``, ``block_terms``), its weights and nothing of
    the documents; there is a pass over the documents for each block.
    """
    key_type, item_type = docs.schema[key].dataType, items.schema[item_key].dataType
    found, first = [], 0
    for block in blocks(items, item_key, item_text, block_items, block_terms):
        counts = term_counts(docs, key, text, block.vocabulary)
        n, words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_counts(counts, len(block.vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found.append(_scored(counts, block, weights, n, words, k, first, key_type, item_type, doc_tile, item_tile, product))
        first += len(block.items)
    if not found:
        empty = StructType([StructField("item", LongType()), StructField("item_key", item_type), StructField("k", key_type),
                            StructField("score", LongType())])
        found = [docs.sparkSession.createDataFrame([], empty)]
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("k").asc_nulls_last())
    return (union_all(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("item_key").alias(item_key), "rank", F.col("k").alias(key), "score"))

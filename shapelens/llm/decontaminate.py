"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item gives windows of ``WINDOW`` consecutive words (one window, if
it has fewer). A window is a set of shingles of ``SHINGLE`` words, and a document
holds it only if it has all of them, so one necessary prefix token is enough:
the window's shingle that occurs least in the documents, counted over all of
them. Windows with a shingle that no document has are out.

One pass over the documents tokenises them and keeps the places of shingles that
a bit filter of all window shingles lets through, in runs as long as the shortest
window needs, with the words around. The filter has ``most_bits`` bits at most,
whatever the benchmark's size; what it lets through by chance the join removes.
Places and prefix tokens are then joined by a shuffle, salted, so that a token
of very many documents or windows is spread over tasks. The token's place in the
window bounds where the window would begin and whether it fits, and the words
there are compared with the window. Word positions inside any occurrence are hit.
Equal texts are searched once from that join on.

Edge cases: null and empty texts have no words, documents without words no hit;
items without words or with a null id give no window; ids may have any type;
equal windows of several items count for each; repeated rows are judged each; an
empty benchmark or table of documents gives no hits or no rows; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from xxhash import xxh64_intdigest

from shapelens.llm.common import as_bytes, byte_table, pieces, scratch_name, shared_table, tidy

WINDOW = 10
SHINGLE = 3
#: Copies of each prefix token in the join.
SALTS = 8
#: Bits of the filter for each shingle of the benchmark, up to ``most_bits`` in all.
BITS_EACH = 256
#: Bytes in a bitmap of Spark's ``bitmap_construct_agg``.
BITMAP_BYTES = 4096
#: Rows that a task holds before it hands them on.
BATCH_ROWS = 20_000
#: Word bytes stay (A-Z lower-cased), all else separates.
BYTES = byte_table((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    n = min(size, len(words))
    return list(dict.fromkeys(tuple(words[i:i + n]) for i in range(len(words) - n + 1))) if n else []


def shingle_hashes(words: list[bytes] | tuple[bytes, ...], n: int) -> np.ndarray:
    """64-bit hashes of the shingles of n words, in order."""
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ each[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """Distinct (id, window), the window's words joined by a space."""
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "t"):
                at, found = [], []
                for i, t in enumerate(as_bytes(piece.column("t"))):
                    own = windows_of(words_of(t), size)
                    at += [i] * len(own)
                    found += [b" ".join(w) for w in own]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(pa.array(at, pa.int64())), pa.array(found, pa.binary()).cast(pa.string())],
                    names=["id", "w"])

    return rows.mapInArrow(tidy(run), StructType([rows.schema["id"], *StructType.fromDDL("w string")])).distinct()


def _tokens(windows: DataFrame) -> DataFrame:
    """A row for each shingle of each window: its hash, its place, its words, the window and the window's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w in batch.column("w").to_pylist():
                words = w.encode().split(b" ")
                n = min(SHINGLE, len(words))
                rows += [(w, n, len(words), i, h) for i, h in enumerate(shingle_hashes(words, n).tolist())]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["w", "n", "size", "offset", "h"])

    return windows.mapInArrow(tidy(run), "w string, n int, size int, offset int, h bigint")


def _filter(tokens: DataFrame, most_bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A bitmap of the tokens' hashes, and for each shingle length the fewest shingles that a window has."""
    sizes = tokens.groupBy("n").agg(F.min(F.col("size") - F.col("n") + 1).alias("need"), F.count("*").alias("rows")).collect()
    wanted = BITS_EACH * sum(r.rows for r in sizes)
    bits = max(8 * BITMAP_BYTES, min(most_bits, 1 << max(0, wanted - 1).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    maps = (tokens.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect())  # ``bits`` at most in all
    out = np.zeros(bits // 8, np.uint8)
    for r in maps:
        out[(r.bucket - 1) * BITMAP_BYTES:r.bucket * BITMAP_BYTES] = np.frombuffer(r.map, np.uint8)
    return out, sorted((r.n, r.need) for r in sizes)


def runs(hashes: np.ndarray, bitmap: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Ranges of at least ``need`` neighbouring hashes that the bitmap has."""
    bit = hashes & np.int64(8 * len(bitmap) - 1)
    there = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
    if not there.any():
        return []
    edges = np.flatnonzero(np.diff(there.astype(np.int8), prepend=0, append=0)).tolist()
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= need]


def _places(texts: DataFrame, bitmap: np.ndarray, needs: list[tuple[int, int]], window: int) -> DataFrame:
    """Places of window shingles in the texts: (digest, pos, h, at, around), ``around`` the words near, the shingle at ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(5)]

        def batch_of() -> pa.RecordBatch:
            types = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["digest", "pos", "h", "at", "around"])
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            for piece in pieces(batch, "t"):
                for digest, text in zip(piece.column("digest").to_pylist(), as_bytes(piece.column("t"))):
                    words = words_of(text)
                    for n, need in needs:
                        hashes = shingle_hashes(words, n)
                        for a, b in runs(hashes, bitmap, need):
                            for i in range(a, b):
                                low = max(a, i - window + 1)
                                near = [w.decode() for w in words[low:min(b - 1 + n, i + window)]]
                                for c, x in zip(columns, (digest, i, int(hashes[i]), i - low, near)):
                                    c.append(x)
                                if len(columns[0]) >= BATCH_ROWS:
                                    yield batch_of()
        yield batch_of()

    return texts.mapInArrow(tidy(run), "digest binary, pos int, h bigint, at int, around array<string>").distinct()


@F.arrow_udf(LongType())
def n_words_of(texts: pa.Array) -> pa.Array:
    """Number of words of each text: the places where a word begins, counted between the texts' starts."""
    counts = [np.zeros(0, np.int64)]
    for piece in pieces(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
        each = as_bytes(piece.column("t"))
        own = np.frombuffer(b" ".join([b"", *each]).translate(BYTES), np.uint8) != 0x20  # a space before each text
        begins = np.concatenate([[False], own[1:] & ~own[:-1]])
        starts = np.cumsum([0, *(len(t) + 1 for t in each[:-1])])
        counts.append(np.add.reduceat(begins, starts, dtype=np.int64))
    return pa.array(np.concatenate(counts))


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def found_texts(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
                item_text: str = "text", window: int = WINDOW, most_bits: int = 1 << 27) -> DataFrame:
    """One row for each distinct text with a hit: digest, n_hit, items, spans. Written to the shared folder."""
    links = shared_table(_windows(items, item_id, item_text, window), "decontaminate-windows")
    tokens = shared_table(_tokens(links.select("w").distinct()), "decontaminate-tokens")
    bitmap, needs = _filter(tokens, most_bits)
    texts = docs.select(digest_of(F.col(text)).alias("digest"), F.col(text).alias("t"))
    places = shared_table(_places(texts, bitmap, needs, window), "decontaminate-places")
    # The rarest shingle of each window is its prefix token; 0 if no document has one of them.
    counts = places.groupBy("h").agg(F.count("*").alias("rows"))
    prefix = (tokens.join(counts, "h", "left").groupBy("w", "size")
              .agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "h", "offset")).alias("least"))
              .where("least.rows > 0").select("w", "size", "least.h", "least.offset")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    start = F.col("at") - F.col("offset")
    found = (places.withColumn("salt", F.pmod(F.xxhash64("digest", "pos"), F.lit(SALTS)).cast("int")).join(prefix, ["h", "salt"])
             .where((start >= 0) & (start + F.col("size") <= F.size("around")))
             .where(F.array_join(F.slice("around", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("w"))
             .select("digest", "w", (F.col("pos") - F.col("offset")).alias("start"), F.col("size").alias("words")))
    found = shared_table(found, "decontaminate-found")
    # Positions inside any span: what each span, in order, adds beyond the end of those before it.
    step = lambda a, s: F.struct(
        (a["total"] + F.greatest(F.lit(0), s["start"] + s["words"] - F.greatest(s["start"], a["end"]))).alias("total"),
        F.greatest(a["end"], s["start"] + s["words"]).alias("end"))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    spans = (found.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("start", "words"))).alias("spans"))
             .withColumn("n_hit", F.aggregate("spans", zero, step, lambda a: a["total"].cast("bigint"))))
    ids = (found.select("digest", "w").distinct().join(links, "w").select("digest", "id").distinct()
           .groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("items")))
    return shared_table(spans.join(ids, "digest").select("digest", "n_hit", "items", "spans"), "decontaminate-texts")


def hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
         most_bits: int = 1 << 27) -> DataFrame:
    """Append to the ``keep`` columns (all) of every row: n_words, n_hit, items, spans.

    ``items`` are the ids of the items with occurring windows, ``spans`` the
    occurrences as (first word, number of words).
    """
    kept = [c for c in keep or docs.columns if c.lower() not in ("n_words", "n_hit", "items", "spans")]
    found = found_texts(docs, items, text=text, item_id=item_id, item_text=item_text, window=window, most_bits=most_bits)
    key = scratch_name(docs, "text_digest")
    rows = docs.select(*kept, n_words_of(F.col(text)).alias("n_words"), digest_of(F.col(text)).alias(key))
    empty = {c: F.array().cast(found.schema[c].dataType) for c in ("items", "spans")}
    return (rows.join(found.withColumnRenamed("digest", key), key, "left")
            .select(*kept, "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    *(F.coalesce(c, x).alias(c) for c, x in empty.items())))


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns alone."""
    key = scratch_name(docs, "text_digest")
    found = found_texts(docs, items, text=text, item_id=item_id, item_text=item_text).select(F.col("digest").alias(key))
    return docs.withColumn(key, digest_of(F.col(text))).join(found, key, "left_anti").select(*docs.columns)

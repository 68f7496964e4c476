"""Substring dedup by hashing lines, paragraphs or passages.

A text's units are its lines, its paragraphs (between blank lines), or its passages:
parts cut where the hash of three words is the least among its ``REACH`` neighbours on either
side, so that a cut depends on the words near it alone and a passage is cut alike
wherever it stands. A unit is normalised to its words (A-Z lower-cased, whatever is
between words left out) and hashed to 128 bits; lines and paragraphs of fewer than
``min_words`` words are never removed. Digests are grouped over all documents; of
equal units the one that ranks first stays (by key, nulls last, then by a digest of
the text, then by place in the text), and the others are removed, with ``inside`` also those
in the text of the first one. Successive passages go only if they have ``min_run`` words
together. The rest of a text is joined as before (lines, paragraphs) or
closed up (passages); the removed spans are given in characters (code points) of the original text.

Each text is read into units once, by numpy over its bytes; what follows are a count of digests, joins of
those that repeat, and one pass that takes the spans out of the texts.

Edge cases: a null text stays null and an empty one empty, without spans; rows
equal in key and text are one document to the ranking, so each comes out with
the same units; a text may lose all its units and is then empty; a run of one repeated word is
cut every ``REACH + 1`` words from its beginning; a very long text is hashed block by block; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapelens.llm.common import as_bytes, byte_table, pieces, scratch_name, shared_table, tidy

#: A passage has more words than this.
REACH = 4
SEPARATORS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t]*(?:\n[ \t]*)+")}
#: Separators as spaces, A-Z in lower case; what is no space is part of a word.
WORDS = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes whose words are hashed at once.
BLOCK = 1 << 20
#: Odd bases of the polynomial hashes, modulo 2^64.
BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def units(text: str, kind: str) -> list[tuple[int, int]]:
    """(start, end) of each line or paragraph, in characters."""
    ends = [(m.start(), m.end()) for m in SEPARATORS[kind].finditer(text)]
    return list(zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)]))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of words and of runs of words, for one task: differences of prefix sums of a polynomial."""

    def __init__(self):
        self.powers = {}

    def _powers(self, base: np.uint64, n: int) -> np.ndarray:
        found = self.powers.get(base)
        if found is None or len(found) < n:
            found = np.full(max(n, 1 << 12), base, np.uint64)
            found[0] = 1
            found = self.powers[base] = np.cumprod(found)
        return found[:n]

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
        """A hash of ``values[start:end]`` for each span, the same wherever they stand."""
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers(base, len(values)), out=sums[1:])
        back = np.uint64(pow(int(base), -1, 1 << 64))
        return _mix((sums[end] - sums[start]) * self._powers(back, len(values) + 1)[start])

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word."""
        raw, at, starts, hashes = raw.translate(WORDS), 0, [], []
        while at < len(raw):
            end = len(raw)
            if end - at > BLOCK:
                end = raw.rfind(b" ", at, at + BLOCK)
                end = end if end > at else raw.find(b" ", at + BLOCK)
                end = end if end >= 0 else len(raw)
            block = np.frombuffer(raw, np.uint8, end - at, at)
            edge = np.diff((block != 32).view(np.int8), prepend=np.int8(0), append=np.int8(0))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            starts.append(first + at)
            hashes.append(self.spans(block.astype(np.uint64) + np.uint64(1), first, last, BASES[0]))
            at = end
        return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def passages(words: np.ndarray) -> np.ndarray:
    """The first word of each passage of a text, by the hashes of its words."""
    n = len(words) - 2
    if n <= 2 * REACH:
        return np.zeros(min(len(words), 1), np.int64)
    marks = _mix(words[:-2] + _mix(words[1:-1] + _mix(words[2:])))
    inner = marks[REACH:n - REACH]
    least = np.ones(len(inner), bool)
    for d in range(1, REACH + 1):
        least &= (inner <= marks[REACH - d:n - REACH - d]) & (inner <= marks[REACH + d:n - REACH + d])
    found = np.flatnonzero(least) + REACH
    cuts = [0]
    for i in found.tolist():
        if i - cuts[-1] > REACH:
            cuts.append(i)
    return np.array(cuts, np.int64)


def unit_table(raw: bytes, kind: str, min_words: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(place, start, end, words, digest 1, digest 2) of a text's units, in characters; lines too short to be removed are left out."""
    first, words = hasher.words(raw)
    continued = np.frombuffer(raw, np.uint8) & 0xC0 == 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~continued, out=before[1:])  # characters ahead of a byte
    if kind == "passage":
        low = passages(words)
        high = np.append(low[1:], len(words))[:len(low)]
        start, end = before[first[low]], before[np.append(first, len(raw))[high]]
        place = np.arange(len(low))
    else:
        start, end = (np.array(x, np.int64) for x in zip(*units(raw.decode("utf-8", "replace"), kind)))
        at = before[first]
        low, high = np.searchsorted(at, start), np.searchsorted(at, end)
        place = np.flatnonzero(high - low >= min_words)
        low, high, start, end = low[place], high[place], start[place], end[place]
    digests = [hasher.spans(words, low, high, b).view(np.int64) for b in BASES]
    return place, start, end, high - low, *digests


def without(text: str, spans: list[tuple[int, int]], removed: set[int]) -> str:
    """The text without the removed units and without a separator for each."""
    out, last = [], None
    for i, (start, end) in enumerate(spans):
        if i not in removed:
            if last is not None:
                out.append(text[spans[i - 1][1]:start])
            out.append(text[start:end])
            last = i
    return "".join(out)


def runs(repeated: list[dict], min_run: int) -> list[tuple[int, int]]:
    """(start, end) of successive repeated passages with ``min_run`` words together."""
    found: list[list[int]] = []
    last = None
    for u in repeated:
        if last is not None and u["i"] == last + 1:
            found[-1][1:] = [u["end"], found[-1][2] + u["words"]]
        else:
            found.append([u["start"], u["end"], u["words"]])
        last = u["i"]
    return [(a, b) for a, b, n in found if n >= min_run]


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 5,
          min_run: int = 35, inside: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Append n_units, kept_text and removed (array of start, end) to the ``keep`` columns (all) of every row.

    ``n_units`` counts lines, or paragraphs. A run of passages loses a part of a passage at each of
    its ends, so ``min_run`` of 35 words takes passages from some 50 words on.
    """
    kept = [c for c in keep or docs.columns if c.lower() not in ("n_units", "kept_text", "removed")]
    own_key, own_text, mark, gone, k, h = (scratch_name(docs, c) for c in ("own_key", "own_text", "mark", "gone", "k", "h"))
    digest = F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 15), 16, 10).cast("bigint")
    rows = docs.select(*kept, F.col(key).alias(own_key), F.col(text).alias(own_text), digest.alias(mark))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for piece in pieces(batch, "t"):
                tables = [unit_table(raw, unit, min_words, hasher) for raw in as_bytes(piece.column("t"))]
                at = pa.array(np.repeat(np.arange(len(tables)), [len(t[0]) for t in tables]))
                columns = [np.concatenate(c) for c in zip(*tables)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("k").take(at), piece.column("h").take(at), *(pa.array(c, t) for c, t in zip(
                        columns, [pa.int32()] * 4 + [pa.int64()] * 2))], names=["k", "h", "i", "start", "end", "words", "d1", "d2"])

    found = rows.where(F.col(own_text) != "").select(
        F.col(own_key).alias("k"), F.col(mark).alias("h"), F.col(own_text).alias("t"))
    schema = StructType([*found.select("k", "h").schema, *StructType.fromDDL("i int, start int, end int, words int, d1 bigint, d2 bigint")])
    table = shared_table(found.mapInArrow(tidy(split), schema), "units")
    # Most units are alone: only those that aren't are ranked.
    often = shared_table(table.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2"), "unit-repeats")
    again = shared_table(table.join(often, ["d1", "d2"], "left_semi"), "unit-copies")
    rank = F.struct(F.col("k").isNull().alias("none"), "k", "h", "i")
    # Written, so that the join has two plain exchanges and Spark can split that of a digest that very many texts have.
    first = shared_table(again.groupBy("d1", "d2").agg(F.min(rank).alias("first")), "unit-firsts")
    same_text = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("h") == F.col("first.h"))
    later = again.join(first, ["d1", "d2"]).where(rank != F.col("first") if inside else ~same_text)
    later = later.groupBy(F.col("k").alias(k), F.col("h").alias(h)).agg(
        F.sort_array(F.collect_set(F.struct("i", "start", "end", "words"))).alias(gone))
    joined = rows.join(later, F.col(own_key).eqNullSafe(F.col(k)) & (F.col(mark) == F.col(h)), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, own_text):
                counts, texts, spans = [], [], []
                for t, repeated in zip(piece.column(own_text).to_pylist(), piece.column(gone).to_pylist()):
                    if unit == "passage":
                        own = runs(repeated or [], min_run)
                        counts.append(t.count("\n") + 1 if t else 0)
                        texts.append("".join(t[a:b] for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(t)])) if own else t)
                    else:
                        whole = units(t, unit) if t else []
                        counts.append(len(whole))
                        texts.append(without(t, whole, {u["i"] for u in repeated}) if repeated else t)
                        own = [(u["start"], u["end"]) for u in repeated or []]
                    spans.append([{"start": a, "end": b} for a, b in own])
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(texts, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=[*kept, "n_units", "kept_text", "removed"])

    schema = StructType([*docs.select(*kept).schema, *StructType.fromDDL(
        "n_units bigint, kept_text string, removed array<struct<start:int,end:int>>")])
    return joined.select(*kept, own_text, gone).mapInArrow(tidy(cut), schema)

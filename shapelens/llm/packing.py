"""Packing token ids into windows by the sum-of-squares rule.

A document is the ids of its text and an end id. Whole windows of a long document
are cut off at once. What is left is placed online: of all fill levels that it
fits on top of, and the empty window, it goes to the one after which the sum of
the squared counts of partly filled windows is least (Csirik, Johnson and others,
"On the sum-of-squares algorithm for bin packing"). The counts stand in an array
with a place for each level, so a choice is one subtraction of two slices.

When a task ends, or holds ``most_open`` windows, the open windows are closed: the
emptiest give their documents, cut where needed, to the fullest, until one is
left. Its length is split into powers of two, which need no padding (``tail``
``split``), or it stays one padded window (``pad``).

Each task packs the rows of its own partition, with windows of its own, so nothing is
exchanged. Memory is that of the open windows and of the word cache. Where a task
runs again it gives the same windows for the same rows.

Ids come from a tokenizer file that drops white space, word by word: words parted by
ASCII white space are tokenized alone, and remembered. ``Words`` says why that gives
the ids of the whole text.

Edge cases: a null or empty text, or one of white space alone, is the end id alone;
equal rows and rows without key are packed like others; a document of any length is
cut into windows; ``length`` is never 0; an empty table gives no rows; columns
beside ``keep`` are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapelens.llm.common import as_bytes, pieces, scratch_name, tidy

#: Bytes of an id in the column ``ids`` (unsigned, little-endian).
WIDTH = 4
#: Words remembered in each of the two caches of a task.
REMEMBERED = 600_000
#: Letters (ASCII, or two bytes of Latin-1) and then ASCII marks or nothing.
LETTERS_MARKS = re.compile(rb"((?:[a-zA-Z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


class Words(dict):
    """word (bytes) -> its ids, packed.

    The tokenizer's rules part a text at white space and drop it; no merge, special
    token, composed letter or look-ahead reaches over it. They also part letters from the
    marks after them, and lower-case all, so ``Abc.`` is ``abc`` and ``.``. To a run of
    lower-case letters all rules before the merges do nothing but write its bytes as
    letters, so it goes to the merges at once (``merge``); all else through all rules.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.merge, self.letters, self.marks = tokenizer, tokenizer.model.tokenize, {}, {}
        # Byte-level BPE writes a byte as its Latin-1 character, one that doesn't print as the next from U+0100 on.
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
        self.written = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def _all_rules(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        parted = LETTERS_MARKS.fullmatch(word) if len(word) <= 64 else None
        if parted is None:
            found = self._all_rules(word)
        else:
            low = parted[1].decode().lower()
            found = self.letters.get(low)
            if found is None:
                written = low if low.isascii() else low.encode().decode("latin-1").translate(self.written)
                found = array("I", [t.id for t in self.merge(written)]).tobytes()
                if len(self.letters) >= REMEMBERED:
                    self.letters.clear()
                self.letters[low] = found
            if parted[2]:
                marks = self.marks.get(parted[2])
                if marks is None:
                    marks = self._all_rules(parted[2])
                    if len(self.marks) < REMEMBERED:
                        self.marks[parted[2]] = marks
                found += marks
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def word_encoder(path: str | None) -> Words:
    """Of a tokenizer file on the executor; None is the public one with word ends."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return Words(Tokenizer.from_file(path))


class Piece:
    """Ids of one document from ``start`` on; ``row`` has its kept columns and its number of ids."""

    __slots__ = ("row", "start", "ids")

    def __init__(self, row: tuple, start: int, ids: bytes):
        self.row, self.start, self.ids = row, start, ids

    def __len__(self) -> int:
        return len(self.ids) // WIDTH

    def cut(self, n: int) -> Piece:
        """Its first ``n`` ids as a piece; the rest stays here."""
        front = Piece(self.row, self.start, self.ids[:n * WIDTH])
        self.start, self.ids = self.start + n, self.ids[n * WIDTH:]
        return front


class Packer:
    """Open windows by fill level; ``add`` and ``close`` yield the windows that are done (lists of pieces)."""

    def __init__(self, capacity: int, most_open: int = 4096, tail: str = "split"):
        self.capacity, self.most_open, self.tail = capacity, most_open, tail
        self.counts = np.zeros(capacity + 1, np.int64)  # the level array; its ends stay 0
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity)]

    def level(self, size: int) -> int:
        """Where ``size`` more ids change the sum of squares least; the fullest of equals, 0 for a new window."""
        last = self.capacity - size
        change = 2 * (self.counts[size:] - self.counts[:last + 1]) + 2
        change[-1] -= 1  # no window is left at the level
        change[0] -= 1  # no window comes from the level
        change[1:][self.counts[1:last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def add(self, row: tuple, ids: bytes) -> Iterator[list[Piece]]:
        rest = Piece(row, 0, ids)
        while len(rest) >= self.capacity:
            yield [rest.cut(self.capacity)]
        if not len(rest):
            return
        at = self.level(len(rest))
        window = self.windows[at].pop() if at else []
        self.counts[at] -= at > 0
        window.append(rest)
        at += len(rest)
        if at == self.capacity:
            yield window
            return
        self.windows[at].append(window)
        self.counts[at] += 1
        if self.counts.sum() >= self.most_open:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """All open windows, filled up from the emptiest of them."""
        left = [(at, w) for at in range(self.capacity - 1, 0, -1) for w in self.windows[at]]
        self.counts[:] = 0
        self.windows = [[] for _ in range(self.capacity)]
        first, last = 0, len(left) - 1
        while first < last:
            at, window = left[first]
            giving = left[last][1]
            while at < self.capacity and giving:
                room = self.capacity - at
                window.append(giving.pop() if len(giving[-1]) <= room else giving[-1].cut(room))
                at += len(window[-1])
            left[first] = (at, window)
            if at == self.capacity:
                yield window
                first += 1
            if not giving:
                last -= 1
        if first == last and left[first][1]:
            window = left[first][1]
            yield from self._split(window) if self.tail == "split" else [window]

    def _split(self, window: list[Piece]) -> Iterator[list[Piece]]:
        window = window[::-1]
        while window:
            n = 1 << sum(map(len, window)).bit_length() - 1
            part: list[Piece] = []
            while n:
                part.append(window.pop() if len(window[-1]) <= n else window[-1].cut(n))
                n -= len(part[-1])
            yield part


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1,
         tokenizer: str | None = None, most_open: int = 4096, tail: str = "split", keep: Sequence[str] | None = None) -> DataFrame:
    """One row for a piece: ``keep`` columns (the key) and start, length, doc_tokens, sequence_id, offset, ids.

    ``start`` is the number of the document's ids before the piece, ``offset`` that of
    the sequence's; ``doc_tokens`` counts the document's ids with the end id; ``ids`` has
    four bytes for an id. ``tokenizer`` is a file that every executor has.
    """
    added = ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    kept = [c for c in keep or [key] if c.lower() not in added]
    own = scratch_name(docs, "own_text")
    end = np.array([end_id], "<u4").tobytes()
    schema = StructType([*docs.select(*kept).schema, *StructType.fromDDL(
        "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, types = word_encoder(tokenizer), Packer(capacity, most_open, tail), None
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [*types, *[pa.int64()] * 5, pa.binary()])], names=schema.names)

        def done(windows: Iterator[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            for window in windows:
                offset = 0
                for p in window:
                    rows.append((*p.row[:-1], p.start, len(p), p.row[-1], sequence, offset, p.ids))
                    offset += len(p)
                sequence += 1
                if len(rows) >= 1024:
                    yield out()

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(kept))]
            for piece in pieces(batch, own):
                values = zip(*(piece.column(i).to_pylist() for i in range(len(kept)))) if kept else [()] * piece.num_rows
                for value, raw in zip(values, as_bytes(piece.column(own))):
                    ids = words.ids(raw) + end
                    yield from done(packer.add((*value, len(ids) // WIDTH), ids))
        yield from done(packer.close())
        if rows:
            yield out()

    return docs.select(*kept, F.col(text).alias(own)).mapInArrow(tidy(run), schema)

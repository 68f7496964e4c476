"""Language identification with hyperdimensional profiles.

Each letter has a seeded random vector of +1 and -1. A letter n-gram is the
product (binding) of its letters' vectors, each rolled (permuted) by its place.
A text is the sum (bundle) of its n-gram vectors; a language's prototype is the
sum of the unit vectors of its training texts. The language of a text is the
prototype with the largest cosine.

Edge cases: null, empty and letterless texts get ``und`` and score 0, as every
text does when nothing was learned; equal cosines go to the smaller name;
training rows with a null language or without letters teach nothing; repeated
rows count as often as they come; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelens.llm.common import pieces, tidy, unit_hash

DIM = 1024
N = 3
UNDETERMINED = "und"
#: Unit vectors are summed as whole numbers of 1/SCALE, so that sums don't depend on their order.
SCALE = 1 << 20
#: N-gram vectors that a task keeps (float32 x DIM each).
KEPT = 1 << 14


class Space:
    """Letter n-grams of texts and their vectors, for one task."""

    def __init__(self, seed: int):
        self.seed = seed
        self.fold = np.zeros(0x110000, np.uint32)  # code point -> index of its letter, 0 for none
        self.known = np.zeros(0x110000, bool)
        self.index = {0: 0}  # lower-case code point -> index
        self.letters = [self._letter(0)]
        self._clear()

    def _letter(self, point: int) -> np.ndarray:
        bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, DIM, np.int8)
        return bits * 2 - 1

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((KEPT, DIM), np.float32)

    def _learn(self, points: np.ndarray) -> None:
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        for p in np.flatnonzero(seen & ~self.known).tolist():
            self.known[p] = True
            if chr(p).isalpha():
                low = ord(chr(p).lower()[0])
                if low not in self.index:
                    self.index[low] = len(self.letters)
                    self.letters.append(self._letter(low))
                self.fold[p] = self.index[low]

    def _vector(self, gram: int) -> np.ndarray:
        out = np.ones(DIM, np.int8)
        for place in range(N):
            out = out * np.roll(self.letters[gram & 0x1FFFFF], place)
            gram >>= 21
        return out

    def _matrix(self, grams: list[int]) -> np.ndarray:
        new = [g for g in grams if g not in self.rows]
        if len(self.rows) + len(new) > KEPT:
            self._clear()
            new = grams
        for g in new:
            self.rows[g] = len(self.rows)
            self.vectors[self.rows[g]] = self._vector(g)
        return self.vectors[[self.rows[g] for g in grams]]

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """The vector of each text; zero for a text without letters."""
        joined = "\n" + "\n".join(t or "" for t in texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
        self._learn(points)
        letters = self.fold[points].astype(np.int64)
        del points
        keep = letters != 0
        keep[1:] |= letters[:-1] != 0  # a run of other characters is one gap
        keep[0] = True
        doc = np.concatenate([[0], doc])[keep]
        letters = letters[keep]
        middle = letters[1:-1] != 0  # n-grams of words with a gap at either end
        grams = (letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[middle]
        doc = doc[1:-1][middle]
        out = np.zeros((len(texts), DIM), np.float32)
        names, place = distinct(grams, len(self.letters))
        for at in range(0, len(names), KEPT // 2):
            block = names[at:at + KEPT // 2]
            own = (place >= at) & (place < at + len(block))
            counts = np.bincount(doc[own] * len(block) + place[own] - at, minlength=len(texts) * len(block))
            out += counts.astype(np.float32).reshape(len(texts), -1) @ self._matrix(block.tolist())
        return out


def distinct(grams: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, and the place of each gram among them."""
    if letters ** N > 4 * len(grams) + (1 << 20):
        return np.unique(grams, return_inverse=True)
    dense = (grams >> 42) * letters ** 2 + (grams >> 21 & 0x1FFFFF) * letters + (grams & 0x1FFFFF)
    used = np.zeros(letters ** N, bool)
    used[dense] = True
    codes = np.flatnonzero(used)
    lookup = np.zeros(letters ** N, np.int64)
    lookup[codes] = np.arange(len(codes))
    names = codes // letters ** 2 << 42 | codes // letters % letters << 21 | codes % letters
    return names, lookup[dense]


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of 256 texts and about 1 MB at most (one text at least)."""
    for at in range(0, batch.num_rows, 256):
        yield from pieces(batch.slice(at, 256), text, 1 << 20)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", where: Column | None = None,
        key: str = "doc_id", rows_per_language: int = 10_000, seed: int = 4) -> dict[str, np.ndarray]:
    """Learn a prototype for each language of the rows in ``where``.

    Takes about ``rows_per_language`` rows of each language at most, chosen by a
    hash of ``key``. Returns to the driver one vector per language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(where) if where is not None else rows
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return {}
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, rows_per_language / n)).otherwise(share)
    rows = rows.where(unit_hash(F.col(key), seed=seed) < share)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(seed), {}
        for batch in batches:
            for piece in chunks(batch, "text"):
                vectors = np.rint(unit(space.encode(piece.column("text").to_pylist())) * SCALE)
                langs = np.array(piece.column("lang").to_pylist(), object)
                for name in set(langs):
                    sums[name] = sums.get(name, 0) + vectors[langs == name].sum(axis=0, dtype=np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"lang": list(sums), "v": [v.tolist() for v in sums.values()]},
                schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    total = (rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
             .mapInArrow(tidy(bundle), "lang string, v array<bigint>")
             .select("lang", F.posexplode("v").alias("i", "x"))
             .groupBy("lang", "i").agg(F.sum("x").alias("x")))
    out: dict[str, np.ndarray] = {}
    for r in total.collect():  # languages x DIM rows
        out.setdefault(r.lang, np.zeros(DIM))[r.i] = r.x
    return {name: v for name, v in sorted(out.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text",
             keep: list[str] | None = None, lang_pred: str = "lang_pred", score: str = "score",
             seed: int = 4) -> DataFrame:
    """Append the predicted language and its cosine (0 to 1) to the ``keep`` columns (all) of every row."""
    names = sorted(prototypes)
    matrix = unit(np.array([prototypes[n] for n in names])).astype(np.float32).T if names else None
    kept = [c for c in keep or docs.columns if c.lower() not in (lang_pred.lower(), score.lower())]
    read = [*kept, *[text] * (text not in kept)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(seed)
        for batch in batches:
            for piece in chunks(batch, text):
                vectors = unit(space.encode(piece.column(text).to_pylist()))
                found = vectors.any(axis=1)
                if names:
                    cosine = vectors @ matrix
                    best = cosine.argmax(axis=1)
                    value = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                else:
                    found[:] = False
                    best = value = np.zeros(piece.num_rows, int)
                label = [names[b] if f else UNDETERMINED for b, f in zip(best, found)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in kept]
                    + [pa.array(label, pa.string()), pa.array(np.where(found, value, 0).astype(float))],
                    names=[*kept, lang_pred, score])

    schema = docs.select(*kept).schema.add(lang_pred, "string").add(score, "double")
    return docs.select(*read).mapInArrow(tidy(predict), schema)

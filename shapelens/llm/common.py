"""Helpers shared by the operators: shared-folder tables, hashing, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelens.session import shared_table  # noqa: F401  (the operators take it from here)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A seeded hash of the columns, uniform in [0, 1)."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``max_bytes`` at most (one row at least)."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total + (n or 0) > max_bytes and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_table(*parting: tuple[int, int]) -> bytes:
    """Table for ``bytes.translate``: bytes in the ranges become spaces, A-Z lower case."""
    out = bytearray(range(256))
    out[65:91] = range(97, 123)
    for first, last in parting:
        out[first:last + 1] = b" " * (last + 1 - first)
    return bytes(out)


def word_lists(raw: bytes, table: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """All words of a text, in lists from some ``most`` bytes each, so that a very long text is no long list."""
    raw, start = raw.translate(table), 0
    while len(raw) - start > most:
        end = raw.rfind(b" ", start, start + most)
        end = end if end > start else raw.find(b" ", start + most)
        if end < 0:
            break
        yield raw[start:end].split()
        start = end
    yield raw[start:].split()


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (whatever the case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under column names of its own (own name: new name), beside which any column can be added."""
    names = {c: f"own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A task function on Arrow batches that gives its memory back when it has ended."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a function on the table of a group."""
    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            del table
            give_back()

    return wrapped

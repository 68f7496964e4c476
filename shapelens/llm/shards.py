"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``RING`` places, and each shard ``vnodes`` virtual nodes at hashed
places. A row's place is a hash of its key, size and text checksum, and belongs
to the next virtual node clockwise. A shard takes rows of its own places, place
by place and in the order of their hashes, until it is full; rows beyond that
continue clockwise to the next shard with room. Capacities differ by one row at most and add up to
all rows (law ``rows``), so the counts are balanced exactly, and only the rows
beyond a capacity leave the shard that the ring gives them.

Where a row goes follows from its rank at its place and from the number of rows
at each place. So Spark counts, the driver carries the counts round the ring
(``RING`` numbers, however many the rows), and Spark ranks the rows of each place
and looks up the part of the place that the rank falls in.

Edge cases: a null text has no bytes (size 1) and the checksum of nothing, and a
null key hashes as null, so such rows spread by their text; rows that are equal
in key, size and text share a place and are numbered in turn; with fewer rows
than shards some shards stay empty; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelens.llm.common import scratch_name

RING = 1 << 16


def owners(shards: int, vnodes: int, seed: int) -> list[int]:
    """The shard of every place: that of the next virtual node clockwise; of several at one place, the first."""
    at: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"{seed}/{shard}/{v}".encode()).digest()
            place = int.from_bytes(digest[:4], "big") % RING
            at[place] = min(at.get(place, (digest, shard)), (digest, shard))
    out, shard = [0] * RING, at[min(at)][1]
    for place in range(RING - 1, -1, -1):
        shard = at[place][1] if place in at else shard
        out[place] = shard
    return out


def carry(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, rows, shard, first slot) of every part of a place that stays together."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    parts: list[tuple[int, int, int, int, int]] = []

    def put(place: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            parts.append((place, first, n, shard, slot[shard]))
            slot[shard] += n
            room[shard] -= n
        return n

    over: dict[int, tuple[int, int]] = {}
    for place, (n, shard) in enumerate(zip(counts, owner)):
        taken = put(place, 0, n, shard)
        if taken < n:
            over[place] = (taken, n - taken)
    moving: deque[tuple[int, int, int]] = deque()  # what is on its way clockwise, the first to leave in front
    for place in [*range(len(counts)), *range(len(counts))]:
        while moving and room[owner[place]]:
            own, first, n = moving.popleft()
            taken = put(own, first, n, owner[place])
            if taken < n:
                moving.appendleft((own, first + taken, n - taken))
        if place in over:
            moving.append((place, *over.pop(place)))
    return parts


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def assign(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 16, vnodes: int = 256,
           seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """Append size (bytes plus 1), text_crc32, shard and slot (from 0, without gaps) to the ``keep`` columns (all)."""
    added = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in keep or docs.columns if c.lower() not in added]
    place, order, rank, first, n, start = (
        scratch_name(docs, c) for c in ("place", "order", "rank", "first", "n_part", "start"))
    rows = docs.select(*kept, size_of(F.col(text)).alias("size"), crc_of(F.col(text)).alias("text_crc32"),
                       F.xxhash64(F.lit(seed), F.col(key), size_of(F.col(text)), crc_of(F.col(text))).alias(order))
    rows = rows.withColumn(place, F.pmod(order, F.lit(RING)).cast("int"))
    counts = [0] * RING
    for p, c in rows.groupBy(place).count().collect():
        counts[p] = c
    parts = docs.sparkSession.createDataFrame(
        carry(counts, owners(shards, vnodes, seed), shards),
        f"{place} int, {first} bigint, {n} bigint, shard int, {start} bigint")
    # A part ends with its place or fills a shard, so there are RING + shards at most: small enough to send to every task.
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(place).orderBy(order)) - 1)
    inside = (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(first) + F.col(n))
    return (ranked.join(F.broadcast(parts), place).where(inside)
            .select(*kept, "size", "text_crc32", "shard", (F.col(start) + F.col(rank) - F.col(first)).alias("slot")))

"""N-gram Jaccard join: a size-aware join of light and heavy sets.

A document's set holds hashes of its distinct shingles of ``words`` words. Equal
sets fall together first (by a 128-bit digest), so copies are never paired. Two
sets link when they share ``percent`` in a hundred of their union, which needs
at least ceil(p (s + t) / (100 + p)) common shingles for sizes s and t.

* Every shingle's number of sets is counted over all documents. Shingles of one
  set can't be shared; a set with too few shared ones has no link and is out.
* Light sets (size up to a boundary) are joined by enumeration: sets that link
  have a common subset of a fixed size, so each set gives a key for each of its
  subsets of shared shingles of the sizes its possible partners need.
* Heavy sets scan inverted lists: ordered by the number of sets that have them,
  the first s - ceil(p s / 100) + 1 shingles of linked sets have one in common,
  so only their lists are scanned.
* The boundary is where the cost of both, subsets below and list entries above,
  added up over all sets by size, is least.

Candidates under one key are first compared with one pivot, the set whose
shingles are the most widespread, and links found merge classes. What two sets
share is at most what both share with the pivot plus the shared shingles that
both have beside it, so most pairs that did not meet through the pivot can't
link. The pairs left, each of two classes and within that bound, are compared.
So no link is lost, and a group of near copies costs a multiple of its size.

Shuffled shingles are packed: arrays of numbers for each piece of input and
slice of the hash range. Every phase ends in a table in the shared folder.

Edge cases: null, empty and blank texts have no shingles, size 0, no links and
themselves as component; fewer words than a shingle make one shingle; the
smallest key ignores nulls, and a class of null keys has a null component;
repeated rows are copies; other columns pass through. Hashes have 48 bits, six
bytes in a shuffle, so a pair of sets of 500 shingles is judged by one shingle
too many about once in 10^9 pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapelens.llm.common import as_bytes, pieces, shared_table, tidy, tidy_group

#: Odd multipliers of the word hashes in a shingle.
FACTORS = [np.uint64(int.from_bytes(hashlib.sha256(f"shingle {i}".encode()).digest()[:8], "big") | 1) for i in range(64)]
#: Shingles of one slice of the hash range.
SLICE = 3_000_000
#: Sizes among which the boundary is looked for.
MOST_LIGHT = 64
#: Word hashes that a task remembers.
KEPT = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: WordHashes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes (A-Z lower-cased, words split at white space)."""
    own = text.lower().split()
    n = min(words, len(own))
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    count = len(own) - n + 1
    total = np.full(count, np.uint64(n))
    for j in range(n):
        total += h[j:j + count] * FACTORS[j]
    return np.unique(mixed(total) >> np.uint64(16))


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def needed(s: int, t: int, percent: int) -> int:
    """Common shingles that sets of sizes s and t need."""
    return -(-percent * (s + t) // (100 + percent))


def least(s: int, percent: int) -> int:
    """Size of the smallest possible partner, and so the fewest common shingles."""
    return -(-percent * s // 100)


def subset_sizes(s: int, percent: int) -> list[int]:
    """Sizes of the subsets by which a set of size s meets every possible partner of its size or less."""
    return sorted({needed(t, t, percent) for t in range(least(s, percent), s + 1)})


def sign(docs: DataFrame, *, text: str = "text", words: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Append n_shingles and set_id (a digest of the set, null for the empty one) to the ``keep`` columns (all)."""
    kept = [c for c in keep or docs.columns if c.lower() not in ("n_shingles", "set_id")]
    read = [*kept, *[text] * (text not in kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(batch, text):
                sets = [shingle_set(t, hashes, words) for t in as_bytes(piece.column(text))]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.array(map(len, sets), pa.int64()),
                     pa.array(map(digest, sets), pa.binary())], names=[*kept, "n_shingles", "set_id"])

    schema = StructType([*docs.select(*kept).schema, *StructType.fromDDL("n_shingles bigint, set_id binary")])
    return docs.select(*read).mapInArrow(tidy(run), schema)


PACKED = "slot int, ids binary, sizes binary, counts binary, shingles binary, freqs binary"


def six_bytes(shingles: np.ndarray) -> bytes:
    return np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def packed(slot: int, ids, sizes, counts, shingles, freqs=None) -> tuple:
    return (slot, ids.tobytes(), sizes.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(),
            six_bytes(shingles), b"" if freqs is None else freqs.astype(np.uint32).tobytes())


def to_batch(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], schema.types[i]) for i in range(len(fields))], schema=schema)


def unpacked(table: pa.Table):
    """The packed rows of a group, joined: ids (n x 2 numbers), sizes, counts, shingles, freqs."""
    def of(name: str) -> bytes:
        return b"".join(table.column(name).to_pylist())
    return (np.frombuffer(of("ids"), np.uint64).reshape(-1, 2), np.frombuffer(of("sizes"), np.uint32),
            np.frombuffer(of("counts"), np.uint32), from_six_bytes(of("shingles")), np.frombuffer(of("freqs"), np.uint32))


def dealt(order_key: np.ndarray, slots: int) -> np.ndarray:
    """The slice of the range of 48-bit hashes that each is in."""
    return ((order_key >> np.uint64(16)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _packed_sets(docs: DataFrame, text: str, words: int, slots: int) -> DataFrame:
    """Each piece's distinct sets, cut by slice of the hash range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for piece in pieces(batch, "t", 4 << 20):
                sets: dict[bytes, np.ndarray] = {}
                for t in as_bytes(piece.column("t")):
                    own = shingle_set(t, hashes, words)
                    if len(own):
                        sets.setdefault(digest(own), own)
                if not sets:
                    continue
                ids = np.frombuffer(b"".join(sets), np.uint64).reshape(-1, 2)
                sizes = np.array([len(x) for x in sets.values()])
                shingles = np.concatenate(list(sets.values()))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                slot = dealt(shingles, slots)
                order = np.argsort(slot, kind="stable")
                ends = np.searchsorted(slot[order], np.arange(slots + 1))
                rows = []
                for i in range(slots):
                    part = order[ends[i]:ends[i + 1]]
                    if len(part):
                        counts = np.bincount(owner[part], minlength=len(sizes))
                        has = counts > 0
                        rows.append(packed(i, ids[has], sizes[has], counts[has], shingles[part]))
                yield from to_batch(rows, PACKED).to_batches()

    return docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), PACKED)


def _shared_shingles(table: pa.Table, slots: int) -> pa.Table:
    """Of one slice: the shingles that several sets have, with the number of sets, by set."""
    ids, sizes, counts, shingles, _ = unpacked(table)
    by_id = np.lexsort((ids[:, 1], ids[:, 0]))
    again = np.zeros(len(ids), bool)  # the same set in another piece
    again[by_id[1:]] = (ids[by_id[1:]] == ids[by_id[:-1]]).all(axis=1)
    owner = np.repeat(np.arange(len(ids)), counts)
    first = ~again[owner]
    owner, shingles = owner[first], shingles[first]
    order = np.argsort(shingles, kind="stable")
    run = shingles[order]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(run)]]))
    freq = np.empty(len(run), np.uint32)
    freq[order] = np.repeat(lengths, lengths)
    both = freq > 1
    owner, shingles, freq = owner[both], shingles[both], freq[both]
    slot = dealt(mixed(ids[owner, 0]) >> np.uint64(16), slots)
    order = np.argsort(slot, kind="stable")
    ends = np.searchsorted(slot[order], np.arange(slots + 1))
    rows = []
    for i in range(slots):
        part = order[ends[i]:ends[i + 1]]
        if len(part):
            own, n = np.unique(owner[part], return_counts=True)
            rows.append(packed(i, ids[own], sizes[own], n, shingles[part], freq[part]))
    return to_batch(rows, PACKED)


SETS = "set_id binary, size int, shared int, spread bigint, shingles binary, freqs binary"


def _linkable(table: pa.Table, percent: int) -> pa.Table:
    """Of one slice of set ids: the sets that can link, their shared shingles rarest first."""
    ids, sizes, counts, shingles, freqs = unpacked(table)
    names, owner = _distinct(ids)
    size = np.zeros(len(names), np.int64)
    size[owner] = sizes
    owner = np.repeat(owner, counts)
    order = np.lexsort((shingles, freqs, owner))
    owner, shingles, freqs = owner[order], shingles[order], freqs[order]
    ends = np.searchsorted(owner, np.arange(len(names) + 1))
    rows = []
    for i in range(len(names)):
        shared = int(ends[i + 1] - ends[i])
        if shared >= least(int(size[i]), percent):
            part = slice(ends[i], ends[i + 1])
            spread = int(freqs[part].sum(dtype=np.int64) * 1000 // size[i])
            rows.append((names[i].tobytes(), int(size[i]), shared, spread, shingles[part].tobytes(), freqs[part].tobytes()))
    return to_batch(rows, SETS)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and the place of each id among them."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.concatenate([[True], (ids[order[1:]] != ids[order[:-1]]).any(axis=1)]) if len(ids) else np.zeros(0, bool)
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    return ids[order][new], place


def boundary(costs: dict[int, tuple[float, float]]) -> int:
    """The largest light size: subsets up to it and list entries above it cost least."""
    def total(x: int) -> float:
        return sum(light if s <= x else heavy for s, (light, heavy) in costs.items())
    return min(range(MOST_LIGHT + 1), key=lambda x: (total(x), x))


def prefix_length(size: int, shared: int, percent: int) -> int:
    """Shared shingles in the prefix; those of one set alone come before them."""
    return max(0, size - least(size, percent) + 1 - (size - shared))


def _costs(sets: DataFrame, percent: int) -> dict[int, tuple[float, float]]:
    """Subsets and list entries of the sets of each size that may be light."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, shared, freqs in zip(*(batch.column(c).to_pylist() for c in ("size", "shared", "freqs"))):
                lists = np.frombuffer(freqs, np.uint32)[:prefix_length(size, shared, percent)].sum(dtype=np.int64)
                subsets = sum(math.comb(shared, k) for k in subset_sizes(size, percent))
                out.append((size, float(min(subsets, 1e15)), float(lists)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64()))],
                names=["size", "light", "heavy"])

    rows = sets.where(F.col("size") <= MOST_LIGHT).select("size", "shared", "freqs").mapInArrow(tidy(run), "size int, light double, heavy double")
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("size").agg(F.sum("light"), F.sum("heavy")).collect()}


def _keys(sets: DataFrame, light: int, percent: int) -> DataFrame:
    """(key, set_id, size, shared, spread): subsets of light sets; prefix shingles of heavy sets and of those that may link to one."""
    ddl = "key binary, set_id binary, size int, shared int, spread bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            columns = ("set_id", "size", "shared", "spread", "shingles")
            for *own, blob in zip(*(batch.column(c).to_pylist() for c in columns)):
                _, size, shared, _ = own
                shingles = [blob[i:i + 8] for i in range(0, len(blob), 8)]
                if size <= light:
                    for k in subset_sizes(size, percent):
                        for subset in itertools.combinations(sorted(shingles), k):
                            rows.append((hashlib.blake2b(b"".join(subset), digest_size=16).digest(), *own))
                            if len(rows) >= 50_000:
                                yield from to_batch(rows, ddl).to_batches()
                                rows = []
                if size >= least(light + 1, percent):
                    rows += ((x, *own) for x in shingles[:prefix_length(size, shared, percent)])
            yield from to_batch(rows, ddl).to_batches()

    return sets.select("set_id", "size", "shared", "spread", "shingles").mapInArrow(tidy(run), ddl)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, linked) of every (a, b) pair of set ids."""
    own = sets.select("set_id", "size", "shingles")
    full = (pairs.join(own.toDF("a", "size_a", "x"), "a").join(own.toDF("b", "size_b", "y"), "b")
            .select("a", "b", "size_a", "size_b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                      for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            sizes = zip(batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist())
            linked = [c >= needed(s, t, percent) for c, (s, t) in zip(common, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int32()), pa.array(linked, pa.bool_())],
                names=["a", "b", "common", "linked"])

    return full.mapInArrow(tidy(run), "a binary, b binary, common int, linked boolean")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (set_id, label) after the classes at both ends of each (a, b) link are one; the smaller label stays."""
    while True:
        edges = (links.join(labels.toDF("a", "p"), "a").join(labels.toDF("b", "q"), "b").where("p <> q")
                 .select(F.greatest("p", "q").alias("old"), F.least("p", "q").alias("new"))
                 .groupBy("old").agg(F.min("new").alias("new")))
        edges = shared_table(edges, "near-hooks")
        if edges.isEmpty():
            return labels
        for _ in range(2):  # follow the chain of hooks: four steps
            further = edges.toDF("new", "next")
            edges = shared_table(edges.join(further, "new", "left").select("old", F.coalesce("next", "new").alias("new")), "near-hooks")
        labels = shared_table(labels.join(edges.toDF("label", "new"), "label", "left")
                              .select("set_id", F.coalesce("new", "label").alias("label")), "near-labels")


def classes(docs: DataFrame, *, text: str = "text", words: int = 5, percent: int = 80, shingles: int | None = None) -> DataFrame:
    """(set_id, label) of every set that links to another; sets with one label are one class.

    ``shingles`` is the number of shingles of all documents, if known.
    """
    if shingles is None:
        shingles = sign(docs, text=text, words=words, keep=[]).agg(F.sum("n_shingles")).first()[0]
    slots = max(16, -(-(shingles or 0) // SLICE))
    shared = _packed_sets(docs, text, words, slots).groupBy("slot").applyInArrow(tidy_group(lambda t: _shared_shingles(t, slots)), PACKED)
    sets = shared_table(shared.groupBy("slot").applyInArrow(tidy_group(lambda t: _linkable(t, percent)), SETS), "near-sets")
    light = boundary(_costs(sets, percent))
    keys = _keys(sets, light, percent)
    # Keys with the same sets give the same candidates: one of them is enough, and none if it has one set.
    mark = [F.xxhash64("set_id"), F.xxhash64(F.lit(1), "set_id")]
    lists = keys.groupBy("key").agg(F.count("*").alias("n"), *(F.bit_xor(m).alias(f"m{i}") for i, m in enumerate(mark)))
    lists = lists.where("n > 1").groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    entries = shared_table(keys.join(lists, "key", "left_semi"), "near-keys")
    labels = shared_table(sets.select("set_id", F.col("set_id").alias("label")), "near-labels")
    sized = (F.col("size") * percent <= F.col("size_b") * 100) & (F.col("size_b") * percent <= F.col("size") * 100)

    # Every set of a key against the key's pivot.
    pivot = entries.groupBy("key").agg(F.max_by(F.struct("set_id", "size"), F.struct("spread", "set_id")).alias("p"))
    pivot = shared_table(pivot.select("key", F.col("p.set_id").alias("pivot"), F.col("p.size").alias("size_b")), "near-pivots")
    near = entries.join(pivot, "key")
    first = near.where((F.col("set_id") != F.col("pivot")) & sized).select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))
    first = shared_table(_compared(first.distinct(), sets, percent), "near-first")
    labels = _merge(labels, first.where("linked").select("a", "b"))

    # What a set shares with the pivot (inside) and beside it (outside); all of it for both where that is not known.
    known = near.join(first.select(F.col("a").alias("set_id"), F.col("b").alias("pivot"), "common"), ["set_id", "pivot"], "left")
    inside = F.coalesce("common", "shared")
    outside = F.when(F.col("set_id") == F.col("pivot"), 0).otherwise(F.coalesce(F.col("shared") - F.col("common"), F.col("shared")))
    # Sets with a key in common have its pivot in common: a pair comes up once for a pivot, not once for a key.
    known = known.join(labels, "set_id").select(
        "pivot", "set_id", "size", "label", inside.alias("inside"), outside.alias("outside"), "key")
    known = shared_table(known.groupBy("pivot", "set_id", "size", "label", "inside", "outside").agg(
        F.collect_set("key").alias("keys")), "near-known")
    most = known.groupBy("pivot").agg(F.max("outside").alias("most"))
    can = F.col("inside") + F.least("outside", "most") >= F.ceil(F.col("size") * percent / 100)
    open_ = known.join(most, "pivot").where(can).drop("most")
    main = open_.groupBy("pivot", "label").agg(F.count("*").alias("n")).groupBy("pivot").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"))
    open_ = shared_table(open_.join(main.where("labels > 1").select("pivot", "main"), "pivot"), "near-open")
    other = open_.select("pivot", *(F.col(c).alias(f"{c}_b") for c in ("set_id", "size", "label", "inside", "outside", "keys")))
    bound = F.least("inside", "inside_b") + F.least("outside", "outside_b")
    pairs = open_.where("label <> main").join(other, "pivot").where(
        (F.col("label") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("label") < F.col("label_b")))
        & sized & (bound * (100 + percent) >= percent * (F.col("size") + F.col("size_b"))) & F.arrays_overlap("keys", "keys_b"))
    pairs = pairs.select(F.least("set_id", "set_id_b").alias("a"), F.greatest("set_id", "set_id_b").alias("b")).distinct()
    labels = _merge(labels, shared_table(_compared(pairs, sets, percent).where("linked").select("a", "b"), "near-links"))
    many = labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return labels.join(many, "label", "left_semi").select("set_id", "label")


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5,
               percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, set_id, class_id.

    component_id is the smallest key of the class; class_id a digest that all
    rows of a class have, null for rows without shingles.
    """
    members = shared_table(sign(docs, text=text, words=words, keep=[key]), "near-members")
    total = members.agg(F.sum("n_shingles")).first()[0]
    label = classes(docs, text=text, words=words, percent=percent, shingles=total)
    own = members.where("set_id is not null").groupBy("set_id").agg(F.min(key).alias("first"))
    own = own.join(label, "set_id", "left").withColumn("class_id", F.coalesce("label", "set_id"))
    own = shared_table(own, "near-own")
    smallest = own.where("label is not null").groupBy("label").agg(F.min("first").alias("smallest"))
    alone = own.where("label is null").select("set_id", "class_id", F.col("first").alias("component_id"))
    linked = own.where("label is not null").join(smallest, "label").select(
        "set_id", "class_id", F.col("smallest").alias("component_id"))
    own = shared_table(linked.unionByName(alone), "near-components")
    empty = members.where("set_id is null").select(
        key, "n_shingles", F.col(key).alias("component_id"), "set_id", F.col("set_id").alias("class_id"))
    return (members.where("set_id is not null").join(own, "set_id")
            .select(key, "n_shingles", "component_id", "set_id", "class_id").unionByName(empty))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class: that of the smallest key (nulls last), then of the smallest set digest.

    Rows without shingles are classes of their own and stay.
    """
    order = F.struct(F.col(key).isNull(), F.col(key), F.col("set_id"))
    found = components(docs, key=key, text=text, words=words, percent=percent).where("class_id is not null")
    best = found.groupBy("class_id").agg(F.min(order).alias("b")).select(
        F.col("b.set_id").alias("best_set"), F.col(f"b.{key}").alias("best_key"))
    signed = sign(docs.toDF(*(f"_{c}" for c in docs.columns)), text=f"_{text}", words=words)
    full = signed.where("set_id is not null").join(
        shared_table(best, "near-best"), (F.col("set_id") == F.col("best_set")) & F.col(f"_{key}").eqNullSafe(F.col("best_key")))
    full = full.dropDuplicates(["set_id", f"_{key}"])
    names = [F.col(f"_{c}").alias(c) for c in docs.columns]
    return full.select(*names).unionByName(signed.where("set_id is null").select(*names))

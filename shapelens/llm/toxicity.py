"""Toxicity score from a factorization machine over hashed terms.

Terms are a text's distinct lower-case words, and the beginnings of longer ones
(a stem often carries the meaning), hashed into ``SLOTS`` slots. Spark counts, over a bounded sample
of labelled rows, in how many toxic and clean texts each slot occurs; slots
whose shares differ clearly become features, and so do their partners: slots whose shares
differ clearly among the texts that hold a feature, however common they are elsewhere (a group's name is
in many clean texts, but beside an insult it tells). The machine adds a bias, a weight
for each feature and the dot product of the latent vectors of each pair of
features, so a pair (an insult beside a group's name) can count for more than
the sum of its parts. It is trained by Adam on the sample's feature rows; weights start from, and
decay towards, a part of each feature's log ratio of shares, so a clear term that
the sample mostly shows beside others still counts when it stands alone.

Edge cases: null and empty texts have no features and get the bias alone;
labels that are null or join no text teach nothing; a key with several labels
counts as toxic if one of them says so; without a toxic or without a clean
training row every score is 0 or 1 by the one class seen, and 0 with no row;
repeated rows are scored each, and a key with several texts teaches the least of them; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelens.llm.common import shared_table, tidy, unit_hash

SLOTS = 1 << 18
LATENT = 8
BEGINNINGS = (3, 5, 7)
#: Share of its log ratio at which a weight starts.
START = 0.35
WORD = re.compile(r"[^\W\d_]+")
#: A slot is a feature if its shares in toxic and clean texts differ by Z standard errors and by a factor of e^RATIO.
Z, RATIO = 5.0, 1.0
#: A partner's shares among the texts with a feature differ by Z standard errors and by this factor (as a logarithm).
PARTNER_RATIO = 0.7
#: Distinct words whose slots a task remembers.
KEPT = 200_000


@dataclass
class Machine:
    """bias, and for each feature slot its weight and latent vector."""

    bias: float
    slots: dict[int, int]
    weight: np.ndarray
    latent: np.ndarray

    def score(self, features: list[list[int]]) -> np.ndarray:
        if not features:
            return np.zeros(0)
        counts = [len(f) for f in features]
        row = np.repeat(np.arange(len(features)), counts)
        col = np.array([i for f in features for i in f], np.int64)
        return sigmoid(logits(self.bias, self.weight, self.latent, row, col, len(features))[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logits(bias, weight, latent, row, col, n):
    """Scores of n feature rows given as (row, column) pairs, and each row's sum of latent vectors."""
    v = latent[col]
    total = np.stack([np.bincount(row, v[:, f], n) for f in range(LATENT)], axis=1)
    squares = np.bincount(row, (v * v).sum(axis=1), n)
    linear = np.bincount(row, weight[col], n)
    return bias + linear + ((total * total).sum(axis=1) - squares) / 2, total


class Terms:
    """Slots of the terms of a text, for one task."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= KEPT:
            self.known.clear()
        names = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]
        found = self.known[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in names)
        return found

    def slots(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            out.update(self.known.get(word) or self._word(word))
        return out


def train_rows(rows: list[list[int]], toxic: np.ndarray, start: np.ndarray, seed: int, epochs: int = 40):
    """Bias, weights and latent vectors by Adam on the logistic loss with a small decay."""
    rng = np.random.default_rng(seed)
    width, prior = len(start), np.clip(toxic.mean(), 1e-3, 1 - 1e-3)
    first = [np.array([np.log(prior / (1 - prior))]), start, np.zeros((width, LATENT))]
    p = [first[0], start, rng.normal(0, 0.05, (width, LATENT))]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    n, batch, rate, decay = len(rows), 256, 0.02, 3e-4
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            take = order[at:at + batch]
            row = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
            col = np.array([c for i in take for c in rows[i]], np.int64)
            z, total = logits(p[0][0], p[1], p[2], row, col, len(take))
            error = (sigmoid(z) - toxic[take]) / len(take)
            pull = error[row][:, None] * (total[row] - p[2][col])
            grads = [np.array([error.sum()]), np.bincount(col, error[row], width),
                     np.stack([np.bincount(col, pull[:, f], width) for f in range(LATENT)], axis=1)]
            step += 1
            for i, g in enumerate(grads):
                g = g + decay * (p[i] - first[i])
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def _telling(found: DataFrame, n1: int, n0: int, ratio: float, least: float = Z) -> list[tuple[int, float]]:
    """(slot, log ratio of its shares) of the slots whose shares in ``n1`` toxic and ``n0`` clean rows differ clearly."""
    slot = found.select("y", F.explode("slots").alias("s")).groupBy("s").agg(
        F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1), (F.col("c0") + 0.5) / (n0 + 1)
    pooled = (F.col("c1") + F.col("c0") + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    chosen = slot.where((F.abs(z) >= least) & (F.abs(F.log(p1 / p0)) >= ratio)).select("s", F.log(p1 / p0).alias("r"))
    return sorted((r.s, r.r) for r in chosen.collect())


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
        toxic: str = "toxic", where: Column | None = None, rows_per_class: int = 12_000,
        seed: int = 1) -> Machine:
    """Train on the texts that ``labels`` marks, of the keys in ``where`` (an expression on the labels).

    Takes about ``rows_per_class`` rows of either class at most, chosen by a hash
    of the key, and allows for the different shares taken. The driver gets class
    counts for at most ``SLOTS`` slots, and the sample's rows of feature numbers.
    """
    marks = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull())
    marks = (marks.where(where) if where is not None else marks).groupBy(key).agg(
        F.max(F.when(F.col(toxic) > 0, 1).otherwise(0)).alias("y"))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, rows_per_class / max(1, sizes.get(y, 0))) for y in (0, 1)}
    sample = marks.where(unit_hash(F.col(key), seed=seed) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    sample = sample.select(F.col(key).alias("k"), "y")
    # At most about 2 * rows_per_class rows of two numbers: small enough to send to every task.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")
    # One row for a key, however often it comes; the sample is read several times.
    rows = shared_table(rows.groupBy("k").agg(F.max("y").alias("y"), F.min("t").alias("t")), "toxicity-sample")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [sorted(terms.slots(t)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["y", "slots"])

    found = rows.mapInArrow(tidy(slots), "y int, slots array<int>")
    counts = found.groupBy("y").agg(F.count("*").alias("n"))
    n = {r.y: r.n for r in counts.collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not (n0 and n1):
        return Machine(40.0 if n1 else -40.0, {}, np.zeros(0), np.zeros((0, LATENT)))
    ratios = _telling(found, n1, n0, RATIO)
    index = {s: i for i, (s, _) in enumerate(ratios)}

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(s in index for s in own) for own in batch.column("slots").to_pylist()], pa.bool_()))

    near = found.mapInArrow(tidy(beside), "y int, slots array<int>")
    m = {r.y: r.n for r in near.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if m.get(0) and m.get(1):
        partners = {s for s, _ in _telling(near, m[1], m[0], PARTNER_RATIO)} - index.keys()
        ratios = sorted(ratios + [(s, r) for s, r in _telling(found, n1, n0, 0.0, 0.0) if s in partners])
        index = {s: i for i, (s, _) in enumerate(ratios)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            own = [sorted(index[s] for s in terms.slots(t) if s in index) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(own, pa.list_(pa.int32()))], names=["y", "f"])

    data = rows.mapInArrow(tidy(features), "y int, f array<int>").collect()
    data.sort(key=lambda r: (r.y, r.f))  # the same order on each run
    bias, weight, latent = train_rows([r.f for r in data], np.array([r.y for r in data], float),
                                      np.array([r * START for _, r in ratios], float), seed)
    return Machine(bias + float(np.log(share[0]) - np.log(share[1])), index, weight, latent)


def score(docs: DataFrame, machine: Machine, *, text: str = "text", keep: list[str] | None = None,
          score: str = "score") -> DataFrame:
    """Append the toxicity score (0 to 1) to the ``keep`` columns (all) of every row."""
    kept = [c for c in keep or docs.columns if c.lower() != score.lower()]
    read = [*kept, *[text] * (text not in kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            rows = [sorted(machine.slots[s] for s in terms.slots(t) if s in machine.slots)
                    for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(machine.score(rows), pa.float64())], names=[*kept, score])

    return docs.select(*read).mapInArrow(tidy(run), docs.select(*kept).schema.add(score, "double"))

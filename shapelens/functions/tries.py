"""Fold of sorted paths into counts of their prefixes, range by range.

Paths (``/a/b/``) come sorted, so the trie of a range is walked depth first: the open
nodes are the prefixes of the last path, and a node is closed, and its count and
smallest keys go to its parent, when a path comes that isn't below it. Memory is that of one
path's nodes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from heapq import merge
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Pickled by value with each task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 8192


class Fold:
    """Open nodes of the last path; ``rows`` collects closed ones as (prefix, depth, count, samples)."""

    def __init__(self, n: int):
        self.n, self.parts, self.nodes, self.rows, self.begun = n, [], [], [], False

    def add(self, path: str, key: str) -> None:
        parts = path[1:-1].split("/")
        same = 0
        for a, b in zip(parts, self.parts):
            if a != b:
                break
            same += 1
        self.close(same)
        for _ in range(same, len(parts)):
            # [count, smallest keys, whether the node may have begun in an earlier range]
            self.nodes.append([0, [], not self.begun])
        self.parts, self.begun = parts, True
        leaf = self.nodes[-1]
        leaf[0] += 1
        leaf[1] = list(islice(merge(leaf[1], [key]), self.n))

    def close(self, depth: int, end: bool = False) -> None:
        """Close the nodes below ``depth``; at the end of the range any may go on in the next one."""
        while len(self.nodes) > depth:
            count, samples, edge = self.nodes.pop()
            if count > 1 or edge or end or not self.nodes:
                self.rows.append((f"/{'/'.join(self.parts[:len(self.nodes) + 1])}/", len(self.nodes) + 1, count, samples))
            if self.nodes:
                above = self.nodes[-1]
                above[0] += count
                above[1] = list(islice(merge(above[1], samples), self.n))


def fold_paths(paths: DataFrame, n: int) -> DataFrame:
    """(prefix, depth, count, sample_keys) of each range of sorted (key, path); prefixes at its edges are parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(n)

        def out() -> pa.RecordBatch:
            prefix, depth, count, samples = zip(*fold.rows)
            fold.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(prefix, pa.string()), pa.array(depth, pa.int32()), pa.array(count, pa.int64()),
                 pa.array(samples, pa.list_(pa.string()))], names=["prefix", "depth", "count", "sample_keys"])

        for batch in batches:
            for path, key in zip(batch.column("path").to_pylist(), batch.column("key").to_pylist()):
                fold.add(path, key)
                if len(fold.rows) >= BATCH:
                    yield out()
        fold.close(0, end=True)
        if fold.rows:
            yield out()

    return paths.select("path", "key").mapInArrow(run, "prefix string, depth int, count bigint, sample_keys array<string>")

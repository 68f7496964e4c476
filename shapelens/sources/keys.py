"""Key listings as DataFrames (O-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelens.functions.keys import glob_to_regex


def scan_keys(df: DataFrame, key_col: str = "key", glob: str = "*",
              prefix: str | None = None) -> DataFrame:
    """Keys matching a key-store glob (or a plain prefix).

    The glob becomes one anchored regex evaluated in the scan's generated code;
    a prefix becomes ``startswith``, which parquet can push down.
    """
    out = df
    if prefix:
        out = out.where(F.col(key_col).startswith(prefix))
    if glob and glob != "*":
        literal = _literal_prefix(glob)
        if literal:
            # A prefix filter the file scan can push down, ahead of the regex.
            out = out.where(F.col(key_col).startswith(literal))
        out = out.where(F.col(key_col).rlike(glob_to_regex(glob)))
    return out


def _literal_prefix(glob: str) -> str:
    """The characters of a glob before its first wildcard or escape."""
    for i, c in enumerate(glob):
        if c in "*?[\\":
            return glob[:i]
    return glob

"""Registry of the checked queries over the driver's testdata tables.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` built from the
library's operators; its oracle is DuckDB SQL over the same parquet tables
(registered as views named like the tables). Arrays and maps are rendered as
text on both sides so results compare as scalars.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shapelens.session import TESTDATA_TABLES, read_table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` as query ``name`` with its DuckDB oracle (if any)."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def spark_sql(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """Run an input template in Spark with ``{table}`` bound to the parquet table."""
    names = sorted(set(_PLACEHOLDER.findall(template)) & set(TESTDATA_TABLES))
    return spark.sql(template, **{n: read_table(spark, sf_dir, n) for n in names})


def duck_sql(template: str) -> str:
    """The same template as DuckDB text over the pre-registered views."""
    return template.format(**{n: n for n in TESTDATA_TABLES})

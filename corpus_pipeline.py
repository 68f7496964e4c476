"""Corpus pipeline: language ID, near-duplicate removal, decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. Columns that a stage works with have names that the table hasn't, so extra
columns of any name pass through all stages. ``run`` writes each stage's result to the shared folder and reads it back,
so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelens.llm import decontaminate, jaccard, language, mixture, shards
from shapelens.llm.common import apart, crc_mod, shared_table
from shapelens.session import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows whose language can't be told go; ``lang`` becomes the predicted one.

    Null and empty texts and those without a letter go, of any length; ties go to the smaller
    language; repeated rows get one prediction; a table without labelled rows gives no rows.
    """
    rows, back = apart(docs)
    found = language.identify(rows, language.fit(docs, where=crc_mod("doc_id", 3) != 1), text=back["text"])
    found = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return found.select(*(F.col("lang_pred" if c == "lang" else x).alias(c) for c, x in back.items()))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of linked documents the one with the smallest id stays.

    Rows without shingles (null, empty, blank) all stay; of repeated rows with one id and one
    set of shingles one stays; an empty table gives no rows.
    """
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a window of a benchmark item go.

    Null and empty texts stay; texts are read whole; repeated rows are judged alike; an empty
    table gives no rows, an empty benchmark all.
    """
    rows, back = apart(docs)
    found = decontaminate.clean(rows, read_table(spark, sf_dir, "benchmark"), text=back["text"])
    return found.select(*(F.col(x).alias(c) for c, x in back.items()))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as the mix takes it; those that it doesn't take go.

    Null, empty and blank texts have no words and go; a null source is a source of its own;
    repeated rows are taken in turn; an empty table gives no rows.
    """
    rows, back = apart(docs)
    found = mixture.mix(rows, key=back["doc_id"], text=back["text"], source=back["source"]).where(F.col("copies") > 0)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select(*(F.col(x).alias(c) for c, x in back.items()))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: ``size``, ``text_crc32``, ``shard`` and ``slot`` of each row; a column of such a name gets a ``_`` in front.

    A null text has size 1; copies and repeated rows are dealt in turn; an empty table gives no rows.
    """
    added = ("size", "text_crc32", "shard", "slot")
    taken = {c.lower() for c in docs.columns}
    names = {}
    for c in docs.columns:
        names[c] = c
        while names[c].lower() in added or names[c] != c and names[c].lower() in taken:
            names[c] = f"_{names[c]}"
        taken.add(names[c].lower())
    return shards.assign(docs.toDF(*names.values()))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("source_mix", source_mix),
    ("sharding", sharded),
]

#: Language vectors and hashes of 64 bits have no DuckDB form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

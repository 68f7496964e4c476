"""Each stage of the corpus pipeline against a plain version on its own input."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shapelens.llm.queries import ORACLES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each one, and a DuckDB session on them."""
    root = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "123 ...", "en", "src1", 7),
                                   (9003, "", "de", None, 0), (9001, None, None, None, None)], docs.schema)
    paths = [f"{root}/in"]
    docs.unionByName(extra).write.parquet(paths[0])
    for name, stage in corpus_pipeline.STAGES:
        paths.append(f"{root}/{name}")
        stage(spark, spark.read.parquet(paths[-2]), FOLDER).write.parquet(paths[-1])
    return [pd.read_parquet(p) for p in paths], paths


def duck(path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{FOLDER}/benchmark.parquet')")
    return con.execute(ORACLES[name]).df()


def ids(frame):
    return sorted(frame.doc_id)


def test_columns(stages):
    frames, _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "source_mix", "sharding"]
    for frame in frames[:-1]:
        assert list(frame.columns) == COLUMNS
    assert set(COLUMNS) < set(frames[-1].columns)


def test_language_rejects_only_what_has_no_letter(stages):
    before, after = stages[0][0], stages[0][1]
    has = before.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert ids(after) == ids(before[has]) and after.lang.isin(["en", "de", "fr", "es"]).all()


def test_one_of_each_group(stages):
    frames, paths = stages
    want = duck(paths[1], "op3_jaccard_join")
    assert ids(frames[2]) == sorted(want[want.doc_id == want.component_id].doc_id)


def test_contaminated_go(stages):
    frames, paths = stages
    want = duck(paths[2], "op2_decontaminate")
    assert ids(frames[3]) == ids(want[~want.contaminated]) and want.contaminated.any()


def test_mix(stages):
    frames, paths = stages
    want = duck(paths[3], "op10_source_mix")
    copies = (want.taken // want["size"].clip(lower=1)).astype(int)
    assert ids(frames[4]) == sorted(i for i, n in zip(want.doc_id, copies) for _ in range(n))


def test_shards(stages):
    frames, _ = stages
    assert ids(frames[5]) == ids(frames[4])
    sizes = frames[5].groupby("shard").slot.agg(["count", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all()


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert ids(got) == ids(stages[0][5])


def test_columns_of_any_name_pass(spark):
    """Columns named like those that the operators add keep their values; an empty table goes through."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["_copy", "copy", "copies", "size", "n_hit", "items", "lang_pred", "_lang", "score", "shard", "_shard", "slot", "set_id", "own_0", "body"]
    wide = docs.select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, FOLDER)
        plain = stage(spark, docs, FOLDER)
        kept = {n: n for n in names}
        if name == "sharding":
            kept |= {"size": "_size", "shard": "__shard", "slot": "_slot"}
        got = out.select("doc_id", *kept.values()).collect()
        assert sorted(r.doc_id for r in got) == ids(plain.select("doc_id").toPandas())
        assert all(r[new] == f"{old} {r.doc_id}" for r in got for old, new in kept.items())
        assert name == "sharding" or out.columns == wide.columns
        assert stage(spark, wide.limit(0), FOLDER).count() == 0


def test_very_long_text_goes_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = spark.createDataFrame([(9100, " ".join(f"long{i % 997}y tail{i}" for i in range(60_000)), "en", "src1", None)], docs.schema)
    docs = docs.unionByName(long)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).where("doc_id = 9100").count() >= (stage is not corpus_pipeline.source_mix)

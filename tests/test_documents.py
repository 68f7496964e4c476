import json
import random

import pytest
from pyspark.sql import functions as F

from shapelens.functions.shapes import depth, leaves, levels, shape, shape_leaves
from shapelens.operators.documents import (NO_OBJECT, collection_profile, document_columns, field_profile,
                                           flatten_documents, object_documents, path_type_counts,
                                           sample_documents, sample_documents_per_group)
from shapelens.sources.documents import document_validity, read_documents, read_json_lines
from shapelens.functions.values import value_type

from conftest import SF_SMALL

DOCS = [
    (0, '{"_id":1,"age":25,"ok":true,"tags":["a"],"m":{"role":"x","level":5},"at":"2024"}'),
    (1, '{"_id":2,"age":30.5,"m":{"role":"u","level":2},"e":{}}'),
    (2, '{"_id":3,"age":null,"m":null,"n":{"d":{"w":10.0}}}'),
    (3, '{bad'), (4, '{"a":1,"a":2}'), (5, '[1,{"a":2}]'),
]


@pytest.fixture(scope="module")
def docs(spark):
    raw = spark.createDataFrame(DOCS, "doc_id int, json string")
    return read_documents(raw, "json", "doc_id")


def test_validity(docs):
    r = document_validity(docs).collect()[0]
    assert (r.total, r.valid, r.objects) == (6, 4, 3)


def test_flatten_paths(docs):
    got = {}
    for r in flatten_documents(docs.where("is_object")).collect():
        got.setdefault(r.doc_id, []).append(r.path)
    assert sorted(got[0]) == ["_id", "age", "at", "m.level", "m.role", "ok", "tags"]
    assert sorted(got[1]) == ["_id", "age", "m.level", "m.role"]
    assert sorted(got[2]) == ["_id", "age", "m", "n.d.w"]


def test_field_profile_fixture(docs):
    rows = {(r.path, r.type): r for r in field_profile(docs).collect()}
    assert {k: (r.type_pct, r.occurrence_pct) for k, r in rows.items() if k[0] == "age"} == {
        ("age", "number"): (33, 100), ("age", "double"): (33, 100), ("age", "null"): (33, 100)}
    assert (rows[("m", "null")].occurrence_pct, rows[("m", "null")].type_pct) == (33, 100)
    assert rows[("m.role", "string")].occurrence_pct == 67
    assert rows[("n.d.w", "number")].occurrence_pct == 33
    assert ("e", "object") not in rows
    # property: type counts add up to the occurrences of their path
    per_path = {}
    for (p, _), r in rows.items():
        per_path[p] = per_path.get(p, 0) + r.type_count
        assert per_path[p] <= r.occurrences
    for (p, _), r in rows.items():
        assert per_path[p] == r.occurrences


def test_document_columns(docs):
    cols = {r.name: r for r in document_columns(field_profile(docs)).collect()}
    assert cols["age"].type == "double(33%) | null(33%) | number(33%)"
    assert cols["_id"].nullable is False and cols["m"].nullable is True
    assert cols["m.role"].comment == "Occurs in 67% of documents"


def typed(docs):
    flat = flatten_documents(docs)
    return sorted((r.path, r.type) for r in flat.select("path", value_type("value").alias("type")).collect())


def test_dotted_key_collision(spark):
    raw = spark.createDataFrame([(0, '{"a.b":1,"a":{"b":"x","c":2}}')], "doc_id int, json string")
    assert typed(read_documents(raw, "json", "doc_id")) == [("a.b", "number"), ("a.c", "number")]


def test_any_depth(spark):
    text = '{"k":' * 60 + "1" + "}" * 60
    raw = spark.createDataFrame([(0, text)], "doc_id int, json string")
    assert typed(read_documents(raw, "json", "doc_id")) == [(".".join(["k"] * 60), "number")]


HARD = ['{"a":1,"a":2}', '{"a":NaN}', '{"a":1}', '{"a":1e999}', '{"a":12345678901234567890.12345}',
        '{"a\'b":{"c d":[1]},"x\\"y":"z"}', "", "null", "7"]


def test_text_and_variant_agree(spark):
    text = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(99, None)], "doc_id int, doc string")
    variant = text.withColumn("doc", F.try_parse_json("doc"))
    for docs in (text, variant):
        rows = {(r.path, r.type): r.type_count for r in path_type_counts(docs).collect()}
        assert rows == {("a", "number"): 1, ("a", "double"): 2, ("a'b.c d", "array"): 1,
                        ('x"y', "string"): 1, (None, None): 4, (None, NO_OBJECT): 6}
        assert object_documents(docs).first().asDict() == {"docs": 4, "others": 6}
    a, b = (sorted(map(str, field_profile(d).collect())) for d in (text, variant))
    assert a == b


def test_values_are_not_rewritten(spark):
    docs = spark.createDataFrame([(0, '{"n":12345678901234567890.12345,"big":1e999}')], "doc_id int, doc string")
    got = {r.path: r.text for r in flatten_documents(docs).select("path", F.to_json("value").alias("text")).collect()}
    assert got["n"] == "12345678901234567890.12345"


def test_typed_dates_keep_their_type(spark):
    docs = spark.sql("select 1 as doc_id, to_variant_object(named_struct('d', date'2024-01-01')) as doc")
    assert typed(docs) == [("d", "date")]
    assert [(r.path, r.type) for r in field_profile(docs).collect()] == [("d", "date")]


def test_collection_profile_counts_every_document(docs):
    rows = docs.withColumn("collection", F.when(F.col("doc_id") < 3, "a").otherwise("b"))
    got = {r.collection: (r.document_count, r.sample_size, r.field_count) for r in collection_profile(rows).collect()}
    assert got == {"a": (3, 3, 9), "b": (3, 3, 0)}


def test_sample_per_group(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS g")
    got = [r.g for r in sample_documents_per_group(df, "g", "id", 5).collect()]
    assert sorted(got) == [0] * 5 + [1] * 5 + [2] * 5


def test_dates_from_typed_variant(spark):
    df = spark.sql("select to_variant_object(named_struct('d', date'2024-01-01')) as v")
    assert df.select(value_type(F.expr("v:d")).alias("t")).collect()[0].t == "date"


def test_sample_is_reproducible(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    a = [r.event_id for r in sample_documents(ev, "event_id", 50, "7").collect()]
    b = [r.event_id for r in sample_documents(ev, "event_id", 50, "7").collect()]
    assert a == b and len(a) == 50 and len(set(a)) == 50


def leaf_steps(doc):
    """Dotted path -> the keys down to a leaf; of equal paths the one with fewer keys, then the first by key."""
    found, level = {}, [([], doc)]
    while level:
        below = []
        for steps, node in level:
            for key in sorted(node, key=str.encode):
                if isinstance(node[key], dict):
                    below.append(([*steps, key], node[key]))
                else:
                    found.setdefault(".".join([*steps, key]), ([*steps, key], node[key]))
        level = below
    return found


def type_of(value):
    if isinstance(value, bool) or value is None:
        return "boolean" if value is not None else "null"
    if isinstance(value, (int, float)):
        return "number" if value % 1 == 0 else "double"
    return "array" if isinstance(value, list) else "string"


ODD_KEYS = ["a", "b", "a.b", "", "9", "x y", "q`q", "``", "[", "k", "a'b\"c", "\\", "<>", "OBJECT<", "z: BIGINT", ", ", "é", "tab\there", "nl\n", "VOID"]


def random_documents(n, seed=5):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randint(0, 9 if depth else 6)
        if kind > 6:
            return {rng.choice(ODD_KEYS): value(depth - 1) for _ in range(rng.randint(0, 5))}
        return [None, True, rng.randint(-5, 5), 2.5, 1e300, "OBJECT<a: VOID>", [1, {"x": {"y": ["z"]}}, [[]]]][kind]

    return [{rng.choice(ODD_KEYS): value(4) for _ in range(rng.randint(0, 6))} for _ in range(n)]


def test_shapes_against_brute_force(spark):
    """Keys with any characters, clashing dotted paths, arrays of arrays and objects, whole and broken doubles."""
    made = random_documents(300)
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(made)], "doc_id int, doc string")
    want = {}
    for d in made:
        for path, (_, value) in leaf_steps(d).items():
            want[path, type_of(value)] = want.get((path, type_of(value)), 0) + 1
    got = {(r.path, r.type): r.type_count for r in path_type_counts(docs).collect()}
    assert got.pop((None, None)) == len(made) and got == want
    flat = {}
    for r in flatten_documents(docs).select("doc_id", "path", F.to_json("value").alias("v")).collect():
        flat.setdefault(r.doc_id, {})[r.path] = r.v
    for i, d in enumerate(made):
        steps = leaf_steps(d)
        assert flat.get(i, {}).keys() == steps.keys()
        assert all(json.loads(flat[i][p]) == v for p, (_, v) in steps.items())


def test_shape_and_values_give_the_same_paths(spark):
    docs = spark.createDataFrame([(json.dumps(d),) for d in random_documents(200, 6)], "doc string").select(F.try_parse_json("doc").alias("doc"))
    rows = docs.select(F.transform(shape_leaves(shape("doc")), lambda r: F.struct(r["path"], r["level"])).alias("a"),
                       F.transform(leaves("doc"), lambda r: F.struct(r["path"], r["level"])).alias("b"),
                       levels(shape("doc")).alias("n"), depth(shape("doc")).alias("depth")).collect()
    for r in rows:
        assert sorted(r.a) == sorted(r.b) and all(x.level <= min(r.n, r.depth) for x in r.a)


def test_as_many_shapes_as_documents(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('{\"k', id, '\": ', id, ', \"same\": 1e2}') AS doc")
    rows = {(r.path, r.type): r.type_count for r in path_type_counts(docs).collect()}
    assert len(rows) == 3002 and rows["same", "number"] == 3000 and rows[None, None] == 3000 and rows["k7", "number"] == 1


def test_wide_document(spark):
    text = json.dumps({f"k{i}": {"v": i} for i in range(5000)})
    docs = spark.createDataFrame([(0, text)], "doc_id int, doc string")
    assert path_type_counts(docs).count() == 5001 and flatten_documents(docs).count() == 5000


def test_profiles_stay_in_the_jvm(docs, spark):
    for df in (field_profile(docs), flatten_documents(docs), collection_profile(docs, "doc_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_profile_by_group_with_null(spark):
    docs = spark.createDataFrame([(None, '{"a":1}'), (None, '{"b":1}'), ("x", '{"a":null}'), ("y", "[1]")], "g string, doc string")
    got = {(r.g, r.path, r.type): r.occurrence_pct for r in field_profile(docs, by=["g"]).collect()}
    assert got == {(None, "a", "number"): 50, (None, "b", "number"): 50, ("x", "a", "null"): 100}


def test_json_lines(spark, tmp_path):
    lines = ['{"a":1}', "{bad", "[1,2]", "7", "", '{"a":1,"a":2}', "null", '"s"', "  ", '{"_corrupt_record":5}', '{"doc":{"x":1}}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = read_json_lines(spark, str(tmp_path))
    assert document_validity(got).first()[:] == (9, 7, 3)
    assert sorted(r.malformed for r in got.where("NOT is_valid").collect()) == sorted(["{bad", '{"a":1,"a":2}'])
    assert {r.path for r in path_type_counts(got).where("path IS NOT NULL").collect()} == {"a", "_corrupt_record", "doc.x"}

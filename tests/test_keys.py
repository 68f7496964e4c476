import random
from pyspark.sql import functions as F

from shapelens.functions.keys import glob_to_regex, key_template
from shapelens.operators.keys import key_template_groups, key_totals, prefix_rollup
from shapelens.sources.keys import scan_keys

TEMPLATES = {
    "user:1:name": "user:*", "user:1:email": "user:*", "user:2:name": "user:*",
    "user:2:email": "user:*", "user:3:name": "user:*",
    "session:abc123": "session:*", "session:def456": "session:*",
    "product:101": "product:*", "product:102": "product:*",
    "queue:emails": "queue*", "queue:notifications": "queue:*",
    "tags:post1": "tags:*", "tags:post2": "tags:*",
    "leaderboard:game1": "leaderboard:*", "leaderboard:game2": "leaderboard:*",
    "counter:views:page1": "counter:views:*", "counter:views:page2": "counter:views:*",
    "counter:likes:post1": "counter:likes:*",
    "cache:user:1:profile": "cache:user:*", "cache:user:2:profile": "cache:user:*",
    "cache_product_456": "cache_product_*", "user123": "user*",
    "keyabc123def4567890abcdef": "key*", "abc": "abc", "123:foo": "123*",
    "a.b-77": "a.b-*", "facade:decade": "facade:*", "x:decade": "x:*",
    "trailing:12:": "trailing:*", "userabc:*": "user*",
    # several hex runs (rule 3 in its general form)
    "tok0123456789abcdef01x89abcdef0zz": "tok*x*zz",
}

KEY_TYPES = {
    "user:1:name": "string", "user:1:email": "string", "user:2:name": "string",
    "user:2:email": "string", "user:3:name": "string", "session:abc123": "string",
    "session:def456": "string", "product:101": "hash", "product:102": "hash",
    "queue:emails": "list", "queue:notifications": "list", "tags:post1": "set",
    "tags:post2": "set", "leaderboard:game1": "zset", "leaderboard:game2": "zset",
    "counter:views:page1": "string", "counter:views:page2": "string",
    "counter:likes:post1": "string", "cache:user:1:profile": "string",
    "cache:user:2:profile": "string",
}

PREFIX_KEYS = ["users/1/name", "users/1/email", "users/2/name", "users/2/email",
               "users/3/name", "config/db/host", "config/db/port", "config/db/database",
               "cache/page1", "cache/page2", "counters/views", "counters/likes",
               "sessions/abc123", "sessions/def456"]


def test_key_template_goldens(spark):
    df = spark.createDataFrame([(k,) for k in TEMPLATES], "key string")
    got = {r.key: r.t for r in df.select("key", key_template("key").alias("t")).collect()}
    assert got == TEMPLATES


def test_key_template_is_function_of_key(spark):
    df = spark.createDataFrame([(k,) for k in list(TEMPLATES) * 3], "key string")
    per_key = df.select("key", key_template("key").alias("t")).distinct()
    assert per_key.count() == len(TEMPLATES)


def test_key_template_groups_fixture(spark):
    keys = spark.createDataFrame(list(KEY_TYPES.items()), "key string, type string")
    rows = key_template_groups(keys, "key", "type", n=10).collect()
    got = {r.pattern: (r["count"], dict(r.types)) for r in rows}
    assert got == {
        "user:*": (5, {"string": 5}), "cache:user:*": (2, {"string": 2}),
        "counter:views:*": (2, {"string": 2}), "leaderboard:*": (2, {"zset": 2}),
        "product:*": (2, {"hash": 2}), "session:*": (2, {"string": 2}),
        "tags:*": (2, {"set": 2}), "counter:likes:*": (1, {"string": 1}),
        "queue*": (1, {"list": 1}), "queue:*": (1, {"list": 1})}
    # ordered by count desc, then pattern
    assert [r.pattern for r in rows][:2] == ["user:*", "cache:user:*"]
    assert sum(r["count"] for r in rows) == len(KEY_TYPES)
    user = [r for r in rows if r.pattern == "user:*"][0]
    assert user.sample_keys == sorted(k for k in KEY_TYPES if k.startswith("user:"))


def test_sample_keys_are_capped_per_group(spark):
    keys = spark.range(0, 500).select(F.concat(F.lit("user:"), F.col("id")).alias("key"),
                                      F.lit("string").alias("type"))
    rows = key_template_groups(keys, n=10).collect()
    assert len(rows) == 1 and rows[0]["count"] == 500 and len(rows[0].sample_keys) == 10


def test_prefix_rollup_fixture(spark):
    keys = spark.createDataFrame([("/test/" + k,) for k in PREFIX_KEYS], "key string")
    roll = prefix_rollup(keys)
    got = [(r.prefix, r.depth, r["count"]) for r in roll.collect()]
    assert got == [
        ("/test/", 1, 14), ("/test/users/", 2, 5), ("/test/config/", 2, 3),
        ("/test/cache/", 2, 2), ("/test/counters/", 2, 2), ("/test/sessions/", 2, 2),
        ("/test/config/db/", 3, 3), ("/test/users/1/", 3, 2), ("/test/users/2/", 3, 2)]
    totals = key_totals(keys, roll).collect()[0]
    assert (totals.scanned_keys, totals.distinct_keys, totals.overlapped_total) == (14, 14, 35)


def test_prefix_child_never_exceeds_parent(spark):
    keys = spark.range(0, 300).select(F.concat(
        F.lit("/a/"), (F.col("id") % 7).cast("string"), F.lit("/"),
        (F.col("id") % 5).cast("string"), F.lit("/k"), F.col("id").cast("string")).alias("key"))
    rows = {r.prefix: r["count"] for r in prefix_rollup(keys, samples=False).collect()}
    for p, n in rows.items():
        parent = p[: p[:-1].rfind("/") + 1]
        if parent in rows:
            assert n <= rows[parent]


def test_glob_scan(spark):
    keys = spark.createDataFrame([(k,) for k in ["user:1", "user:12", "user:2", "usr:1",
                                                 "user:1a", "user:[x]"]], "key string")
    got = sorted(r.key for r in scan_keys(keys, glob="user:1*").collect())
    assert got == ["user:1", "user:12", "user:1a"]
    got = sorted(r.key for r in scan_keys(keys, glob="user:?").collect())
    assert got == ["user:1", "user:2"]
    got = sorted(r.key for r in scan_keys(keys, glob="user:[12]*").collect())
    assert got == ["user:1", "user:12", "user:1a", "user:2"]
    assert glob_to_regex("a*").endswith("\\z")


def test_prefix_rollup_against_brute_force(spark):
    """Doubled slashes, keys that are prefixes of others, deep chains, a hot prefix over several ranges, repeats and nulls."""
    rng = random.Random(8)
    keys = [None, "", "/", "a", "/a", "a/", "//a//b", "/a/b", "é/中/x", "/".join("c" * 60)] + ["/".join("c" * 59) + "/d"]
    keys += ["/hot/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(1, 5))) + f"/{i % 300}" for i in range(1500)]
    keys += ["/" + "/".join(rng.choice(["a", "b", "a b", "B", "a!"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    want = {}
    for k in {k for k in keys if k is not None}:
        parts = [p for p in k.split("/") if p]
        for d in range(1, len(parts) + 1):
            want.setdefault(("/" + "/".join(parts[:d]) + "/", d), []).append(k)
    want = {(p, d, len(own), tuple(sorted(own)[:5])) for (p, d), own in want.items() if d == 1 or len(own) >= 2}
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    roll = prefix_rollup(df, "key", n=5)
    got = [(r.prefix, r.depth, r["count"], tuple(r.sample_keys)) for r in roll.collect()]
    assert set(got) == want and len(got) == len(want)
    assert got == sorted(got, key=lambda r: (r[1], -r[2], r[0]))
    plain = prefix_rollup(df, "key", samples=False)
    assert plain.columns == ["prefix", "depth", "count"] and {tuple(r) for r in plain.collect()} == {w[:3] for w in want}
    total = key_totals(df, plain, "key").first()
    assert total.distinct_keys == len({k for k in keys if k is not None}) and total.overlapped_total == sum(w[2] for w in want)
    assert prefix_rollup(df.limit(0), "key").count() == 0


def test_prefix_rollup_moves_a_key_once(spark, tmp_path):
    """Bytes and rows exchanged, by Spark's own counters: keys 4 and 40 parts deep are moved alike."""
    def moved(depth):
        df = spark.range(20000).selectExpr(f"concat(repeat('/p', {depth - 2}), '/', id % 100, '/k', id) AS key")
        roll = prefix_rollup(df, "key", samples=False)
        roll.collect()
        plan = roll._jdf.queryExecution().executedPlan()
        rows = []

        def walk(node):
            for kid in (node.executedPlan(),) if "AdaptiveSparkPlan" in node.nodeName() else (node.plan(),) if "QueryStage" in node.nodeName() else [
                    node.children().apply(i) for i in range(node.children().size())]:
                walk(kid)
            if node.nodeName() == "Exchange":
                rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        walk(plan)
        return sum(rows)

    assert moved(40) <= moved(4) + 40 * 8 * 4

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import zlib

import pytest
from pyspark.sql import functions as F

from shapelens.llm import decontaminate, html_text, imatch, jaccard, language, lines, mixture, shards, toxicity, urls

DOC = "doc_id bigint, text string, lang string, source string"
LONG = " ".join(f"word{i % 977} tail" for i in range(20_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a"),
    (1, "the cat sat on the mat and looked at the moon", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "der hund lief durch den wald und schlief dann ein", "de", None),
    (None, None, "de", "b"),
    (4, LONG, "en", "b"),
    (5, " \n\t ", None, "c"),
    (6, "... 123 !!!", "de", "c"),
    (7, "der hund lief durch den wald und schlief dann ein", "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def clash(df, *names):
    """The table with extra columns that have the names of an operator's own ones."""
    return df.withColumns({n: F.lit("mine") for n in names})


def test_language(docs, none):
    learned = language.fit(docs)
    out = language.identify(clash(docs, "lang_pred", "score", "lang_"), learned).collect()
    assert len(out) == len(ROWS) and sorted(learned) == ["de", "en"]
    for r in out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        if letters:
            assert r.lang_pred == r.lang
    assert language.fit(none) == {} and language.identify(none, learned).count() == 0
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_language_tie_goes_to_the_smaller_name(docs):
    same = language.fit(docs)["en"]
    assert {r.lang_pred for r in language.identify(docs, {"b": same, "a": same}).collect()} == {"a", "und"}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (2, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    machine = toxicity.fit(docs, labels)
    out = toxicity.score(clash(docs, "score", "y", "slots"), machine).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if not (r.text or "").strip(" \n\t.!123")}
    assert len(empty) == 1
    assert toxicity.score(none, machine).count() == 0
    nothing = toxicity.fit(none, labels)
    assert {round(r.score, 6) for r in toxicity.score(docs, nothing).collect()} == {0.0}
    toxic_only = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {round(r.score, 6) for r in toxicity.score(docs, toxic_only).collect()} == {1.0}


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "CAT sat, on the MAT!"), (2, "sat on the"), (3, None), (4, ""), (None, "cat"), (5, "no such words here"),
         (6, "sat on the")], "item_id bigint, text string")
    out = decontaminate.hits(clash(docs, "n_hit", "items", "body"), items).collect()
    assert len(out) == len(ROWS)
    for r in out:
        if r.doc_id == 1:
            assert (r.n_words, r.n_hit, r["items"]) == (11, 5, [1, 2, 6])
            assert [tuple(s) for s in r.spans] == [(1, 5), (2, 3)]
        else:
            assert r.n_hit == 0 and r["items"] == [] and r.spans == []
    assert decontaminate.hits(none, items).count() == 0
    assert decontaminate.hits(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    full = decontaminate.hits(docs, items, most_bits=1).select("doc_id", "n_words", "n_hit", "items", "spans")
    assert sorted(map(str, full.collect())) == sorted(
        map(str, decontaminate.hits(docs, items).select("doc_id", "n_words", "n_hit", "items", "spans").collect()))
    named = decontaminate.hits(docs, items.withColumn("item_id", F.concat(F.lit("item "), "item_id")), item_text="text")
    assert [r["items"] for r in named.where("doc_id = 1").collect()] == [["item 1", "item 2", "item 6"]] * 2
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.clean(docs, items).count() == len(ROWS) - sum(r[0] == 1 for r in ROWS)


def test_jaccard(docs, none):
    out = jaccard.components(docs).collect()
    assert len(out) == len(ROWS)
    by_size = sorted((r.n_shingles, r.doc_id is None, r.doc_id or 0, r.component_id) for r in out)
    german = [r for r in by_size if r[0] == 6]
    assert german == [(6, False, 7, 7), (6, True, 0, 7)]
    assert [r for r in by_size if r[0] == 7] == [(7, False, 1, 1)] * 2
    assert {(r[2], r[3]) for r in by_size if r[0] == 0} == {(2, 2), (3, 3), (5, 5), (0, None)}
    assert jaccard.components(none).count() == 0
    kept = jaccard.keep_one(clash(docs, "set_id", "n_shingles")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept) == [
        (0, ""), (1, "the"), (2, ""), (3, ""), (4, "wor"), (5, " \n\t"), (6, "..."), (7, "der")]
    assert kept[0].set_id == "mine" and jaccard.keep_one(none).count() == 0


def test_urls(spark):
    rows = [(1, "https://WWW.Example.COM/en/x?a=/b#c"), (2, None), (3, "no mark"), (4, "http://a.net"), (4, "http://a.net"),
            (5, "x://casino-win.org/" + "a" * 50_000), (6, "http://example.com/en/"), (7, "ftp://net/es/?q"), (8, "://")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    out = urls.judge(clash(pages, "host", "path", "rule"), rules).collect()
    found = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert [(found[i].host, found[i].path, found[i].rule) for i in (2, 3, 8)] == [("", "", None)] * 3
    assert (found[4].host, found[4].path, found[4].rule) == ("a.net", "", None)
    assert (found[6].rule, found[6].verdict) == ("example.com/en/", "block") and found[7].rule == "net/es/"
    assert found[5].verdict == "block" and len(found[5].path) == 50_001
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert urls.judge(pages, [], labelled=[]).where("verdict = 'block'").count() == 0


def test_html(spark):
    page = "<body><nav>menu</nav><article><h1>T</h1><p>One &amp; two<p>three" + " long" * 30_000 + "</article><footer>f</footer>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://h/3", ""), (4, "http://h/4", "plain &lt;text&gt;"),
            (4, "http://h/4", "plain &lt;text&gt;"), (5, None, "<p>cut off <b"), (6, "http://h/6", "<nav>only</nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = html_text.extract(clash(pages, "host", "path", "body"), keep=["page_id", "host"]).collect()
    found = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and out[0].host == "mine"
    assert found[1].startswith("T\nOne & two\nthree long") and len(found[1]) == len("T\nOne & two\nthree") + 150_000
    assert (found[2], found[3], found[4], found[5], found[6]) == ("", "", "plain <text>", "cut off", "")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_imatch(docs, none):
    out = imatch.compare(clash(docs, "term", "fingerprint")).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    by_text = {}
    for r, text in ((r, next(t for i, t, *_ in ROWS if i == r.doc_id)) for r in out if r.doc_id is not None):
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint and r.n_chars == len(text or "")
    assert imatch.compare(none).count() == 0


def test_shards(docs, none):
    out = shards.assign(clash(docs, "slot", "place", "rank"), shards=4).collect()
    assert len(out) == len(ROWS) and out[0].rank == "mine"
    for r in out:
        data = (r.text or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    counts = [sorted(r.slot for r in out if r.shard == s) for s in range(4)]
    assert all(c == list(range(len(c))) for c in counts) and sorted(map(len, counts)) == [2, 2, 3, 3]
    assert shards.assign(none).count() == 0


def test_lines(spark, none):
    text = "alpha beta gamma delta epsilon\nshort line\nAlpha, beta gamma: delta EPSILON!"
    rows = [(2, text), (1, "alpha beta gamma delta epsilon"), (2, text), (3, None), (None, "alpha beta gamma delta epsilon\n"),
            (4, ""), (5, "short line\n" * 3), (6, LONG), (7, LONG)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = lines.dedup(clash(docs, "removed", "k", "mark")).collect()
    assert len(out) == len(rows) and out[0].mark == "mine"
    found = {r.doc_id: (r.n_units, r.kept_text, [tuple(s) for s in r.removed]) for r in out}
    assert found[1] == (1, "alpha beta gamma delta epsilon", [])
    assert found[2] == (3, "short line", [(0, 30), (42, 75)])
    assert found[3] == (0, None, []) and found[4] == (0, "", []) and found[None] == (2, "", [(0, 30)])
    assert found[5] == (4, "short line\n" * 3, []) and found[6][1] == LONG and found[7] == (1, "", [(0, len(LONG))])
    assert lines.dedup(none).count() == 0
    paragraphs = spark.createDataFrame([(1, "a b c d e\n\nf\n \na b c d e"), (2, "a b c\nd e")], "doc_id bigint, text string")
    got = {r.doc_id: r.kept_text for r in lines.dedup(paragraphs, unit="paragraph").collect()}
    assert got == {1: "a b c d e\n\nf", 2: ""}


def test_mixture(docs, none):
    out = mixture.mix(clash(docs, "size", "rank", "slice"), slices=4).collect()
    assert len(out) == len(ROWS) and out[0].rank == "mine"
    sizes = {}
    for r in out:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 2 and (r.size or not r.copies)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert all(r.source_size == sizes[r.source] and r.target <= 2 * r.source_size for r in out)
    assert mixture.mix(none).count() == 0

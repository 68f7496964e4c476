"""Registered queries of the operators: contract columns over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelens.llm import (decontaminate, divergence, html_text, imatch, jaccard, language, lexical, lines, mixture, packing, shards,
                           toxicity, urls)
from shapelens.llm.common import crc_mod
from shapelens.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    prototypes = language.fit(docs, where=~held_out)
    return (language.identify(docs, prototypes, keep=["doc_id"])
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = crc_mod("doc_id", 4) == 2
    machine = toxicity.fit(docs, labels, where=~held_out)
    return (toxicity.score(docs, machine, keep=["doc_id"])
            .select("doc_id", held_out.alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


#: The rules of op5.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return (urls.judge(pages, URL_RULES)
            .select("page_id", "host", "path", "rule", "verdict", "score"))


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return (html_text.extract(pages, keep=["page_id", "url"])
            .withColumn("n_chars", F.length("text").cast("long")))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
places AS (SELECT row_id, n, i, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k
    FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT p.row_id, p.i, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.k = win.k),
hit AS (SELECT row_id, count(DISTINCT pos) AS n_hit FROM
    (SELECT row_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT row_id, i, n FROM found)) GROUP BY row_id),
ids AS (SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM
    (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256,
    coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN ids USING (row_id)
"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return (decontaminate.hits(docs, items, keep=["doc_id"])
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated")))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws(':', '10', CAST(doc_id AS VARCHAR), md5(text))) AS rank FROM documents),
s AS (SELECT source, n, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
    FROM (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source)),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / w, source NULLS LAST) AS k,
    1.5::DOUBLE * sum(n) OVER () - 2.0 * (sum(n) OVER o - n) AS rest,
    sum(w) OVER () - (sum(w) OVER o - w) AS total
    FROM s WHERE n > 0 WINDOW o AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT rest, total FROM r WHERE w * rest / total <= 2.0 * n ORDER BY k LIMIT 1),
t AS (SELECT s.source, s.n, CASE WHEN s.n = 0 THEN 0.0 WHEN f.rest IS NULL OR s.w * f.rest / f.total > 2.0 * s.n
    THEN 2.0 * s.n ELSE s.w * f.rest / f.total END AS target FROM s LEFT JOIN f ON true),
u AS (SELECT d.doc_id, d.size, CAST(t.n AS BIGINT) AS source_size, CAST(t.target AS DOUBLE) AS target,
    CASE WHEN t.n > 0 THEN floor(t.target / t.n) ELSE 0 END AS whole, t.n,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS reached
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(size * (whole + CASE WHEN reached <= target - whole * n THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u
"""


@query("op10_source_mix", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixture.mix(docs, keep=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.assign(docs, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb
    FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT reach.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a
"""


@query("op3_jaccard_join", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.components(docs).select("doc_id", "n_shingles", "component_id")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, text, md5(text) AS h, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT doc_id, h, i, l[i] AS line,
    string_split(trim(regexp_replace(translate(l[i], '{_UP}', '{_LOW}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w
    FROM (SELECT doc_id, h, l, unnest(range(1, len(l) + 1)) AS i FROM d WHERE text <> '')),
r AS (SELECT doc_id, h, i, line,
    len(w) >= 5 AND row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, h, i) > 1 AS gone,
    sum(length(line) + 1) OVER (PARTITION BY doc_id, h ORDER BY i) - length(line) - 1 AS start FROM u),
k AS (SELECT doc_id, h, count(*) AS n, count(*) FILTER (gone) AS g,
    coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(line) AS BIGINT), ',' ORDER BY i) FILTER (gone), '') AS spans,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id, h)
SELECT d.doc_id, coalesce(k.n, 0) AS n_units, coalesce(k.g, 0) AS n_removed, coalesce(k.spans, '') AS removed,
    CAST(coalesce(length(k.kept), 0) AS BIGINT) AS kept_chars, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.h = k.h
"""


@query("op9_passage_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of some 50 words and more that an earlier document has."""
    return _repeats(spark, sf_dir, unit="passage", inside=False)


@query("whole_line_dedup", OP9_SQL)
def whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with lines as units, whatever their length from five words on."""
    return _repeats(spark, sf_dir, unit="line")


def _repeats(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("kept_text", F.lit(""))
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return lines.dedup(docs, keep=["doc_id"], **how).select(
        "doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"),
        F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


@query("op6_imatch")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_sum_of_squares_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
i AS (SELECT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark)),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
    FROM p, s GROUP BY term),
f AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(d.w) * docs) // words)))) AS impact
    FROM p JOIN t USING (term) JOIN d USING (r), s),
x AS (SELECT item, any_value(item_id) AS item_id, r, CAST(sum(impact) AS BIGINT) AS score FROM i JOIN f USING (term) GROUP BY item, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM x JOIN d USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""


@query("op12_ranked_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.rank(docs, items).select("item_id", "rank", "doc_id", "score")


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
    FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT x.lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (x.total + 5 * v)::HUGEINT AS BIGINT) AS p,
    1 + CAST((1000000000::HUGEINT * (lang_n + 5)) // (v.total + 5 * v)::HUGEINT AS BIGINT) AS q FROM x JOIN v ON v.lang = x.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))

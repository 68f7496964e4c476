"""Packing, ranked search and divergence: brute force over small tables, edge cases, blocks and cells cut small."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shapelens.llm import divergence, lexical, packing
from shapelens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string"


def table(folder, name):
    return pd.read_parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = ["", "   \t\n", "Abc. ABC, abc! don't WON'T it's 's 't", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>", "é É İ İ K",
       "Été Über straße ×÷ ÿÀ", "a b c　d\u0085e\x1cf\x0bg", "ΕΣ ςσ 中文。 \U0001f600\U0001f601 กำ",
       "1234 5.6 a1b2 ... ..., !!! (x) [y] {z} a_b \\ ` ~", "a\x00b", "word" * 500, "é" * 100 + "...", "ña 가 ﬁ"]


def test_ids_are_the_tokenizers(tokenizer):
    """Word by word as the whole text at once, over given and odd texts."""
    words = packing.word_encoder(None)
    rng = random.Random(0)
    alphabet = "abZéÉß \t\n.,'!<|>01́ 中-_ſK"
    texts = [t or "" for t in table(SMALL, "documents").text[:300]] + ODD + [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(t.encode()), "<u4").tolist() == want, t


def test_packing_covers_every_id(spark, tokenizer):
    docs = table(SMALL, "documents")
    got = QUERIES["op11_sum_of_squares_packing"](spark, SMALL).toPandas()
    pieces = defaultdict(list)
    for r in got.itertuples():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(docs.doc_id)
    for r in docs.itertuples():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    sizes = []
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum().shift(fill_value=0)).all()
        sizes.append(own.length.sum())
    # Nothing is padded: windows are full, or have a power of two.
    assert all(n == 2048 or (n < 2048 and n & n - 1 == 0) for n in sizes)
    assert sum(n < 2048 for n in sizes) <= 11 * 8 and len(got) < 1.5 * len(docs)


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(1)
    packer, size = packing.Packer(40, most_open=10 ** 9), 40
    for _ in range(2000):
        n = rng.randint(1, 39)
        counts = packer.counts.copy()

        def squares(at):
            after = counts.copy()
            if at:
                after[at] -= 1
            if at + n < size:
                after[at + n] += 1
            return int((after ** 2).sum())

        allowed = [at for at in range(size - n + 1) if at == 0 or counts[at]]
        at = packer.level(n)
        assert at in allowed and squares(at) == min(map(squares, allowed))
        list(packer.add((0,), bytes(4 * n)))


@pytest.mark.parametrize("tail, most_open", [("split", 4096), ("pad", 4096), ("split", 3)])
def test_packer_keeps_all_ids(tail, most_open):
    rng = random.Random(2)
    packer, windows, sizes = packing.Packer(64, most_open, tail), [], []
    for i in range(500):
        sizes.append(rng.choice([1, 7, 63, 64, 65, 200, rng.randint(1, 64)]))
        windows += packer.add((i,), np.arange(sizes[-1], dtype="<u4").tobytes())
        assert packer.counts.sum() <= most_open
    windows += packer.close()
    back = defaultdict(dict)
    for w in windows:
        assert 0 < sum(map(len, w)) <= 64
        for p in w:
            back[p.row[0]][p.start] = p.ids
    for i, n in enumerate(sizes):
        assert b"".join(back[i][s] for s in sorted(back[i])) == np.arange(n, dtype="<u4").tobytes()
    short = [n for n in (sum(map(len, w)) for w in windows) if n < 64]
    assert all(n & n - 1 == 0 for n in short) if tail == "split" else len(short) == 1


ROWS = [(1, "the cat sat", "en", "a"), (1, "the cat sat", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "the dog", "en", "a"),
        (4, "word " * 50_000 + "cat", "en", "b"), (5, " \n", "de", "c"), (6, "THE Cat-cat café x1", "de", None), (7, "the dog", "en", "a")]


def test_packing_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, DOC).withColumns({"start": F.lit("mine"), "own_text": F.lit(0)}).coalesce(1)
    out = packing.pack(docs, capacity=16, keep=["doc_id", "own_text", "start"]).collect()
    tokens = defaultdict(int)
    for r in out:
        assert len(r.ids) == 4 * r.length
        tokens[r.doc_id] += r.length
    assert tokens == {1: 8, 2: 1, 3: 1, None: 3, 4: 50_002, 5: 1, 6: 8, 7: 3}
    assert packing.pack(docs.limit(0)).count() == 0
    again = packing.pack(docs, capacity=16, keep=["doc_id", "own_text", "start"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def brute_ranking(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = [(key, Counter(term.findall((t or "").translate(low)))) for key, t in docs]
    counts = [(key, c) for key, c in counts if c]
    n, words = len(counts), sum(c.total() for _, c in counts)
    out = []
    for item, t in items:
        scores = []
        for key, c in counts:
            score = 0
            for w in set(term.findall((t or "").translate(low))):
                if c[w]:
                    df = sum(w in other for _, other in counts)
                    m = 100 - 90 + 90 * c.total() * n // words
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, i + 1, None if s[1] else s[2], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, dict(doc_tile=2, item_tile=1, product=2, block_items=2), dict(doc_tile=3, item_tile=2, block_terms=1)])
def test_ranking_against_brute_force(spark, sizes):
    items = [(1, "cat dog cat"), (2, None), (3, "word"), (4, "the"), (4, "the"), (None, "CAFÉ café x1 none"), (5, "nothing here"), (6, "the cat sat dog word x1")]
    docs = ROWS + [(i, f"the cat{i % 3} dog", "en", "a") for i in range(20, 60)]
    rows = spark.createDataFrame(docs, DOC).withColumns({"k": F.lit("mine"), "terms": F.lit(1)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("t", F.lit(0))
    got = lexical.rank(rows, asked, k=4, **sizes).collect()
    assert sorted(map(tuple, got), key=str) == brute_ranking([r[:2] for r in docs], items, 4)
    assert lexical.rank(rows.limit(0), asked).count() == 0 and lexical.rank(rows, asked.limit(0)).count() == 0
    names = lexical.rank(rows.withColumn("doc_id", F.col("doc_id").cast("string")), asked.withColumn("item_id", F.lit("a")), k=4)
    assert names.count() == len(got) and dict(names.dtypes)["doc_id"] == "string"


def test_products_stay_exact():
    """A product has no more terms than its sums can hold below 2^53; sums of products are whole numbers."""
    rng = np.random.default_rng(3)
    tfs, ms = rng.integers(1, 10 ** 9, 5000), rng.integers(10, 10 ** 6, 5000)
    assert lexical.impacts(tfs, ms, np.ones(5000, np.int64)).max() < lexical.MOST_TF
    items = [np.arange(5000), np.arange(0, 5000, 7)]
    (first, products), = lexical.item_tiles(items, 5000, 256, 1000)
    assert first == 0 and len(products) == 5
    weights = rng.integers(0, 30_000 * lexical.MOST_TF // 1000, 5000)
    total = sum((weights[number >= 0].astype(float) @ ones).astype(np.int64) for number, ones in products)
    assert total.tolist() == [sum(weights.tolist()), sum(weights[::7].tolist())]


def brute_audit(docs, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in docs:
        own = term.findall((t or "").translate(low))
        df[lang or ""].update(set(own))
        groups[lang or "", source or ""].update(own)
    out = []
    for lang in df:
        kept = {w for w, n in df[lang].items() if n >= least}
        own = {s: {w: c[w] for w in kept} for (at, s), c in groups.items() if at == lang}
        own[None] = {w: sum(c[w] for c in own.values()) for w in kept}
        p = {s: {w: 1 + 10 ** 9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for w, n in c.items()} for s, c in own.items()}
        for s in own:
            if s is None:
                continue
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in own if o not in (s, None)]
            terms = [(p[None][w] - p[s][w], w) for w in kept if own[s][w] and p[s][w] > p[None][w]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, w) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, dict(block=2, slice_rows=3), dict(block=1, slice_rows=1, top=2)])
def test_audit_against_brute_force(spark, sizes):
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["café", "中"]
    docs = ROWS + [(i, " ".join(rng.choices(words[i % 5:], k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "d", "e", None]))
                   for i in range(20, 140)]
    rows = spark.createDataFrame(docs, DOC).withColumns({"term": F.lit("mine"), "n": F.lit(1), "p": F.lit(1)}).repartition(3)
    got = divergence.audit(rows, least=3, **sizes).collect()
    assert sorted(map(tuple, got)) == brute_audit(docs, 3, sizes.get("top", 50))
    assert divergence.audit(rows.limit(0)).count() == 0
    none = divergence.audit(rows, least=10 ** 6).collect()
    assert none and {(r.part, r.value) for r in none} == {("pair", 0)}


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_source_divergence"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rows = QUERIES[name](spark, SMALL)
    want = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_long_texts_in_bits():
    from shapelens.llm.common import word_lists
    raw = b"Ab c" * 1000 + b" " + b"x" * 5000 + b" end"
    for most in (1, 10, 4096, 1 << 20):
        assert [w for part in word_lists(raw, lexical.TERMS, most) for w in part] == raw.lower().split()

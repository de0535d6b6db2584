"""Ranked search against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from flowledger.llm import lexical, queries
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    """Scores of all documents, one by one."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_terms_are_maximal_matches():
    text = "It's Über-GROSS, naïve_x9 漢字\x7f\x85ÀB \x00z \U0001f600"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "DOCUMENTS", 16)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(5000)]
    docs = [(i // 2, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(400)]
    items = [(q, " ".join(rng.choices(words, k=rng.randint(0, 15)))) for q in range(40)] + [(3, "w1 w2"), (None, "w3"), (50, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(rows(lexical.rank(d, i)), key=key) == sorted(plain(docs, items), key=key)


def test_blocks_skip_but_lose_nothing():
    rng = np.random.default_rng(4)
    both = np.array([[0, 1], [2, 3], [4, 4]])
    for _ in range(300):
        n = int(rng.integers(1, 40))
        terms_ = [np.sort(rng.choice(5, rng.integers(1, 6), replace=False)).astype(np.int32) for _ in range(n)]
        tfs = [rng.integers(1, 9, len(t)).astype(np.int32) for t in terms_]
        ns = [int(x.sum() + rng.integers(0, 50)) for x in tfs]
        weights = rng.integers(0, 5000, 5)
        row = lexical._block(list(range(n)), ns, terms_, tfs, weights, both, n, sum(ns))
        block = lexical.Block(row, 5, 3)
        want = [sum(int(weights[t]) * (10**9 * int(f) // (1000 * int(f) + 8 * (10 + 90 * m * n // sum(ns)))) for t, f in zip(ts, fs, strict=True)) for ts, fs, m in zip(terms_, tfs, ns, strict=True)]
        bar = int(rng.choice(want)) or 1
        places, scores = block.search(np.arange(3), both, bar)
        assert dict(zip(places.tolist(), scores.tolist(), strict=True)) == {k: s for k, s in enumerate(want) if s >= bar}


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 2)
    docs = [(1, "a b"), (2, "b c"), (3, "c d"), (4, "x y")]
    items = [(k, t) for k, t in enumerate(["a", "b c", "d", "", "c"])]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(rows(got)) == sorted(plain(docs, items))


def test_odd_rows(spark):
    items = [(1, "word same text"), (2, "É漢字 é"), (3, " \n"), (4, None), (5, "A B six two"), (6, "it x endoftext")]
    odd = [(r["doc_id"], r["text"]) for r in cases.odd(spark).collect()]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(rows(lexical.rank(cases.odd(spark), i)), key=key) == sorted(plain(odd, items), key=key)
    assert lexical.rank(cases.empty(spark), i).count() == 0
    assert lexical.rank(cases.odd(spark), i.where("false")).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(rows(queries.op12_lexical(spark, sf))) == sorted(con.execute(queries.OP12).fetchall())

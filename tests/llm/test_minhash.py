import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from flowledger.llm import minhash
from tests.llm import cases


def plain(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def kept(rows, least=0.8):
    """Ids that stay, by comparing all pairs. rows: (id, text), ids not null."""
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(k, low.get(find(i), k))
    return sorted(low.values())


def test_stage_finds_near_copies(spark, monkeypatch):
    """Copies with single words replaced, most of them more than four bits of a fingerprint away."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        near, far = list(w), list(w)
        for at in rng.sample(range(300), 4):
            near[at] = f"n{rng.randrange(5000)}"
        for at in range(0, 300, 20):
            far[at] = "other"
        texts += [" ".join(w), " ".join(near), " ".join(far)]
    rows = list(enumerate(texts))
    want = kept(rows)
    assert len(want) == 80
    for limit in (8192, 1):
        monkeypatch.setattr(minhash, "HOMES", limit)
        got = corpus_pipeline.near_duplicates(spark, cases.documents(spark, texts), "")
        assert sorted(r["doc_id"] for r in got.collect()) == want


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect()) == kept(rows)


def test_odd_rows(spark):
    docs = cases.odd(spark)
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == [1, 4, 5, 6, 8, 9, 10]
    assert got.where("doc_id is null").count() == 1
    assert minhash.near_duplicates(docs).count() == docs.count() and minhash.one_of_each(cases.empty(spark)).count() == 0


def test_spanning_takes_the_closest():
    a, b, n = np.array([1, 2, 1, 4]), np.array([2, 3, 3, 5]), np.array([90, 70, 80, 100])
    assert sorted(minhash.spanning(a, b, n).tolist()) == [0, 2, 3]


def test_pairs_that_fail_hide_no_link(spark):
    """Texts around a similarity of 0.8, many of them under one key, so that forests are full of pairs that fail."""
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(25):
            w = list(base)
            for at in rng.sample(range(400), rng.randint(4, 11)):
                w[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = minhash.one_of_each(cases.documents(spark, texts))
    assert sorted(r["doc_id"] for r in got.collect()) == kept(rows)


def test_forests_go_on():
    a, b, n = np.array([1, 2, 1, 4]), np.array([2, 3, 3, 5]), np.array([90, 70, 80, 100])
    assert sorted(minhash.forests(a, b, n, 1).tolist()) == [0, 2, 3]
    assert sorted(minhash.forests(a, b, n, 9).tolist()) == [0, 1, 2, 3]


def test_simhash_comes_first(spark, monkeypatch):
    """Near copies within four bits are linked by SimHash alone; fingerprints that agree without similar texts are not."""
    rng = random.Random(7)
    texts = []
    for _ in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        texts += [" ".join(w), " ".join([*w[:-1], "end"])]
    rows = list(enumerate(texts))
    codes = [minhash.simhash.fingerprint(t, 5) for t in texts]
    near = sum((codes[i] ^ codes[i + 1]).bit_count() <= 4 for i in range(0, 40, 2))
    assert near > 10
    real, left = minhash.candidates, []
    monkeypatch.setattr(minhash, "candidates", lambda *a: left.append(real(*a)) or left[-1])
    assert sorted(r["doc_id"] for r in minhash.one_of_each(cases.documents(spark, texts)).collect()) == kept(rows)
    assert left[0].count() == 20 - near  # the bands are left with what lies farther apart
    both = lambda first: first.select(F.col("fp").alias("u")).join(first.select(F.col("fp").alias("v")), F.col("u") > F.col("v"))
    monkeypatch.setattr(minhash, "_close", both)  # fingerprints that agree, though most texts don't
    assert sorted(r["doc_id"] for r in minhash.one_of_each(cases.documents(spark, texts[:8])).collect()) == [0, 2, 4, 6]


def test_rounds_leave_settled_texts_alone(spark, monkeypatch):
    """Pairs fail in a few groups among many other texts: only the first round looks at all of them."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(150)]
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(12):
            w = list(base)
            for at in rng.sample(range(400), rng.randint(6, 11)):
                w[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    real, wrote = minhash.keep, []
    monkeypatch.setattr(minhash, "keep", lambda df, name: wrote.append((name, real(df, name))) or wrote[-1][1])
    got = minhash.one_of_each(cases.documents(spark, texts))
    assert sorted(r["doc_id"] for r in got.collect()) == kept(list(enumerate(texts)))
    looked = [df.count() for name, df in wrote if name in ("labels", "active")]
    assert len(looked) > 1 and looked[0] == len(texts) and max(looked[1:]) <= 48


def test_similarities():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 40, 60, 60, 90)]
    for a in sets:
        assert minhash.similarities(a, sets).tolist() == [minhash.similarity(a, b) for b in sets]


def test_failed_pairs_of_a_large_group_make_no_rows(spark, monkeypatch):
    """Of a group in which nearly every pair is a candidate and fails, no more pairs are written than a forest a task has."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for i in range(72):
        near = i and i % 6 == 0  # every sixth is close to the one before
        w = texts[-1].split() if near else list(base)
        for at in rng.sample(range(400), 2 if near else 7):
            w[at] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    want = kept(list(enumerate(texts)))
    assert len(want) == 60
    real, wrote = minhash.keep, []
    monkeypatch.setattr(minhash, "keep", lambda df, name: wrote.append((name, real(df, name))) or wrote[-1][1])
    for homes, held in ((8192, 32 << 20), (8192, 10_000), (7, 32 << 20)):
        monkeypatch.setattr(minhash, "HOMES", homes)
        monkeypatch.setattr(minhash, "HELD", held, raising=False)
        wrote.clear()
        got = minhash.one_of_each(cases.documents(spark, texts))
        assert sorted(r["doc_id"] for r in got.collect()) == want
        assert sum(df.count() for name, df in wrote if name == "checked") <= len(texts) * 9  # 8 tasks, and SimHash's own

import zlib
from collections import Counter

import numpy as np

from flowledger.llm import sharding
from tests.llm import cases


def check(docs, shards):
    rows = docs.select("doc_id", "text").collect()
    got = sharding.shuffle(docs, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    counts = Counter(r["shard"] for r in got)
    assert all(counts[s] in (len(rows) // shards, -(-len(rows) // shards)) for s in range(shards)) and sum(counts.values()) == len(rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(shards) for k in range(counts[s])]
    return {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_exact_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = check(docs, 40)
    assert a == check(docs.repartition(5), 40)  # not a matter of partitions
    ids = np.array(sorted(a))
    assert abs(np.corrcoef(ids, [a[i][0] for i in ids])[0, 1]) < 0.25


def test_odd_rows(spark):
    check(cases.odd(spark), 3)
    assert sharding.shuffle(cases.empty(spark)).count() == 0


def test_matrix_is_hypergeometric():
    before = np.concatenate([[0], np.cumsum([5, 0, 30, 65])])
    cells = []
    for seed in range(3000):
        m = np.array([sharding.matrix_row(b, before, 3, seed) for b in range(4)])
        assert m.sum(0).tolist() == sharding.sizes(100, 3).tolist() and m.sum(1).tolist() == [5, 0, 30, 65]
        cells.append(m)
    m = np.array(cells)
    want = 30 * 34 / 100
    assert abs(m[:, 2, 0].mean() - want) < 0.15 and abs(m[:, 2, 0].var() - want * 0.66 * 70 / 99) < 0.6


def test_large_populations():
    rng = np.random.default_rng(1)
    x = np.array([sharding._one(rng, 40, 60, 25) for _ in range(20000)])
    y = rng.hypergeometric(40, 60, 25, 20000)
    assert abs(x.mean() - y.mean()) < 0.08 and abs(x.var() - y.var()) < 0.2
    big = sharding._drawn(rng, sharding.sizes(7 * 10**9, 40), 10**9)
    assert big.sum() == 10**9 and abs(big - 10**9 / 40).max() < 10 * (10**9 / 40) ** 0.5

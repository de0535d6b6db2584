import numpy as np

from flowledger.llm import ann, blocks, topk

PATH = "/root/testdata/sf0.001/embeddings.parquet"


def plain(rows, every, k, score, zero):
    """(query, rank, id, score) by reading everything; the unit is the row."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for a, (q, v) in enumerate(ok):
        if q % every == 0:
            best = sorted(((-score(v, w), i) for b, (i, w) in enumerate(ok) if a != b and len(v) == len(w)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def long(x):
    return max(-(2**63), min(2**63 - 1, x))


def whole(v, w):
    return sum(long(int(np.floor(256 * np.float64(a)))) * long(int(np.floor(256 * np.float64(b)))) for a, b in zip(v, w, strict=True))


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def odd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(7, rows[7][1])] * 3  # many equal vectors, repeated rows
    rows += [(200, None), (None, rows[1][1]), (201, []), (202, [float("nan")] * 5), (203, [1.0, None, 1.0, 1.0, 1.0]), (220, [0.0] * 5), (221, [float("inf")] + [1.0] * 4), (240, [1.0, 2.0]), (245, [2.0, -2.0]), (241, [0.5, 2.0]), (15, [3.0] * 5), (250, [2.0**70] * 5), (251, [-(2.0**80), 1.0, 2.0, 3.0, 4.0])]
    return rows, spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, v string, block int")


def test_topk_is_exact(spark, monkeypatch):
    rows, df = odd(spark)
    want = plain(rows, 5, 5, whole, True)
    assert got(topk.top(df, 5, 5)) == [(*x[:3], long(x[3])) for x in want]
    monkeypatch.setattr(blocks, "ROWS", 20)
    monkeypatch.setattr(blocks, "QUERIES", 4)
    assert got(topk.top(df, 5, 5)) == [(*x[:3], long(x[3])) for x in want]
    table = spark.read.parquet(PATH)
    assert got(topk.top(table)) == plain([(r["vec_id"], r["embedding"]) for r in table.collect()], 50, 5, whole, True)
    assert topk.top(df.limit(0)).count() == 0
    assert got(topk.top(df.where("vec_id = 5"), 5, 5)) == []


def test_ann_recall_and_odd_rows(spark, monkeypatch):
    rows, df = odd(spark)
    dot = lambda v, w: float(np.dot(np.float64(v), np.float64(w)))
    want = plain(rows, 5, 20, dot, False)
    found = got(ann.nearest(df, 20, 5, margin=8.0))  # so wide a margin rereads all: equal to brute force, ties and all
    assert [x[:3] for x in found] == [x[:3] for x in want] and np.allclose([x[3] for x in found], [x[3] for x in want], atol=1e-12)
    monkeypatch.setattr(blocks, "ROWS", 100)
    table = spark.read.parquet(PATH)
    want = plain([(r["vec_id"], r["embedding"]) for r in table.collect()], 20, 20, dot, False)
    found = got(ann.nearest(table))
    assert len(found) == len(want) and len({x[::2] for x in found} & {x[::2] for x in want}) >= 0.9 * len(want)
    exact = {(r["vec_id"]): np.float64(r["embedding"]) for r in table.collect()}
    assert all(abs(s - exact[q] @ exact[i]) < 1e-12 and q != i for q, _, i, s in found)
    assert ann.nearest(df.limit(0)).count() == 0


def test_estimates_are_unbiased_within_their_spread():
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(3000, 96)), rng.normal(size=(20, 96))
    mean, turn = v.mean(0), ann.rotation(96)
    packed, scalars = ann.codes(v, mean, turn)
    guess, spread = ann.estimates(packed, scalars, q, mean, turn)
    z = (guess - q @ v.T) / spread
    assert abs(z.mean()) < 0.05 and 0.85 < z.std() < 1.15

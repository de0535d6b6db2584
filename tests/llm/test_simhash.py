import random

import numpy as np
import xxhash

from flowledger.llm import components, simhash
from tests.llm import cases

DOCS = "/root/testdata/sf0.001/documents.parquet"


def plain(text):
    w = [x for x in "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=4):
    """(id, fingerprint) -> component id, by comparing all pairs."""
    fp = sorted({f for _, f in rows})
    root = {f: f for f in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fp):
        for b in fp[:i]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f, least.get(find(f))) for i, f in rows), key=str)


def test_fingerprint_and_components(spark):
    docs = spark.read.parquet(DOCS)
    rows = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=str) == brute(rows)


def test_odd_rows(spark):
    docs = cases.odd(spark)
    rows = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=str) == brute(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({(c or 0, f) and c for _, f, c in brute(rows)})
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_every_link_is_found(spark, monkeypatch):
    """Random codes with neighbours at 0 to 6 bits, with and without hot anchors."""
    rng = random.Random(1)
    fps = set()
    for _ in range(300):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(1, 7)}
    hot = rng.getrandbits(64)
    fps |= {hot ^ sum(1 << b for b in rng.sample(range(12), 3)) for _ in range(200)}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    want = {(f, c) for _, f, c in brute([(f, f) for f in fps])}
    for limit in (8192, 20):
        monkeypatch.setattr(simhash, "HOMES", limit)
        roots = {r["u"]: r["root"] for r in components.components(simhash.links(df)).collect()}
        groups, expected = {}, {}
        for f, c in want:
            s = int(np.uint64(f).astype(np.int64))
            groups.setdefault(roots.get(s, s), set()).add(f)
            expected.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_anchors_cover():
    fp = np.array([random.Random(i).getrandbits(64) for i in range(200)], np.uint64)
    key, row, home = simhash.anchors(fp)
    at = [set(key[row == i].tolist()) for i in range(len(fp))]
    own = simhash.homes(fp)
    for i in range(len(fp)):
        assert set(key[(row == i) & home].tolist()) == set(own[i].tolist()) and len(own[i]) == 3
        for k, (low, width) in enumerate(simhash.BLOCKS):  # any neighbour at one bit of the block reaches this one's home
            for b in range(width):
                near, _, _ = simhash.anchors(fp[i : i + 1] ^ np.uint64(1 << (low + b)))
                assert int(own[i][k]) in near
        assert len(at[i]) == (row == i).sum()


def test_components_end_with_stars(spark, monkeypatch):
    """Links that are stars need no round; others, with hubs and without, end as soon as they are stars."""
    real, wrote = components.keep, []
    monkeypatch.setattr(components, "keep", lambda df, name: wrote.append(name) or real(df, name))
    of = lambda pairs: {r["u"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert of([(k, 0) for k in range(1, 400)] + [(1001, 1000), (1000, 1001), (7, 7)]) == dict.fromkeys(range(1, 400), 0) | {1001: 1000}
    assert len(wrote) == 1
    assert of([(k, k - 1) for k in range(1, 20)] + [(30, 29), (31, 29)]) == dict.fromkeys(range(1, 20), 0) | {30: 29, 31: 29}
    assert of([(k, 500) for k in range(2, 400)] + [(600, 500), (600, 1)]) == dict.fromkeys([*range(2, 400), 500, 600], 1)

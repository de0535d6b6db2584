import math
import random
from zlib import crc32

import numpy as np

from flowledger.llm import langid, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_mixtures():
    """Proportions of two planted languages are found, and single ones stay single."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(3000, 0.05), 3).T.astype(np.float32) + 1e-7
    p = np.vstack([p, np.zeros((langid.BUCKETS - 3000, 3), np.float32) + 1e-9])
    p /= p.sum(0)
    docs, want = [], []
    for k in range(30):
        share = np.array([1.0, 0, 0]) if k % 2 else np.array([0.3, 0, 0.7])
        q = (p.astype(np.float64) @ share)
        n = rng.multinomial(2000, q / q.sum())
        docs.append((np.flatnonzero(n), n[np.flatnonzero(n)]))
        want.append(share)
    got = langid.mixtures(p, [d[0] for d in docs], [d[1] for d in docs])
    assert np.abs(got - np.array(want)).max() < 0.05 and all((g > 0).sum() == (w > 0).sum() for g, w in zip(got, want, strict=True))


def test_language_odd_rows(spark):
    docs = cases.odd(spark)
    got = langid.identify(docs.unionByName(cases.documents(spark, ["english words here"] * 4, 50))).collect()
    assert len(got) == 17 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["text"] is None or not any(map(str.isalpha, r["text"])))
    assert all(r["lang_pred"] in ("en", "und") for r in got)
    none = langid.identify(docs)  # nothing to learn from
    assert none.count() == 13 and none.where("lang_pred <> 'und'").count() == 0
    assert langid.identify(cases.empty(spark)).count() == 0


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 400))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorgblat", "quixnarf", "wumplezk"]) + rng.choice(["", "s", "ed", "ing"])
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_held_out_and_misspelt(spark):
    rng = random.Random(2)
    texts, labels = corpus(rng, 900)
    docs = cases.documents(spark, texts)
    lab = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, lab).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"]]
    assert np.mean([p for p, y in held if y]) > 0.6 and np.mean([p for p, y in held if not y]) < 0.03
    value, bias = toxicity.train(texts, np.array(labels))
    clean = next(t for t, y in zip(texts, labels, strict=True) if not y)
    s = toxicity.Scorer(value, bias).score([clean, clean + " zorrgblat zorgblatt quiixnarf"])  # never seen like this
    assert s[0] < 0.3 < s[1]


def test_toxicity_odd_rows(spark):
    docs = cases.odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for lab in (none, spark.createDataFrame([(5, 1, 1), (5, 1, 1), (None, 1, 1), (6, 1, None), (7, 0, 3)], none.schema), spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, 1, 0), (8, 1, 0), (9, 1, 1)], none.schema)):
        rows = toxicity.score(docs, lab).collect()
        assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(cases.empty(spark), none).count() == 0


def plain_mixture(p, buckets, counts, penalty):
    """The same inference for one document, number by number."""
    n, langs = counts.sum(), range(p.shape[1])
    rows = [(float(c), [float(x) for x in p[b]]) for b, c in zip(buckets, counts, strict=True)]
    likely = [sum(c * math.log(q[j]) for c, q in rows) for j in langs]
    best = max(langs, key=lambda j: likely[j])
    share, now = [float(j == best) for j in langs], likely[best]
    while min(share) == 0:
        mix = [sum(s * x for s, x in zip(share, q, strict=True)) for _, q in rows]
        gain = [sum(c * q[j] / m for (c, q), m in zip(rows, mix, strict=True)) if not share[j] else -math.inf for j in langs]
        add = max(langs, key=lambda j: gain[j])
        s = [0.9 * x + 0.1 * (j == add) for j, x in enumerate(share)]
        for _ in range(langid.STEPS):
            part = [[a * b for a, b in zip(s, q, strict=True)] for _, q in rows]
            s = [sum(c * r[j] / sum(r) for (c, _), r in zip(rows, part, strict=True)) / n for j in langs]
        new = sum(c * math.log(sum(a * b for a, b in zip(s, q, strict=True))) for c, q in rows)
        if new - now <= penalty * math.log(n + 1):
            break
        share, now = s, new
    return share


def test_mixtures_against_plain_inference():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.full(500, 0.1), 4).T.astype(np.float32) + np.float32(1e-6)
    docs = []
    for k in range(40):
        q = p.astype(np.float64) @ rng.dirichlet(np.full(4, 0.4))
        n = rng.multinomial([3, 30, 800][k % 3], q / q.sum())
        docs.append((np.flatnonzero(n), n[np.flatnonzero(n)]))
    got = langid.mixtures(p, [d[0] for d in docs], [d[1] for d in docs])
    want = np.array([plain_mixture(p, b, c, langid.PENALTY) for b, c in docs])
    assert np.abs(got - want).max() < 1e-6 and {(w > 0).sum() for w in want} >= {1, 2}


def plain_score(text, value, bias):
    """A text's score word by word and n-gram by n-gram."""
    mask, worth = 2**64 - 1, []
    for w in (text or "").lower().encode().split():
        b = b"<" + w + b">"
        hashes = []
        for n in toxicity.GRAMS:
            for i in range(len(b) - n + 1):
                h = 0xCBF29CE484222325
                for x in b[i : i + n]:
                    h = h * 0x100000001B3 & mask ^ x
                hashes.append(h)
        hashes.append(sum((x + 1) * 31**k for k, x in enumerate(b)) * 0x100000001B3 & mask)
        buckets = [(h * 0x9E3779B97F4A7C15 & mask) >> 40 for h in hashes]
        worth.append(sum(float(value[x % toxicity.BUCKETS]) for x in buckets) / len(buckets))
    starts = [k for k in range(0, max(1, len(worth)), 16) if k == 0 or len(worth) - k > 8]
    spans = [worth[a:b] for a, b in zip(starts, [*starts[1:], len(worth)], strict=True)]
    return 1 / (1 + math.exp(-(bias + max(sum(s) / max(1, len(s)) for s in spans))))


def test_toxicity_scores_against_plain_sums():
    rng = random.Random(9)
    value = np.random.default_rng(3).normal(size=toxicity.BUCKETS).astype(np.float32)
    texts = [None, "", " \n", "a", "é ü 漢字", *(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (5, 15, 16, 17, 24, 25, 31, 33, 200))]
    got = toxicity.Scorer(value, -0.3).score(texts)
    assert np.abs(got - [plain_score(t, value, -0.3) for t in texts]).max() < 1e-6


def test_learning_is_bounded_in_bytes(spark, monkeypatch):
    """The sample stays within its bytes, and a text beyond them is scored though not learned from."""
    monkeypatch.setattr(toxicity, "BYTES", 3000)
    texts = ["bad words here", "good words there"] * 40 + ["bad " * 5000]
    docs = cases.documents(spark, texts)
    lab = spark.createDataFrame([(i, 1, int(t.startswith("bad"))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda x, y, *a: seen.append(sum(len(t) for t in x)) or train(x, y, *a))
    rows = toxicity.score(docs, lab).collect()
    assert len(rows) == 81 and 0 < seen[0] <= 3000 and all(r["score"] > 0.5 for r in rows if r["text"].startswith("bad"))

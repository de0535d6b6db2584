"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from flowledger.llm import collocations, queries
from tests.llm import cases


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split("[.,;:!?\n-\r]", lower) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain(docs, least, top, share=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, own in f.items():
        rows = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items() if b >= least):
                continue
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def docs(spark, texts):
    return spark.createDataFrame(texts, "text string, lang string")


@pytest.mark.parametrize(("seed", "shards", "together"), [(1, 2, 50), (2, 3, 10**6)])
def test_against_all_counts(spark, monkeypatch, seed, shards, together):
    monkeypatch.setattr(collocations, "TOGETHER", together)
    rng = random.Random(seed)
    words = ["Alpha", "beta", "x", "É", "漢字", "don't", "a-b", "y" * 90]
    texts = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(120)]
    texts += [("one two three four five", "en")] * 9
    assert rows(collocations.collocations(docs(spark, texts), 6, 12, shards=shards)) == plain(texts, 6, 12)


def test_slots_in_common_change_nothing(spark, monkeypatch):
    real = collocations._told
    monkeypatch.setattr(collocations, "_told", lambda *a: ((t := real(*a))[0] | 31, t[1]))  # every phrase seems to be in every state
    rng = random.Random(5)
    texts = [(" ".join(rng.choices("abcdefgh", k=30)), "en") for _ in range(60)]
    assert rows(collocations.collocations(docs(spark, texts), 5, 100)) == plain(texts, 5, 100)


def test_words_and_hashes():
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB c\t.,\n;é\x00") for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["z" * 300_000 + " q", "", "Q"]
    w, piece, text, starts, ends, raw = collocations.words([t.encode() for t in texts], ["en"] * 51 + ["de", "en"])
    want = [(k, j, x) for k, t in enumerate(texts) for j, ws in enumerate(pieces(t)) for x in ws]
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [x for _, _, x in want]
    assert text.tolist() == [k for k, _, _ in want]
    assert len(np.unique(piece)) == len({(k, j) for k, j, _ in want})
    known = {}
    for h, k, x in zip(w.tolist(), text.tolist(), want, strict=True):
        assert known.setdefault((x[2], k == 51), h) == h
    assert len(set(known.values())) == len(known)


def test_odd_rows(spark):
    odd = [(r["text"], r["lang"]) for r in cases.odd(spark).collect()]
    assert rows(collocations.collocations(cases.odd(spark), 2)) == plain(odd, 2, 2000)
    assert collocations.collocations(cases.empty(spark)).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.OP13).fetchall()
    assert len(want) > 100
    assert rows(queries.op13_collocations(spark, sf)) == sorted(want)

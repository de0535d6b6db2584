import random
import re
from itertools import pairwise
from zlib import crc32

from flowledger.llm import spans
from tests.llm import cases

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def clauses(text):
    """(words, ends) by the rules of the docstring, word by word: stops, lines, and in any 8 words the least pair hash."""
    words, ends = [], set()
    for line in text.encode().lower().split(b"\n"):
        for w in WORD.findall(line):
            words.append(w)
            if w[-1:] in (b".", b"!", b"?"):
                ends.add(len(words))
        if words:
            ends.add(len(words))
    h = [crc32(w) for w in words]
    h = [h[0], *(b ^ a * 0x9E3779B97F4A7C15 for a, b in pairwise(h))] if h else []
    h = [x * 0xD6E8FEB86659FD93 % 2**64 for x in h]
    h = [x ^ x >> 32 for x in h]
    for k in range(len(words) - 7):
        ends.add(1 + max(i for i in range(k, k + 8) if h[i] == min(h[k : k + 8])))
    return words, sorted(ends)


def plain_runs(text):
    """(words of the run, first, end) from each clause on, to be compared as words and not by hash."""
    words, ends = clauses(text)
    starts, out = [0, *ends], []
    for i in range(len(ends)):
        to = next((k for k in range(i + 3, len(ends) + 1) if starts[k] - starts[i] >= 20), None)
        if to:
            out.append((b" ".join(words[starts[i] : starts[to]]), starts[i], starts[to]))
    return out


def brute(rows):
    """Texts after removal, by holding all runs in one dictionary; what is left of a cut text is joined by blanks."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for x, _, _ in plain_runs(t or ""):
            first.setdefault(x, i)
    out = []
    for i, t in rows:
        dead, seen = set(), set()
        for x, a, b in plain_runs(t or ""):
            if first[x] != i or x in seen:
                dead.update(range(a, b))
            seen.add(x)
        out.append((i, t if not dead else b" ".join(w for k, w in enumerate(WORD.findall(t.encode())) if k not in dead).decode()))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = spans.dedup(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    tidy = lambda t: t and WORD.findall(t.encode())
    want = {i: (t, len(tidy(was)) - len(tidy(t)) if t else 0) for (i, t), (_, was) in zip(brute(rows), rows, strict=True)}
    assert any(n for _, n in want.values())
    for r in got.collect():
        t, n = want[r["doc_id"]]
        assert tidy(r["text"]) == tidy(t) and (not t or r["n_removed"] == n)
        assert n or r["text"] == t


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_planted_passages(spark):
    """Passages of 51 words and more are taken out of all documents but the first, wherever they begin."""
    rng = random.Random(4)
    passages = [words(rng, rng.randint(51, 120)) for _ in range(20)]
    texts, clean = [], []
    for i in range(60):
        a, b = words(rng, rng.randint(5, 60)), words(rng, rng.randint(5, 60))
        texts.append(f"{a} {passages[i % 20]} {b}")
        clean.append(words(rng, 100))
    docs = cases.documents(spark, texts + clean)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in spans.dedup(docs).collect()}
    for i in range(20):
        assert got[i] == (texts[i], 0)
    for i in range(20, 60):
        n = len(passages[i % 20].split())
        assert got[i][1] >= 0.5 * n and got[i][1] <= n, (i, n, got[i][1])
        assert set(got[i][0].split()) <= set(texts[i].split())
    assert all(got[60 + i] == (clean[i], 0) for i in range(60))


def test_odd_rows(spark):
    docs = cases.odd(spark)
    got = spans.dedup(docs)
    assert got.count() == docs.count()
    rows = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert [r for r in rows if r[0] == 6] == [(6, "same text here for all of you")] * 2  # too short for a run
    long = next(r["text"] for r in got.collect() if r["doc_id"] == 5)
    assert long and len(long) < len("one two three four five six " * 4000)  # repeats itself
    assert spans.dedup(cases.empty(spark)).count() == 0
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega. Next one here. And another."
    again = spans.dedup(cases.documents(spark, [text, text, None, text])).orderBy("doc_id").collect()
    assert [r["text"] for r in again][2] is None and again[0]["text"] == text and len(again[1]["text"]) < 30 and again[1]["text"] == again[3]["text"]


def test_every_passage_holds_a_run():
    """Any 51 words, without stops, with separators or looping, have a run at the same place in any surroundings."""
    rng = random.Random(6)
    for kind in range(4):
        for _ in range(400):
            w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(51)]
            if kind == 1:
                w[1::2] = ["|"] * 25
            if kind == 2:
                w = (w[: rng.randint(1, 20)] * 51)[:51]
            if kind == 3:
                w = [x + "." if rng.random() < 0.1 else x for x in w]
            around = [[rng.choice("klmnop") * rng.randint(1, 5) for _ in range(rng.randint(0, 30))] for _ in range(4)]
            first, second = (set(spans.runs(" ".join([*around[i], *w, *around[i + 1]]))[0]) for i in (0, 2))
            assert first & second, (kind, w)


def test_passages_with_separators(spark):
    rng = random.Random(8)
    passages = [" | ".join(words(rng, 1).replace(".", "") for _ in range(26)) for _ in range(30)]
    texts = [f"{words(rng, 20)} {p} {words(rng, 20)}" for _ in range(3) for p in passages]
    got = {r["doc_id"]: r["n_removed"] for r in spans.dedup(cases.documents(spark, texts)).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(20 <= got[i] <= 51 for i in range(30, 90))


def test_cut_keeps_the_rest():
    rng = random.Random(9)
    t = words(rng, 80)
    h, first, last = spans.runs(t)
    left, n = spans.cut(t, {2})
    w = t.split()
    assert left.split() == w[: first[2]] + w[last[2] :] and n == last[2] - first[2]

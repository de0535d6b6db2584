import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowledger.llm import packing
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, document by document."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return Counter(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for case in range(60):
        capacity = rng.choice([1, 7, 16, 50, 100])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else capacity // 3 + 1 for _ in range(rng.randint(0, 300))]
        runs = packing.plan(Counter(lengths), capacity)
        used, spans = Counter(), defaultdict(list)
        for length, _, ranks, first, each, offset in runs:
            for t in range(ranks):
                used[first + t // each] += length
                spans[first + t // each].append((offset + t % each * length, length))
        for s in spans.values():  # gapless from 0
            assert [a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))]
        assert Counter(capacity - u for u in used.values()) == one_by_one(lengths, capacity), case
        assert sum(r[2] for r in runs) == len(lengths)


def check(docs):
    base = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*base.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    got = packing.pack(docs, PATH).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in ends.values():
        assert [a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(ends) == sum(one_by_one([r["length"] for r in got], 2048).values())


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_rows(spark):
    check(cases.odd(spark))
    assert packing.pack(cases.empty(spark), PATH).count() == 0


def test_parts_by_white_space():
    base = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    letters = list("abCDéÉ'..,,!19 \n\t\x1c\x1f\x85\xa0  　İΣς漢ﬁĶ́") + ["'s", "it's", "word.", "the,"]
    texts = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Words(PATH).encode(texts)] == [base.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_tokens_count_as_the_tokenizer_counts_them(spark):
    """``hello <|endoftext|> you`` is three ids; in capitals the same characters are ordinary text."""
    rows = [(1, "hello <|endoftext|> you"), (2, "hello <|ENDOFTEXT|> you"), (3, "a<|startoftext|>b 漢<|endoftext|>" * 900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    assert {r["doc_id"]: r["length"] for r in got.collect() if r["doc_id"] < 3} == {1: 4, 2: 9}
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_rank_meets_only_the_runs_of_its_stretch():
    rng = random.Random(8)
    histogram = Counter(rng.choice([3, 5, 40, 64, 100]) for _ in range(5000)) + Counter({100: 30000})
    runs = packing.plan(histogram, 100)
    widths, touched = packing.stretches(histogram, runs)
    assert len(touched) <= 2 * len(runs) + len(histogram)
    found = defaultdict(list)
    for length, stretch, *run in touched:
        found[length, stretch].append(run)
    for length, width in widths:
        for rank in range(0, histogram[length], 7):
            hit = [r for r in found[length, rank // width] if r[0] <= rank < r[0] + r[1]]
            assert hit == [list(r[1:]) for r in runs if r[0] == length and r[1] <= rank < r[1] + r[2]]

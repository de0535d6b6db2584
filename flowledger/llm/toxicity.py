"""Toxicity by subword bags: embeddings of character n-grams, averaged, under a linear softmax, trained jointly.

A word is the average of the embeddings of its n-grams and of itself, so that an unseen misspelling shares most of its
vector with the word that it hides; a passage of SPAN words is the average of its words; a linear softmax over two classes
reads the passage. A few bad words in a long text would drown in the average over all of it, so a document's score is
that of its worst passage, in training too: after some steps on the document's average, the gradient goes through the
worst passage alone. Embeddings and softmax are learned together by gradient steps with momentum, whose largest step has a
fixed length, in numpy, on a bounded sample of labelled rows.
Scoring needs no more than one number for each n-gram, the product of its embedding with the softmax's weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import columns, fresh, lean

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
SPAN = 16
#: Labelled documents of either class that are learned from, about so many at most, chosen by hash.
TOXIC, OTHER = 1500, 3000
#: Bytes of text that are learned from at most.
BYTES = 64 << 20
STEPS, WARM, RATE, DECAY = 80, 15, 0.5, 1e-3
THRESHOLD = 0.7
#: Word forms whose score a worker remembers.
REMEMBERED = 250_000


def grams(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their number) of the n-grams of all words, word by word, each word itself first."""
    marked = [b"<" + x + b">" for x in forms]
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in marked])
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(b))
    prime = np.uint64(0x100000001B3)
    bucket, word = [], []
    owner = np.repeat(np.arange(len(marked)), size)
    h = np.full(len(b), 0xCBF29CE484222325, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(b) - n + 1] * prime ^ b[n - 1 :]
        if n in GRAMS:
            ok = at[: len(h)] + n <= end[: len(h)]
            bucket.append(h[ok])
            word.append(owner[: len(h)][ok])
    place = np.uint64(31) ** (at - (end - np.repeat(size, size))).astype(np.uint64)
    whole = np.add.reduceat((b + np.uint64(1)) * place, np.cumsum(size) - size) * prime if len(b) else np.empty(0, np.uint64)
    bucket.append(whole)
    word.append(np.arange(len(marked)))
    bucket, word = np.concatenate(bucket), np.concatenate(word)
    order = np.argsort(word, kind="stable")
    mixed = bucket[order] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (mixed % np.uint64(BUCKETS)).astype(np.int64), np.bincount(word, minlength=len(marked))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def spans(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words; a short rest belongs to the last whole one."""
    return np.arange(0, max(1, n - SPAN // 2), SPAN)


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) such that sigmoid(average + bias) is the probability of class 1 of a passage."""
    number: dict[bytes, int] = {}
    docs, y = [], []
    for text, label in zip(texts, labels, strict=True):
        w = words(text)
        if w:
            docs.append(np.array([number.setdefault(x, len(number)) for x in w], np.int32))
            y.append(float(label))
    y = np.array(y)
    if not docs or y.min() == y.max():  # nothing to tell apart
        mean = float(np.mean(labels)) if len(labels) else 0.5
        return np.zeros(BUCKETS), float(np.log((mean + 0.01) / (1.01 - mean)))
    forms = list(number)
    parts = [grams(forms[k : k + 10_000]) for k in range(0, len(forms), 10_000)]  # little at a time: the driver's memory is small
    bucket, size = np.concatenate([x[0].astype(np.int32) for x in parts]), np.concatenate([x[1] for x in parts])
    del number, parts
    begin = np.cumsum(size) - size
    token = np.concatenate(docs).astype(np.int32)
    length = np.array([len(d) for d in docs])
    start = np.concatenate([spans(n) + o for n, o in zip(length, np.cumsum(length) - length, strict=True)])
    width = np.diff(np.r_[start, len(token)])
    per = np.array([len(spans(n)) for n in length])
    first = np.cumsum(per) - per
    rng = np.random.default_rng(seed)
    e, w, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    moments = [np.zeros_like(x) for x in (e, w, bias)]
    peak = [0.0, 0.0, 0.0]  # one rate for a block: the largest step so far is RATE
    held_by = np.zeros(len(forms))
    for d in docs:
        held_by[np.unique(d)] += 1
    held_by = sum(np.bincount(bucket[begin[k] : begin[k] + size[k : k + 10_000].sum()], np.repeat(held_by[k : k + 10_000], size[k : k + 10_000]), minlength=BUCKETS) for k in range(0, len(forms), 10_000))
    # by chance an n-gram's gradient grows with the root of its documents: what many documents agree on moves most
    rate = np.where(held_by >= 2, 1 / np.sqrt(held_by + 1), 0)
    for step in range(1, STEPS + 1):
        way = w[:, 1] - w[:, 0]
        value = (e @ way).astype(np.float32)
        span = np.add.reduceat((np.add.reduceat(value[bucket], begin) / size)[token], start) / width
        if step <= WARM:
            pick, share = np.arange(len(start)), np.repeat(1 / per, per)
            logit = np.add.reduceat(span, first) / per
        else:
            top = np.maximum.reduceat(span, first)
            hit = np.flatnonzero(span == np.repeat(top, per))
            owner = np.repeat(np.arange(len(per)), per)[hit]
            _, one = np.unique(owner, return_index=True)
            pick, share, logit = hit[one], np.ones(len(per)), top
        p = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -50, 50)))
        g = weight * (p - y)  # by the difference of the logits
        each = np.repeat(g, per) * share if step <= WARM else g
        tokens = np.repeat(start[pick], width[pick]) + np.arange(width[pick].sum()) - np.repeat(np.cumsum(width[pick]) - width[pick], width[pick])
        by_word = np.bincount(token[tokens], np.repeat(each / width[pick], width[pick]), minlength=len(forms)) / size
        used, by_bucket = np.flatnonzero(by_word), np.zeros(BUCKETS)
        for k in range(0, len(used), 10_000):  # little at a time: the driver's memory is small
            u = used[k : k + 10_000]
            rows = np.repeat(begin[u] - np.cumsum(size[u]) + size[u], size[u]) + np.arange(size[u].sum())
            by_bucket += np.bincount(bucket[rows], np.repeat(by_word[u], size[u]), minlength=BUCKETS)
        down = by_bucket @ e
        grads = (np.outer(by_bucket * rate, way), np.stack([-down, down], 1), np.array([-g.sum(), g.sum()]))
        for k, (x, d, m) in enumerate(zip((e, w, bias), grads, moments, strict=True)):
            m *= 0.8
            m += d
            peak[k] = max(peak[k], np.abs(m).max(), 1e-12)
            x *= 1 - DECAY
            x -= RATE * m / peak[k]
    return e @ (w[:, 1] - w[:, 0]), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias, self.known = value, bias, {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        docs = [words(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({x for d in docs for x in d}.difference(self.known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            bucket, size = grams(part)
            self.known.update(zip(part, np.add.reduceat(self.value[bucket], np.cumsum(size) - size) / size, strict=True))
        out = np.full(len(docs), self.bias)
        for i, d in enumerate(docs):
            if d:
                s = spans(len(d))
                each = np.fromiter(map(self.known.__getitem__, d), np.float64, len(d))
                out[i] += (np.add.reduceat(each, s) / np.diff(np.r_[s, len(d)])).max()
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _scores(value: np.ndarray, bias: float, parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    scorer = Scorer(value, bias)
    for texts in parts:
        yield pd.Series(np.concatenate([scorer.score(list(texts.iloc[k : k + 256])) for k in range(0, len(texts), 256)] or [np.empty(0)]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, other: int = OTHER, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from ``threshold`` up).

    Learns from labelled rows (``labels``: doc_id, toxic 0 or 1) whose crc32(id as text) mod 3 isn't 1; about ``toxic`` and
    ``other`` of them, chosen by hash, at most, and of these, in the order of their hashes, as many as have BYTES of text
    together. Long texts are scored whole. Null and blank texts have the bias's score; with no labels, or of one class
    alone, every text has a score by the share of class 1. Other labels and null ids are passed over.
    """
    lean(docs.sparkSession)
    pool = labels.select(F.col("doc_id").alias("_i"), F.col("toxic").cast("int").alias("_y")).where(F.col("_i").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_i")).distinct()
    count = {r["_y"]: r["count"] for r in pool.groupBy("_y").count().collect()}
    limit = F.when(F.col("_y") == 1, int(2**31 * min(1.0, toxic / max(1, count.get(1, 0))))).otherwise(int(2**31 * min(1.0, other / max(1, count.get(0, 0)))))
    some = pool.where(F.pmod(F.xxhash64(F.lit("toxicity"), "_i"), F.lit(2**31)) < limit)  # about toxic + other rows
    known = docs.select(F.col(id_col).alias("_i"), F.col(text).alias("_x")).join(F.broadcast(some), "_i").withColumn("_h", F.xxhash64("_i", "_x", "_y"))
    sized = known.select("_h", F.coalesce(F.octet_length("_x"), F.lit(0)).alias("_n")).withColumn("_sum", F.sum("_n").over(Window.orderBy("_h")))  # toxic + other rows
    rows = known.join(F.broadcast(sized.where(F.col("_sum") <= BYTES).select("_h").distinct()), "_h").orderBy("_i", "_y", "_x").collect()
    value, bias = train([r["_x"] for r in rows], np.array([r["_y"] for r in rows], np.float64))
    kind = F.pandas_udf(partial(_scores, value.astype(np.float32), bias), "double", F.PandasUDFType.SCALAR_ITER)
    (got,) = fresh(docs, "_got")
    scored = docs.withColumn(got, kind(F.col(text)))
    return scored.select(*columns(c for c in docs.columns if c not in ("held_out", "score", "predicted")), held_out(id_col).alias("held_out"), F.col(got).alias("score"), (F.col(got) >= threshold).cast("int").alias("predicted"))

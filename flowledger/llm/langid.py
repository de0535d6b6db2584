"""Language identification as inference in a mixture of languages.

Each language has a distribution over byte trigrams of lower-cased letters, from labelled texts. A document is taken as a
mixture: each of its trigrams comes from one of its languages, with proportions that expectation-maximisation estimates.
Which languages it has is chosen by penalised likelihood: start with the likeliest single one, add the one with the
steepest gain, run EM, and stay with the larger set only if the log-likelihood rises by more than PENALTY x log(trigrams).
The prediction is the language with the largest proportion, which is also the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm.scratch import columns, fresh, lean

#: Trigrams are hashed to this many buckets.
BUCKETS = 1 << 16
#: About so many labelled documents of each language, chosen by hash, are learned from at most.
TRAIN = 5_000
SMOOTH, PENALTY, STEPS = 0.05, 3.0, 12
#: Trigram occurrences (distinct within a document) that are worked on at once.
BATCH = 1 << 16

_LETTER = np.arange(256, dtype=np.int64)
_LETTER[:128] = [x if chr(x).islower() else 32 for x in range(128)]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of one text; none if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = _LETTER[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    bucket = (code * 0x9E3779B1 >> 12) % BUCKETS
    if len(bucket) > 4000:
        n = np.bincount(bucket, minlength=BUCKETS)
        u = np.flatnonzero(n)
        return u, n[u]
    return np.unique(bucket, return_counts=True)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            u, n = trigrams(text)
            if len(u):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))[u] += n
    for lang, n in total.items():
        u = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": u, "n": n[u]})


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and their trigram probabilities as an array (buckets, languages), from rows (text, lang)."""
    counts = labelled.where("lang is not null").select("lang", "text").mapInPandas(_counts, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    langs = sorted(counts["lang"].unique())
    p = np.full((BUCKETS, len(langs)), SMOOTH)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        p[own["bucket"], i] += own["n"]
    return langs, (p / p.sum(0)).astype(np.float32)


def mixtures(p: np.ndarray, buckets: list[np.ndarray], counts: list[np.ndarray], penalty: float = PENALTY) -> np.ndarray:
    """Proportions, an array (documents, languages), zero for languages out of the chosen set. Documents aren't empty."""
    share = np.zeros((len(buckets), p.shape[1]))
    likely = np.zeros(len(buckets))
    size = np.array([len(x) for x in buckets])
    c_all, q_all = np.concatenate(counts).astype(np.float64), p[np.concatenate(buckets)].astype(np.float64)
    start = np.cumsum(size) - size
    single = np.add.reduceat(c_all[:, None] * np.log(q_all), start)
    share[np.arange(len(size)), single.argmax(1)] = 1
    likely[:] = single.max(1)
    total = np.add.reduceat(c_all, start)
    active = np.arange(len(size))
    for _ in range(p.shape[1] - 1):
        if not len(active):
            break
        at = np.repeat(start[active], size[active]) + np.arange(size[active].sum()) - np.repeat(np.cumsum(size[active]) - size[active], size[active])
        c, q, own = c_all[at], q_all[at], np.repeat(np.arange(len(active)), size[active])
        begin = np.cumsum(size[active]) - size[active]
        s = share[active]
        mix = (q * s[own]).sum(1)
        gain = np.add.reduceat(c[:, None] * q / mix[:, None], begin)
        gain[s > 0] = -np.inf
        s = 0.9 * s
        s[np.arange(len(active)), gain.argmax(1)] = 0.1
        for _ in range(STEPS):
            r = q * s[own]
            s = np.add.reduceat(r * (c / r.sum(1))[:, None], begin) / total[active, None]
        new = np.add.reduceat(c * np.log((q * s[own]).sum(1)), begin)
        better = new - likely[active] > penalty * np.log(total[active] + 1)
        active = active[better]
        share[active], likely[active] = s[better], new[better]
    return share


def _predict(langs: list[str], p: np.ndarray, penalty: float, parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            if i < len(texts):
                u, n = trigrams(text)
                if len(u) and langs:
                    held.append((i, u, n))
                    size += len(u)
            if held and (size > BATCH or i == len(texts)):
                share = mixtures(p, [x[1] for x in held], [x[2] for x in held], penalty)
                at = [x[0] for x in held]
                lang[at] = np.array(langs, object)[share.argmax(1)]
                score[at] = share.max(1).clip(0, 1)
                held, size = [], 0
        yield pd.DataFrame({"lang_pred": lang, "score": score})


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, train: int = TRAIN, penalty: float = PENALTY, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred, score and languages, the number of languages that could be learned.

    Learns from the rows with a language whose crc32(id as text) mod 5 isn't 0, or about ``train`` of each language chosen
    by hash. A text that is null or has no letter, or any text if nothing could be learned, is ``und`` with score 0. Rows
    without an id aren't learned from and count as not held out. Long texts are read whole; repeated rows come out equal.
    """
    lean(docs.sparkSession)
    pool = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    part = pool.groupBy("lang").agg((F.least(F.lit(1.0), F.lit(train) / F.count("*")) * 2**31).cast("long").alias("part"))  # a row for each language
    langs, p = learn(pool.join(F.broadcast(part), "lang").where(F.pmod(F.xxhash64(F.lit("langid"), "i"), F.lit(2**31)) < F.col("part")))
    kind = F.pandas_udf(partial(_predict, langs, p, penalty), "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)
    (told,) = fresh(docs, "_told")
    rest = columns(c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "languages"))
    return docs.withColumn(told, kind(F.col(text))).select(*rest, held_out(id_col).alias("held_out"), f"{told}.lang_pred", f"{told}.score", F.lit(len(langs)).alias("languages"))

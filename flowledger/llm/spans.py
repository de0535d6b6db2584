"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and sentences into clauses; every run of several consecutive ones is hashed, the hashes
are joined over all documents, and sentences covered by a run that is not the first with its hash are removed. A sentence
ends behind a stop or a line. Since a repeated passage may begin and end inside sentences, a clause ends also where the
hash of a word and the one before it is the least of some NEAR consecutive words, the last of equal ones: so any NEAR words
hold an end, whatever the text, and the same passage is cut at the same places in any surroundings, but for NEAR words at
either side. A run has at least SENTENCES of them and at least WORDS words, so that a few short words met by chance don't
count. In a passage of 51 words some end lies behind word 9 to 16 (from 1), and the run from there ends at word 43 at the
latest: every such passage holds a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import columns, fresh, lean

SENTENCES, WORDS = 3, 20
#: Consecutive words of which one ends a clause; with more, a passage of 51 words might hold no run.
NEAR = 8
_STOPS = frozenset(b".!?")
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _cuts(words: list[bytes]) -> np.ndarray:
    """Ends of clauses by the hashes of word pairs, a word by itself being too often a separator."""
    if len(words) < NEAR:
        return np.empty(0, np.int64)
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    h[1:] ^= h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(h[::-1], NEAR).argmin(1)
    ends = np.zeros(len(words) + 1, bool)
    ends[len(words) - np.arange(len(least)) - least] = True
    return np.flatnonzero(ends)


def runs(text: str, sentences: int = SENTENCES, least: int = WORDS) -> tuple[list[int], list[int], list[int]]:
    """(hash of 96 bits, first word, end) of each run of a text: from each sentence, the fewest next ones that make a run."""
    words: list[bytes] = []
    ends: list[int] = []
    for line in text.encode().lower().split(b"\n"):
        at = len(words)
        w = line.split()
        if w:
            words += w
            ends += [i for i, x in enumerate(w, at + 1) if x[-1] in _STOPS]
            if not ends or ends[-1] != len(words):
                ends.append(len(words))
    ends = sorted({*ends, *_cuts(words).tolist()})
    starts = [0, *ends]
    hashes, first, last = [], [], []
    to = 0
    for i in range(len(ends) - sentences + 1):
        to = max(to, i + sentences)
        while to <= len(ends) and starts[to] - starts[i] < least:
            to += 1
        if to > len(ends):
            break
        hashes.append(xxhash.xxh3_128_intdigest(b" ".join(words[starts[i] : starts[to]])) >> 32)
        first.append(starts[i])
        last.append(starts[to])
    return hashes, first, last


def _first_runs(sentences: int, least: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of each document, those that it repeats itself once."""
    for pdf in batches:
        hs, ids, ths, at = [], [], [], []
        for i, th, text in zip(pdf["_id"], pdf["_t"], pdf["_text"], strict=True):
            h, _, _ = runs(text or "", sentences, least)
            first = dict(zip(reversed(h), reversed(range(len(h))), strict=True))
            both = np.array([(x >> 32, (x & 0xFFFFFFFF) << 32 | k) for x, k in first.items()], np.uint64).reshape(-1, 2).view(np.int64)
            hs.append(both[:, 0])
            at.append(both[:, 1])
            ids.append(np.full(len(both), i))
            ths.append(np.full(len(both), th))
        if hs:
            yield pd.DataFrame({"h": np.concatenate(hs), "_id": np.concatenate(ids).astype(np.int64), "_t": np.concatenate(ths).astype(np.int64), "g": np.concatenate(at)})


def cut(text: str, gone: set[int], sentences: int = SENTENCES, least: int = WORDS) -> tuple[str, int]:
    """``text`` without the words covered by the runs numbered in ``gone`` or repeated in the text itself, and how many
    words that were. What stays is unchanged; removed words leave a line break if there was one among them, else a space."""
    h, first, last = runs(text, sentences, least)
    seen: set[int] = set()
    cover = np.zeros(len(text.encode()) // 2 + 3, np.int32)
    for k, x in enumerate(h):
        if k in gone or x in seen:
            cover[first[k]] += 1
            cover[last[k]] -= 1
        seen.add(x)
    dead = np.cumsum(cover) > 0
    if not dead.any():
        return text, 0
    raw = text.encode()
    out, end, n = [], 0, 0  # end: of what has been taken
    for k, m in enumerate(_WORD.finditer(raw)):
        if dead[k]:
            n += 1
        else:
            gap = raw[end : m.start()]
            out.append(gap if not gap.strip() else b"\n" if b"\n" in gap else b" ") if out or not gap.strip() else None
            out.append(m[0])
            end = m.end()
    if not raw[end:].strip():
        out.append(raw[end:])
    return b"".join(out).decode(), n


def _cut(sentences: int, least: int, parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, gone in parts:
        rows = [(None, 0) if t is None else cut(t, set() if g is None else set(map(int, g)), sentences, least) for t, g in zip(texts, gone, strict=True)]
        yield pd.DataFrame(rows, columns=["text", "removed"])


def dedup(docs: DataFrame, sentences: int = SENTENCES, least: int = WORDS, id_col: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text`` and the number of removed words in column ``removed``.

    The first place of a run is in the document with the smallest id, null before all; of several places in one document,
    the first. Every row stays, one that was all repeated with an empty text; a null text stays null. Rows with one id
    count as one document: they don't take from each other, equal rows come out equal. Texts of any length are cut whole.
    Only ids and hashes are shuffled until the end, where each text meets the numbers of its removed runs. Runs are the
    same if 96 bits of their hashes are: 64 in ``h``, and 32 in ``g`` above the run's number in its text.
    """
    lean(docs.sparkSession)
    i, t, dead, done = fresh(docs, "_id", "_t", "_gone", "_done")
    own, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text)
    found = docs.select(own.alias("_id"), mark.alias("_t"), F.col(text).alias("_text")).mapInPandas(partial(_first_runs, sentences, least), "h long, _id long, _t long, g long")
    run = Window.partitionBy("h", F.shiftrightunsigned("g", 32))
    later = found.withColumn("first", F.min("_id").over(run)).where(F.col("_id") != F.col("first"))
    gone = later.groupBy(F.col("_id").alias(i), F.col("_t").alias(t)).agg(F.collect_set(F.col("g").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias(dead))
    kind = F.pandas_udf(partial(_cut, sentences, least), "text string, removed long", F.PandasUDFType.SCALAR_ITER)
    both = docs.withColumn(i, own).withColumn(t, mark).join(gone, [i, t], "left").withColumn(done, kind(F.col(text), F.col(dead)))
    rest = [F.col(f"{done}.text").alias(text) if c == text else columns([c])[0] for c in docs.columns if c != removed]
    return both.select(*rest, F.col(f"{done}.removed").alias(removed))

"""Near-duplicates by SimHash: fingerprints, links by anchor-point covering, components.

Covering. The 64 bits fall into three blocks of 21, 21 and 22 bits; two fingerprints that differ in at most four bits
differ in at most one bit of some block. In a block, the anchors are the words of a covering code: the perfect Hamming
code of length 15, whose covering radius is 1, on the low bits, and every word on the other 6 or 7 bits. Every fingerprint
has its home at the anchor within the covering radius, and goes also to every anchor within radius plus threshold,
1 + 1 = 2: if x and y differ in one bit of the block, y goes to x's home. So all links are found by comparing, at each
anchor, those at home with all that are there. A code over all 64 bits at once would need the radius 4 + R around every
fingerprint: for R = 16 some forty anchors each holding 0.2 % of all rows, against about 44 anchors with 0.01 % here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowledger.llm.components import components, forest
from flowledger.llm.scratch import columns, fresh, keep, lean

WORDS, BITS = 4, 4
#: First bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Those at home at one anchor that are held in memory together; more are split.
HOMES = 8192
#: Pairs compared at once, and links held before they are reduced to a forest.
PAIRS, LINKS = 1 << 20, 1 << 19

_digest = partial(xxhash.xxh64_intdigest, seed=42)
#: Syndrome of the Hamming code of length 15: the exclusive or of the places, from 1, of the bits that are set.
_SYNDROME = np.zeros(1 << 15, np.int64)
for _i in range(15):
    _SYNDROME[1 << _i : 2 << _i] = _SYNDROME[: 1 << _i] ^ (_i + 1)
#: By syndrome: the bit to flip, and the seven pairs of bits to flip, to reach a code word.
_FLIP = np.array([0] + [1 << i for i in range(15)])
_PAIRS = np.array([[1 << (i - 1) | 1 << (j - 1) for i, j in combinations(range(1, 16), 2) if i ^ j == s] or [0] * 7 for s in range(16)])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash over the word shingles of one text, as an unsigned number; 0 without words."""
    w = (text or "").encode().lower().split()  # on bytes: A-Z alone, and white space is 0x20 and 0x09-0x0D
    if not w:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    for at in range(0, n, 1 << 16):
        part = w[at : at + (1 << 16) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if n > 1 or len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(_digest, shingles), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a long column ``fp``: the fingerprint's bits as a signed number."""
    return docs.withColumn("fp", _fingerprints(F.col(text)))


def _raw(width: int, weight: int) -> np.ndarray:
    """Masks over the bits from 15 to ``width`` with at most ``weight`` ones; the first is 0."""
    return np.array([sum(1 << b for b in c) for k in range(weight + 1) for c in combinations(range(15, width), k)])


def homes(fp: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint in each block: an array (fingerprints, blocks)."""
    out = []
    for k, (low, width) in enumerate(BLOCKS):
        v = (fp >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        out.append((v ^ _FLIP[_SYNDROME[v & 0x7FFF]]) | k << 22)
    return np.stack(out, 1)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fp, at home) for every anchor within radius plus threshold of each fingerprint."""
    keys, rows, home = [], [], []
    for k, (low, width) in enumerate(BLOCKS):
        v = (fp >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        s = _SYNDROME[v & 0x7FFF]
        word, off = np.flatnonzero(s == 0), np.flatnonzero(s)
        far, near = _raw(width, 2), _raw(width, 1)
        for at, key, first in (
            (word, v[word, None] ^ far, True),  # at distance 0 from a code word: two of the other bits may differ
            (off, (v[off] ^ _FLIP[s[off]])[:, None] ^ near, True),  # at distance 1: one
            (off, v[off, None] ^ _PAIRS[s[off]], False),  # the code words at distance 2: none
        ):
            keys.append((key | k << 22).ravel())
            rows.append(np.repeat(at, key.shape[1]))
            h = np.zeros(key.shape, bool)
            h[:, 0] = first
            home.append(h.ravel())
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(home)


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            fp = fps[at : at + 4096]
            key, row, home = anchors(fp)
            yield pd.DataFrame({"anchor": key, "fp": fp[row].view(np.int64), "home": home})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _home_keys(fp: pd.Series) -> pd.Series:
    return pd.Series(list(homes(fp.to_numpy().view(np.uint64))))


def _compare(bits: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each group, reduced to a forest. Rows come sorted by group, those at home first, so that a group's
    homes, at most about HOMES, are all that is carried from one batch to the next."""
    held_key, held = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
    left, right, count = [], [], 0

    def reduced() -> tuple[list, list, int]:
        if not left:
            return [], [], 0
        a, b = forest(np.concatenate(left), np.concatenate(right))
        return [a], [b], len(a)

    base = 0
    for pdf in batches:
        if pdf.empty:
            continue
        n0 = len(held)
        key = np.concatenate([held_key, pdf[["anchor", "chunk"]].to_numpy(np.int64)])
        fp = np.concatenate([held, pdf["fp"].to_numpy().view(np.uint64)])
        home = np.concatenate([np.ones(n0, bool), pdf["home"].to_numpy(bool)])
        new = np.r_[True, (key[1:] != key[:-1]).any(1)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        before = np.cumsum(home) - home  # homes before each row
        prior = before - before[first]
        prior[:n0] = 0  # compared in an earlier batch
        rows = np.flatnonzero(prior)
        ends = np.cumsum(prior[rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            r, p = rows[at:to], prior[rows[at:to]]
            x = np.repeat(r, p)
            y = np.repeat(first[r], p) + np.arange(len(x)) - np.repeat(np.cumsum(p) - p, p)
            hit = np.bitwise_count(fp[x] ^ fp[y]) <= bits
            if hit.any():
                left.append(fp[x[hit]])
                right.append(fp[y[hit]])
                count += int(hit.sum())
                if count > base + LINKS:
                    left, right, count = reduced()
                    base = count
            at = to
        last = first[-1]
        stay = np.flatnonzero(home[last:]) + last
        held_key, held = key[stay], fp[stay]
    for a, b in zip(*reduced()[:2], strict=True):
        yield pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fps`` (long fp) as all pairs within ``bits`` bits would.

    An anchor with more than HOMES at home is split into chunks of them; all that are at that anchor meet each chunk.
    """
    fps = fps.repartition("fp")
    key = F.explode(_home_keys("fp")).alias("anchor")
    hot = keep(fps.select(key).groupBy("anchor").count().where(F.col("count") > HOMES).select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("chunks")), "anchors")
    rows = fps.select("fp").mapInPandas(_expand, "anchor long, fp long, home boolean")
    if n := hot.count():
        # at most 3 / HOMES of the fingerprints; broadcast only while that is few
        rows = rows.join(F.broadcast(hot) if n <= 100_000 else hot, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
        rows = rows.select("anchor", "fp", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
        rows = rows.select("anchor", "chunk", "fp", (F.col("home") & (F.col("own") == F.col("chunk"))).alias("home"))
    else:
        rows = rows.select("anchor", F.lit(0).alias("chunk"), "fp", "home")
    rows = rows.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home"))
    return rows.mapInPandas(partial(_compare, bits), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, fp, root, component_id) for each row of ``docs``; root is the smallest fingerprint of the component.

    component_id is the smallest id among the documents that can be reached over links, itself included.
    Null and blank texts have the fingerprint 0 and link like any other. Null ids take part, but count only where a
    component has no other id, which is then null. Rows with the same id are all returned. An empty table gives no rows.
    """
    lean(docs.sparkSession)
    fps = keep(fingerprints(docs.select(F.col(id_col), F.col(text)), text).select(F.col(id_col), F.xxhash64(text).alias("text_hash"), "fp"), "fingerprints")
    first = keep(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    return grouped(fps, first, components(links(first.select("fp"))), id_col)


def grouped(fps: DataFrame, first: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """(id, text_hash, fp, root, component_id) for each row of ``fps``, whose distinct fp are in ``first`` with their
    smallest id; ``roots`` (u, root) has the root of each fp that isn't its component's smallest."""
    named = keep(first.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "root", "component_id"), "fp").select(id_col, "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id. Of rows with the same
    id in one group, the one with the smallest text hash stays, once."""
    return first_of_each(docs, near_duplicates(docs, id_col, text), id_col, text)


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with one document of each of the ``groups`` that near_duplicates gives."""
    best = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("text_hash").alias("h"))).alias("b"))
    i, h, t = fresh(docs, "_id", "_h", "_t")
    stay = best.select(F.col("b.id").alias(i), F.col("b.h").alias(h))
    cols = columns(docs.columns)
    joined = docs.withColumn(t, F.xxhash64(text)).join(stay, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(t) == F.col(h)), "left_semi")
    return joined.dropDuplicates([id_col, t]).select(*cols)

"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

A vector, less the mean of all, is rotated by a random orthogonal matrix; the signs of its coordinates are its code, one
bit each, and two scalars go with it: its length and the inner product of its direction with the code's. From the packed
bits and these scalars the inner product with any query is estimated without bias, with an error of known spread. A
candidate whose upper bound (estimate plus MARGIN spreads) reaches the k-th best score known so far, or the k-th best lower
bound of its block, is read in full and scored exactly; the others aren't. Queries are rounded to four bits a coordinate, so
that an estimate is a few population counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm import blocks
from flowledger.llm.scratch import keep

#: Spreads of the estimate's error on each side of it.
MARGIN = 2.0
PLANES = 4
#: Bits of a code for each component: vectors are padded with zeros before they are rotated, which narrows the error.
BITS = 2


def rotation(dim: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """Rows of a random orthogonal matrix of ``bits`` x ``dim`` columns: those that zeros don't meet."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits * dim, bits * dim)))
    return (q * np.sign(np.diag(r)))[:dim]


def codes(v: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes, an array (vectors, words of 64 bits), and scalars (length, alignment, inner product of the mean is
    left to the query)."""
    rest = v - mean
    length = np.sqrt((rest**2).sum(1))
    unit = rest / np.where(length > 0, length, 1)[:, None] @ turn
    bits = unit > 0
    align = np.abs(unit).sum(1) / np.sqrt(turn.shape[1])
    pad = -turn.shape[1] % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view("<u8")
    return packed, np.stack([length, np.where(length > 0, align, 1)], 1).astype("<f4")


def estimates(packed: np.ndarray, scalars: np.ndarray, q: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, spread of their error), arrays (queries, vectors)."""
    dim = turn.shape[1]
    turned = q @ turn
    low, high = turned.min(1), turned.max(1)
    step = np.where(high > low, (high - low) / (2**PLANES - 1), 1)
    level = np.floor((turned - low[:, None]) / step[:, None] + np.random.default_rng(3).random(turned.shape)).astype(np.int64).clip(0, 2**PLANES - 1)
    pad = -dim % 64
    total = np.zeros((len(q), len(packed)), np.float32)
    for j in range(PLANES):
        plane = np.packbits(np.pad((level >> j & 1).astype(bool), ((0, 0), (0, pad))), axis=1, bitorder="little").view("<u8")
        for w in range(packed.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & packed[None, :, w]).astype(np.float32) * np.float32(1 << j)
    ones = np.bitwise_count(packed).sum(1).astype(np.float32)
    total *= (2 * step).astype(np.float32)[:, None]
    total += (2 * low).astype(np.float32)[:, None] * ones
    total -= turned.sum(1).astype(np.float32)[:, None]
    length, align = scalars[:, 0], scalars[:, 1]
    total *= length / align / np.float32(np.sqrt(dim))
    total += (q @ mean).astype(np.float32)[:, None]
    norm = np.sqrt((q**2).sum(1))
    spread = norm.astype(np.float32)[:, None] * (length * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.float32(np.sqrt(max(1, dim - 1))))
    return total, spread


class OneBit:
    """Bounds by one-bit codes, scores in double precision, for vectors of several lengths."""

    def __init__(self, kind: str, margin: float, mean: dict[int, np.ndarray]):
        self.kind, self.margin, self.mean = kind, margin, mean

    def approx(self, v: np.ndarray) -> bytes:
        packed, scalars = codes(v.astype(np.float64), self.mean[v.shape[1]], turned(v.shape[1]))
        return packed.tobytes() + scalars.tobytes()

    def bounds(self, approx: bytes, n: int, d: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = -(-BITS * d // 64)
        packed = np.frombuffer(approx, "<u8", n * words).reshape(n, words)
        guess, spread = estimates(packed, np.frombuffer(approx, "<f4", offset=packed.nbytes).reshape(n, 2), q, self.mean[d], turned(d))
        spread *= self.margin
        return guess - spread, guess + spread

    def score(self, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, None]:
        return v.astype(np.float64) @ q.astype(np.float64), None

    def bar(self):
        return F.col("score")


@lru_cache(16)
def turned(dim: int) -> np.ndarray:
    return rotation(dim)


def nearest(df: DataFrame, k: int = 20, every: int = 20, margin: float = MARGIN, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k largest inner products found
    among all other rows, ties to the smaller id.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component take no part, nor do null ids. A query's
    candidates are the vectors of its length, as there is no inner product with others. Equal rows are candidates each,
    and rows that share an id with different vectors are searched each. Fewer than k candidates are all returned; an
    empty table gives no rows.
    """
    rows = keep(blocks.sound(df, id_col, vector, zero=False), "vectors")
    known = blocks.ends(rows)
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    sample = blocks.sampled(rows, {d: x[0] for d, x in known.items()})
    found = blocks.search(rows, known, sample, every, OneBit(kind, margin, {d: x[3] for d, x in known.items()}), k)
    return found.select("query_id", "rank", "vec_id", "score")

"""Exact top-k by integer inner product over a vector-approximation file.

Each component is kept as the number of its cell: up to CELLS cells of a dimension, with edges at quantiles of a bounded
sample, so that cells hold about as many vectors each. A vector's cells are ranges of its components and give a lower and
an upper bound of its inner product with a query, narrow where cells are narrow. Vectors whose upper bound doesn't reach
the k-th best score known so far, or the k-th best lower bound of their block, are passed over; of the others the exact
vectors are read and scored. Nothing is left to chance: with its ties, the result is that of reading everything.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm import blocks
from flowledger.llm.scratch import keep

SCALE, CELLS = 256, 64
_LIMB = 1 << 62


class Cells:
    """Bounds by cells with given edges (by length, an array (components, cells + 1)), scores as whole numbers."""

    kind = "<i8"

    def __init__(self, edges: dict[int, np.ndarray]):
        self.edges = edges

    def approx(self, v: np.ndarray) -> bytes:
        e = self.edges[v.shape[1]]
        return np.stack([np.searchsorted(e[j, 1:-1], v[:, j], side="right") for j in range(v.shape[1])], 1).astype(np.uint8).tobytes()

    def bounds(self, approx: bytes, n: int, d: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, cells, every = self.edges[d], np.frombuffer(approx, np.uint8).reshape(n, d), np.arange(d)
        a, b = e[every, cells], e[every, cells + 1]
        middle = q @ ((a + b) / 2).T
        half = np.abs(q) @ ((b - a) / 2).T + (1e-9 * np.abs(q) @ np.abs(e).max(1) + 1)[:, None]  # and rounding
        return middle - half, middle + half

    def score(self, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        largest = int(max(abs(int(q.max())), abs(int(q.min())))) * int(max(abs(int(v.max())), abs(int(v.min())))) * len(q)
        if largest < 1 << 52:
            s = (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        elif largest < _LIMB:
            s = v @ q
        else:
            s = v.astype(object) @ q.astype(object)
        return s.astype(np.float64), np.stack([s // _LIMB // _LIMB, s // _LIMB % _LIMB, s % _LIMB]).astype(np.int64)

    def bar(self):
        """A score in double precision, or a little less."""
        return F.col("score") - F.abs("score") * 1e-12 - 1


def cells(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Edges of cells, (components, CELLS + 1): quantiles of the sample between the least and the greatest value of all."""
    inner = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="inverted_cdf").T
    return np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None]), high[:, None]], 1)


def top(df: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k largest integer inner
    products with all other rows, over components floor(scale * x), ties to the smaller id.

    Vectors that are null, empty or hold a null, NaN or infinite component take no part, nor do null ids. A query's
    candidates are the vectors of its length, as there is no inner product with others. Equal rows are candidates each,
    and rows that share an id with different vectors are searched each. Fewer than k candidates are all returned; an empty
    table gives no rows. Whole components beyond 64 bits count as the largest such number; scores are ranked exactly
    whatever their size, and those beyond 64 bits are shown as the largest such number.
    """
    whole = blocks.sound(df, id_col, vector, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")))
    rows = keep(whole, "vectors")
    known = blocks.ends(rows)
    sample = blocks.sampled(rows, {d: x[0] for d, x in known.items()})
    edges = {d: cells(sample.get(d, np.stack(x[1:3])), x[1], x[2]) for d, x in known.items()}
    found = blocks.search(rows, known, sample, every, Cells(edges), k)
    # between -2 x 2^62 and 2 x 2^62 a score has 64 bits
    far = F.when((F.col("top") > 0) | (F.col("top") == 0) & (F.col("high") > 1), F.lit(2**63 - 1)).when((F.col("top") < -1) | (F.col("top") == -1) & (F.col("high") < _LIMB - 2), F.lit(-(2**63)))
    score = F.coalesce(far, F.shiftleft(F.when(F.col("top") == 0, F.col("high")).otherwise(F.col("high") - F.lit(_LIMB)), 62) + F.col("low"))
    return found.select("query_id", "rank", "vec_id", score.alias("score"))

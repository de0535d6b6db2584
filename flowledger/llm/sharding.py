"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows lie in buckets, by a hash of their content, which stand for the partitions of the classic scheme and, unlike
those, are the same if a lost task runs again. How many rows each bucket sends to each shard follows the multivariate
hypergeometric law, drawn exactly: a binary tree over the buckets splits the shards' sizes between its halves, each node
with a generator seeded by its own number, so that any task can find any bucket's row of the matrix by going down from
the root. Inside a bucket the rows are permuted and cut by its row of the matrix; in the shard they are permuted again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep

SHARDS, SEED = 40, 20
#: Buckets: a power of two, about ROWS rows in each, from 64 to 65536, so that the counts that each task gets fit in 512 KB.
ROWS, FEWEST, MOST = 50_000, 64, 65_536
#: Groups of a shard for the second permutation.
GROUPS = 64


def sizes(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def matrix_row(bucket: int, before: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows that ``bucket`` sends to each shard. before: rows in the buckets before each, and all rows at the end; the
    number of buckets is a power of two."""
    lo, hi = 0, len(before) - 1
    left = sizes(int(before[-1]), shards)
    node = 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _drawn(np.random.default_rng([seed, node]), left, int(before[mid] - before[lo]))
        if bucket < mid:
            left, hi, node = first, mid, 2 * node
        else:
            left, lo, node = left - first, mid, 2 * node + 1
    return left


def _drawn(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows, drawn without replacement, come from each shard."""
    if sizes.sum() < 1_000_000_000:  # as much as numpy's own method takes
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    out, rest = np.zeros_like(sizes), int(sizes.sum())
    for i, size in enumerate(map(int, sizes)):
        rest -= size
        out[i] = x = _one(rng, size, rest, n)
        n -= x
    return out


def _one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric number by Stadlober's ratio of uniforms, for populations of any size."""
    total, low, high, m = good + bad, min(good, bad), max(good, bad), min(n, good + bad - n)
    if m == 0 or low == 0:
        z = 0
    else:
        p = low / total
        mean, spread = m * p + 0.5, math.sqrt((total - m) * m * p * (1 - p) / (total - 1) + 0.5)
        mode = (m + 1) * (low + 1) // (total + 2)
        log = lambda k: math.lgamma(k + 1) + math.lgamma(low - k + 1) + math.lgamma(m - k + 1) + math.lgamma(high - m + k + 1)
        peak, top = log(mode), min(min(m, low) + 1, math.floor(mean + 16 * spread))
        while True:
            u, v = 1 - rng.random(), rng.random()
            w = mean + (1.7155277699214135 * spread + 0.8989161620588988) * (v - 0.5) / u
            if 0 <= w < top and 2 * math.log(u) <= peak - log(z := math.floor(w)):
                break
    z = m - z if good > bad else z
    return good - z if m < n else z


def _matrix(before: np.ndarray, shards: int, seed: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ends = [np.cumsum(matrix_row(int(b), before, shards, seed)).tolist() for b in pdf["bucket"]]
        yield pd.DataFrame({"bucket": pdf["bucket"], "ends": ends})


def buckets(rows: int) -> int:
    return min(MOST, max(FEWEST, 1 << max(0, rows // ROWS).bit_length()))


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row: a uniform shuffle, with row counts of the shards at most one apart.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 of a null text is that of the empty one; slot runs
    from 0 in each shard without gaps. Rows with the same id and text are dealt like any others. The result depends on
    the rows and the seed alone, not on how the table is cut into partitions. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = keep(rows, "rows")
    n = buckets(rows.count())
    content = (F.lit(seed), id_col, "size", "text_crc32")
    # (bucket, order in it) and (group, order in it) come from unlike hashes, so that one permutation says nothing of the other
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), *content), F.lit(n)).cast("int"))
    counts = np.zeros(n, np.int64)
    for r in rows.groupBy("bucket").count().collect():  # at most MOST rows
        counts[r["bucket"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(counts)])
    matrix = spark.range(n).select(F.col("id").cast("int").alias("bucket")).mapInPandas(partial(_matrix, before, shards, seed), "bucket int, ends array<long>")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit("order"), *content), id_col, "size", "text_crc32")
    dealt = rows.withColumn("k", F.row_number().over(order) - 1).join(matrix, "bucket")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("k"))).alias("shard")
    dealt = dealt.select(id_col, "size", "text_crc32", shard, F.pmod(F.xxhash64(F.lit("group"), *content), F.lit(GROUPS)).cast("int").alias("group"))
    dealt = keep(dealt, "dealt")
    groups = dealt.groupBy("shard", "group").agg(F.count("*").alias("n"))  # shards x GROUPS rows
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    base = groups.select("shard", "group", F.coalesce(earlier, F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "group").orderBy(F.xxhash64(F.lit("slot"), *content), id_col, "size", "text_crc32")
    placed = dealt.withColumn("k", F.row_number().over(order) - 1).join(base, ["shard", "group"])
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("k") + F.col("base")).cast("long").alias("slot"))

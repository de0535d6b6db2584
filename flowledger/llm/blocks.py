"""A stated set of query vectors against all vectors, in blocks, approximations first.

Vectors are grouped by their nearest of some centres, which are learned from a bounded sample, and packed into blocks of
bounded size; queries likewise. A search then takes three steps, each an equi-join of blocks by a list of which queries
need which block:

1. The vectors of the centre that promises most are read in full. The k-th best score found there is the query's bar.
2. A centre whose vectors can't reach the bar, by the ranges of their components, is left out. From the others only the
   approximations travel to the queries; vectors whose upper bound reaches the bar are noted.
3. Exact vectors travel only to the queries that noted one of their block, and the noted ones are scored.

The unit is the row: equal rows are candidates each, and a query's only row that is none is its own. Rows of another
length aren't comparable, so lengths are searched apart. Of equal vectors only the k + 1 with the smallest ids can be in
anyone's result (one may be the query itself), so the others are left out of the blocks first; Spark cuts each group to
k + 1 rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep, lean

#: Vectors in a block of candidates, and queries in a block of those, about; fewer if they hold more than so many numbers.
ROWS, QUERIES, NUMBERS = 16_384, 2_048, 1 << 20
#: Centres of one length at most, and numbers in the sample that they are learned from.
CENTRES, SAMPLE = 1024, 2_000_000
#: Queries whose bounds are held at once.
CHUNK = 64
BLOCK = "block int, d int, centre int, ids binary, rks binary, approx binary, exact binary"
LIST = "qb int, d int, centre int, picked binary"
#: A score, and as a whole number that is ranked exactly: top x 2^124 + high x 2^62 + low.
FOUND = "qrk long, query_id long, vec_id long, score double, top long, high long, low long"
LIMBS = ("top", "high", "low")


def sound(df: DataFrame, id_col: str, vector: str, zero: bool) -> DataFrame:
    """(rk, vec_id, v, d) of the rows that take part: the id isn't null, the vector is neither null nor empty and all its
    components are finite, not all zero unless ``zero``. rk numbers the rows, d is the vector's length."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("d")).where(F.col("vec_id").isNotNull() & (F.col("d") > 0) & fine)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("rk"), "vec_id", "v", "d")


def ends(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: rows, and the least, the greatest and the mean value of each component."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, g in pdf.groupby("d"):
                v = np.stack(g["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"d": d, "i": np.arange(d), "n": len(v), "a": v.min(0), "b": v.max(0), "s": v.sum(0)})

    got = rows.mapInPandas(part, "d int, i int, n long, a double, b double, s double").groupBy("d", "i").agg(F.sum("n"), F.min("a"), F.max("b"), F.sum("s")).toPandas()  # a row for each component
    out = {}
    for d, g in got.groupby("d"):
        n, a, b, s = g.sort_values("i").iloc[:, 2:].to_numpy().T
        out[int(d)] = (int(n[0]), a, b, s / n)
    return out


def sampled(rows: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """By length: some vectors chosen by hash, about SAMPLE numbers of all lengths together."""
    if not sizes:
        return {}
    share = int(2**31 * min(1.0, SAMPLE / sum(d * n for d, n in sizes.items())))
    got = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "rk"), F.lit(2**31)) <= share).select("d", "v").toPandas()
    return {int(d): np.stack(g["v"].to_numpy()).astype(np.float64) for d, g in got.groupby("d")}


def centres(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """``n`` centres of the sample by some rounds of k-means; with few different vectors, fewer."""
    rng = np.random.default_rng(seed)
    c = np.unique(sample[rng.permutation(len(sample))[:n]], axis=0)
    for _ in range(8 if len(c) > 1 else 1):
        near = nearest_centre(sample, c)
        for k in np.unique(near):
            c[k] = sample[near == k].mean(0)
    return c


def nearest_centre(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = [((c**2).sum(1) - 2 * v[at : at + 4096] @ c.T).argmin(1) for at in range(0, len(v), 4096)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _placed(middle: dict[int, np.ndarray], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        centre = np.zeros(len(pdf), np.int32)
        for d, at in pdf.groupby("d").indices.items():
            centre[at] = nearest_centre(np.stack(pdf["v"].iloc[at].to_numpy()).astype(np.float64), middle[d]) if d in middle else 0
        yield pdf.assign(centre=centre)


def _pack(method: Any, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy())
    long = lambda c: [pdf[c].to_numpy(np.int64).tobytes()]
    return pd.DataFrame({"block": [key[0]], "d": [pdf["d"].iloc[0]], "centre": [pdf["centre"].iloc[0]], "ids": long("vec_id"), "rks": long("rk"), "approx": [method.approx(v)], "exact": [v.tobytes()]})


def most(size: int, d: int) -> int:
    return max(1, min(size, NUMBERS // d))


def packed(rows: DataFrame, size: int, method: Any, name: str) -> DataFrame:
    """Blocks of about ``size`` rows of one length and centre: ids, row numbers, approximations and whole vectors."""
    counts = rows.groupBy("d", "centre").count().orderBy("d", "centre").collect()  # a row for each centre
    salts = [-(-r["count"] // most(size, r["d"])) for r in counts]
    first = np.cumsum([0, *salts])
    place = rows.sparkSession.createDataFrame([(r["d"], r["centre"], int(f), s) for r, f, s in zip(counts, first, salts, strict=False)], "d int, centre int, first int, salts int")
    block = (F.col("first") + F.pmod(F.xxhash64("rk"), F.col("salts"))).cast("int").alias("block")
    dealt = rows.join(F.broadcast(place), ["d", "centre"]).select(block, "rk", "vec_id", "v", "d", "centre")
    return keep(dealt.groupBy("block").applyInPandas(partial(_pack, method), BLOCK), name)


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


def _matrix(x: bytes, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(x, kind).reshape(-1, d)


def reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner products, an array (queries, centres), with any vector in the range of each centre."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _promising(method: Any, ranges: dict, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each query the centre that promises most, by block of queries and centre."""
    for pdf in batches:
        for r in pdf.itertuples():
            if r.d in ranges:
                names, _, _, middle = ranges[r.d]
                best = (_matrix(r.exact, method.kind, r.d).astype(np.float64) @ middle.T).argmax(1)
                yield from _lists(r, names, [(c, np.flatnonzero(best == c)) for c in np.unique(best)], None)


def _able(method: Any, ranges: dict, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each query the centres that may reach its bar, with the bar."""
    for pdf in batches:
        for r in pdf.itertuples():
            if r.d in ranges:
                names, low, high, _ = ranges[r.d]
                q = _matrix(r.exact, method.kind, r.d).astype(np.float64)
                bar = np.full(len(q), -np.inf)
                if r.bars is not None and len(r.bars):
                    known = {x["qrk"]: x["bar"] for x in r.bars}
                    bar = np.array([known.get(x, -np.inf) for x in _numbers(r.rks)])
                top = reach(q, low, high)
                top += 1e-9 * reach(np.abs(q), -np.maximum(np.abs(low), np.abs(high)), np.maximum(np.abs(low), np.abs(high)))  # rounding
                fit = ~(top < bar[:, None])
                yield from _lists(r, names, [(c, np.flatnonzero(fit[:, c])) for c in np.flatnonzero(fit.any(0))], bar)


def _lists(r: Any, names: np.ndarray, picks: list[tuple[int, np.ndarray]], bar: np.ndarray | None) -> Iterator[pd.DataFrame]:
    rows = [(r.block, r.d, int(names[c]), at.astype("<i4").tobytes() + (b"" if bar is None else bar[at].tobytes())) for c, at in picks]
    yield pd.DataFrame(rows, columns=["qb", "d", "centre", "picked"])


def _best(method: Any, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The k best of a block's vectors for each query listed; all vectors, or those noted for it."""
    for pdf in batches:
        for r in pdf.itertuples():
            ids, rks, v = _numbers(r.ids), _numbers(r.rks), _matrix(r.exact, method.kind, r.d)
            qids, qrks, q = _numbers(r.qids), _numbers(r.qrks), _matrix(r.qexact, method.kind, r.d)
            if "counts" in pdf.columns:
                counts, noted = np.frombuffer(r.counts, "<i4"), np.frombuffer(r.noted, "<i4")
                listed = np.frombuffer(r.picked, "<i4")
                parts = zip(listed, np.split(noted, np.cumsum(counts)[:-1]) if len(counts) else [], strict=True)
            else:
                parts = ((i, None) for i in np.frombuffer(r.picked, "<i4"))
            out = []
            for i, at in parts:
                at = np.flatnonzero(rks != qrks[i]) if at is None else at[rks[at] != qrks[i]]
                if not len(at):
                    continue
                score, limbs = method.score(q[i], v[at])
                if limbs is None:
                    if len(at) > 4 * k:
                        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
                        at, score = at[near], score[near]
                    limbs = np.zeros((3, len(at)), np.int64)
                top = np.lexsort((ids[at], -score, *(-limbs[::-1])))[:k]
                out.append((np.full(len(top), qrks[i]), np.full(len(top), qids[i]), ids[at[top]], score[top], *limbs[:, top]))
            if out:
                yield pd.DataFrame(dict(zip(("qrk", "query_id", "vec_id", "score", *LIMBS), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _note(method: Any, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The vectors of a block whose upper bound reaches the bar of a query, or the k-th best lower bound of the block."""
    for pdf in batches:
        for r in pdf.itertuples():
            n = len(r.picked) // 12
            picked, bar = np.frombuffer(r.picked, "<i4", n), np.frombuffer(r.picked, np.float64, offset=4 * n)
            rks, q, qrks = _numbers(r.rks), _matrix(r.qexact, method.kind, r.d).astype(np.float64), _numbers(r.qrks)
            counts, noted = [], []
            for at in range(0, n, CHUNK):
                some = picked[at : at + CHUNK]
                with np.errstate(over="ignore", invalid="ignore"):  # where bounds overflow, all is read
                    low, high = method.bounds(r.approx, len(rks), r.d, q[some])
                edge = bar[at : at + CHUNK].copy()
                if len(rks) > k:  # one of the k + 1 may be the query itself
                    edge = np.maximum(edge, np.partition(low, -(k + 1), axis=1)[:, -(k + 1)])
                for i, hit in enumerate(~(high < edge[:, None])):
                    hits = np.flatnonzero(hit)
                    hits = hits[rks[hits] != qrks[some[i]]]
                    counts.append(len(hits))
                    noted.append(hits.astype("<i4"))
            if any(counts):
                yield pd.DataFrame({"block": [r.block], "qb": [r.qb], "picked": [picked.tobytes()], "counts": [np.array(counts, "<i4").tobytes()], "noted": [np.concatenate(noted).tobytes()]})


def search(rows: DataFrame, known: dict, sample: dict[int, np.ndarray], every: int, method: Any, k: int) -> DataFrame:
    """The k best candidates of each query, (query_id, rank, vec_id, score, top, high, low). ``method`` has ``kind``, the type of
    a stored component, ``approx`` (of some vectors), ``bounds`` (lower and upper, by an approximation) and ``score``."""
    lean(rows.sparkSession)
    middle = {d: centres(x, min(CENTRES, -(-known[d][0] // most(ROWS, d)))) for d, x in sample.items()}
    placed = keep(rows.mapInPandas(partial(_placed, middle), f"rk long, vec_id long, v {rows.schema['v'].dataType.simpleString()}, d int, centre int"), "placed")
    w = Window.partitionBy("d", F.xxhash64("v"), "v").orderBy("vec_id", "rk")
    data = packed(placed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1), ROWS, method, "blocks")
    queries = packed(placed.where(F.col("vec_id") % every == 0), QUERIES, method, "queries")

    part = data.select("d", "centre", "exact").mapInPandas(partial(_range, method.kind), "d int, centre int, i int, a double, b double, s double, n long")
    found = part.groupBy("d", "centre", "i").agg(F.min("a").alias("a"), F.max("b").alias("b"), (F.sum("s") / F.sum("n")).alias("m")).toPandas()  # CENTRES rows a component
    ranges = {}
    for d, g in found.groupby("d"):
        g = g.sort_values(["centre", "i"])
        ranges[int(d)] = (g["centre"].unique(), *(g[c].to_numpy().reshape(-1, int(d)) for c in "abm"))

    exact = data.select("block", "d", "centre", "ids", "rks", "exact")
    ask = queries.select(F.col("block").alias("qb"), F.col("ids").alias("qids"), F.col("rks").alias("qrks"), F.col("exact").alias("qexact"))
    first = queries.select("block", "d", "exact").mapInPandas(partial(_promising, method, ranges), LIST)
    tried = keep(first.join(exact, ["d", "centre"]).join(ask, "qb").mapInPandas(partial(_best, method, k), FOUND), "tried")
    order = [*map(F.desc, LIMBS), F.desc("score"), "vec_id"]
    best = Window.partitionBy("qrk").orderBy(*order)
    bars = tried.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("qrk", method.bar().alias("bar"))
    members = queries.select("block", "rks").mapInPandas(_members, "block int, qrk long")
    bars = members.join(bars, "qrk").groupBy("block").agg(F.collect_list(F.struct("qrk", "bar")).alias("bars"))  # as many as a block has queries
    able = queries.select("block", "d", "rks", "exact").join(bars, "block", "left").mapInPandas(partial(_able, method, ranges), LIST)
    codes = data.select("block", "d", "centre", "rks", "approx")
    noted = keep(able.join(codes, ["d", "centre"]).join(ask, "qb").mapInPandas(partial(_note, method, k), "block int, qb int, picked binary, counts binary, noted binary"), "noted")
    found = noted.join(exact, "block").join(ask, "qb").mapInPandas(partial(_best, method, k), FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *LIMBS)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for block, rks in zip(pdf["block"], pdf["rks"], strict=True):
            yield pd.DataFrame({"block": block, "qrk": _numbers(rks)})


def _range(kind: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            v = _matrix(r.exact, kind, r.d).astype(np.float64)
            yield pd.DataFrame({"d": r.d, "centre": r.centre, "i": np.arange(r.d), "a": v.min(0), "b": v.max(0), "s": v.sum(0), "n": len(v)})

"""Periods, epochs, targets, splits and preprocessing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date, timedelta
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowledger.functions.order import highest, pct_rank, settled, winsorize


def periods(spark: SparkSession, modeling_start: str, training_days: int, modeling_days: int) -> DataFrame:
    """(period, start, end), both ends included: training, modeling, coin_modeling, investing."""
    s = date.fromisoformat(modeling_start)
    rows = [("training", s - timedelta(training_days), s - timedelta(1))]
    for name in ("modeling", "coin_modeling", "investing"):
        rows.append((name, s, s + timedelta(modeling_days - 1)))
        s += timedelta(modeling_days)
    return spark.createDataFrame([(n, str(a), str(b)) for n, a, b in rows], "period string, a string, b string").select("period", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"))


def windows(modeling_start: str, count: int, every: int) -> list[str]:
    """Starts of time windows, the given one first, going back."""
    s = date.fromisoformat(modeling_start)
    return [str(s - timedelta(k * every)) for k in range(count)]


def epochs(spark: SparkSession, base: Mapping[str, str], offsets: Mapping[str, Sequence[int]]) -> DataFrame:
    """(epoch_type, offset_days, dates...) of every offset, all dates shifted by it."""
    rows = [(t, o) for t, os in offsets.items() for o in os]
    df = spark.createDataFrame(rows, "epoch_type string, offset_days int")
    return df.select("*", *[F.date_add(F.lit(d).cast("date"), F.col("offset_days")).alias(n) for n, d in base.items()])


def offset_superset(spark: SparkSession, *lists: Sequence[int]) -> DataFrame:
    """Sorted distinct sums of one offset of each list."""
    sums = {0}
    for xs in lists:
        sums = {a + b for a in sums for b in xs}
    return spark.createDataFrame([(x,) for x in sorted(sums)], "offset_days int")


def overlap(epochs_: DataFrame) -> DataFrame:
    """Modeling epochs that end after the earliest validation epoch starts."""
    first = epochs_.where("epoch_type = 'validation'").agg(F.min("start_date").alias("first"))
    return epochs_.where("epoch_type = 'modeling'").crossJoin(F.broadcast(first)).where("end_date > first")


#: Epochs that are broadcast at most, and values of a column that become columns of their own.
EPOCHS, CATEGORIES = 10_000, 1_000


def in_epochs(df: DataFrame, epochs_: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Rows once for each epoch that they fall into, with its start: one range join with a broadcast table, of which EPOCHS
    rows are the most."""
    if epochs_.limit(EPOCHS + 1).count() > EPOCHS:
        raise ValueError(f"more than {EPOCHS} epochs")
    t = epochs_.select(F.col(start).alias("epoch_start_date"), F.col(end).alias("_end"))
    return df.join(F.broadcast(t), F.col("date").between(F.col("epoch_start_date"), F.col("_end"))).drop("_end")


def one_epoch(df: DataFrame, key: str = "wallet_address", seed: int = 0) -> DataFrame:
    """One row of each key, by a hash of key, epoch and seed, so that features and targets choose alike."""
    w = Window.partitionBy(key).orderBy(F.hash(key, F.col("epoch_start_date").cast("string"), F.lit(seed)), "epoch_start_date")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# targets


def coin_performance(market: DataFrame, start, end) -> DataFrame:
    """Price at the end over price at the start, less 1; NULL without one of them."""
    on = lambda d: F.max(F.when(F.col("date") == F.lit(str(d)).cast("date"), F.col("price")))
    g = market.groupBy("coin_id").agg(on(start).alias("s"), on(end).alias("e")).where("s is not null or e is not null")
    return g.select("coin_id", (F.try_divide(F.col("e"), F.col("s")) - 1).alias("coin_return"))


def strict_returns(market: DataFrame, start, end) -> DataFrame:
    """The same; a missing price is an error."""
    r = coin_performance(market, start, end)
    return r.withColumn("coin_return", F.coalesce("coin_return", F.raise_error(F.concat(F.lit("no price of "), F.col("coin_id").cast("string"))).cast("double")))


def fill_up(df: DataFrame, column: str, already: Column, share: float, out: str, largest: bool, key: str = "coin_id") -> DataFrame:
    """``already``, and as many more of the largest (smallest) others as make int(rows x share) in all."""
    n = df.agg(F.count("*").alias("n"), F.count_if(already).alias("a")).first()
    more = int(n["n"] * share) - n["a"]
    if more <= 0:
        return df.withColumn(out, already.cast("int"))
    best = highest(df.where(~already).select(column, key), column, more, [key], largest).select(key, F.lit(1).alias("_m"))
    return df.join(best, key, "left").withColumn(out, (already | F.col("_m").isNotNull()).cast("int")).drop("_m")


def moon_crater(returns: DataFrame, moon: float, crater: float, min_moon: float, min_crater: float) -> DataFrame:
    c = F.col("coin_return")
    return fill_up(fill_up(returns, "coin_return", c >= moon, min_moon, "is_moon", True), "coin_return", c <= crater, min_crater, "is_crater", False)


def window_targets(market: DataFrame, starts: Sequence[str], days: int) -> DataFrame:
    """Returns for every time window in one pass."""
    spark = market.sparkSession
    t = spark.createDataFrame([(s,) for s in starts], "w string").select(F.to_date("w").alias("time_window"), F.date_add(F.to_date("w"), days).alias("_e"))
    rows = market.join(F.broadcast(t), (F.col("date") == F.col("time_window")) | (F.col("date") == F.col("_e")))
    g = rows.groupBy("time_window", "coin_id").agg(F.max(F.when(F.col("date") == F.col("time_window"), F.col("price"))).alias("s"), F.max(F.when(F.col("date") == F.col("_e"), F.col("price"))).alias("e"))
    return g.select("time_window", "coin_id", (F.try_divide(F.col("e"), F.col("s")) - 1).alias("coin_return"))


def coin_targets(market: DataFrame, start, end, cutoff: float) -> DataFrame:
    """Return, winsorized return and percent rank of the assets that have one."""
    r = coin_performance(market, start, end).where("coin_return is not null").withColumn("coin_return_winsorized", F.col("coin_return"))
    return pct_rank(winsorize(r, ["coin_return_winsorized"], cutoff), "coin_return", "coin_return_pctile")


def select_target(column: str, low: float | None = None, high: float | None = None, loss: float | None = None, win: float | None = None) -> Column:
    """1 within the band, both ends included, else 0; or, with loss and win, 0 below loss, 2 from win up, else 1."""
    c = F.col(column)
    if win is not None:
        return F.when(c < loss, 0).when(c >= win, 2).otherwise(1)
    ok = F.lit(True)
    ok = ok & (c >= low) if low is not None else ok
    ok = ok & (c <= high) if high is not None else ok
    return ok.cast("int")


# splits


def _order(keys: Sequence[str], seed: int) -> Column:
    """An order that looks random and that SQL can repeat: a multiplicative hash of the number that the key ends in."""
    return (F.pmod(F.col(keys[0]).cast("long"), F.lit(1 << 31)) * 2654435761 + F.lit(seed)) % (1 << 32)


def future_split(df: DataFrame, n: int) -> DataFrame:
    """is_future: whether the row is of one of the last n time windows."""
    last = df.select("time_window").distinct().orderBy(F.desc("time_window")).limit(n).select("time_window", F.lit(True).alias("_f"))
    return df.join(F.broadcast(last), "time_window", "left").withColumn("is_future", F.coalesce("_f", F.lit(False))).drop("_f")


def share_split(df: DataFrame, key: str, share: float, out: str, seed: int = 0) -> DataFrame:
    """Whole keys, round(share x keys) of them, in hash order."""
    keys = settled(df.select(key).distinct().withColumn("_h", _order([key], seed)))
    chosen = highest(keys, "_h", round(keys.count() * share), [key], largest=False).select(key, F.lit(True).alias(out))
    return df.join(chosen, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def stratified_split(df: DataFrame, key: str, stratum: str, shares: Mapping[str, float], rest: str, seed: int = 0) -> DataFrame:
    """A column split: of each stratum, round(share x rows) to each named split in turn, by hash order, the rest to ``rest``.
    Shares are of the original count. Rows are ranked in ranges of their hash, so that a stratum isn't one task's."""
    cut = df.withColumn("_h", _order([key], seed)).withColumn("_b", F.shiftright("_h", 22))
    sizes = cut.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))  # 1,024 rows a stratum at most
    w = Window.partitionBy(stratum)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(stratum).alias("_s"), F.col("_b").alias("_b2"), before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    df = cut.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2"))).drop("_s", "_b2")
    k = F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key))
    out, run = None, F.lit(0)
    for name, share in shares.items():
        run = run + F.bround(F.col("_n") * share)
        out = F.when(F.col("_k") <= run, name) if out is None else out.when(F.col("_k") <= run, name)
    return df.withColumn("_k", k).withColumn("split", out.otherwise(rest)).drop("_n", "_k", "_h", "_b", "_before")


# preprocessing


def scale(df: DataFrame, train: DataFrame, how: Mapping[str, str]) -> DataFrame:
    """standard (population deviation), minmax, log1p or none by column; fitted on ``train``, one pass for all columns."""
    fit = {c: k for c, k in how.items() if k in ("standard", "minmax")}
    f = train.agg(*[x for c in fit for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"), F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b"))]).first() if fit else {}
    new = {}
    for c, k in how.items():
        if k == "log1p":
            new[c] = F.log1p(c)
        elif k in ("standard", "minmax"):
            at, width = (f[f"{c}_m"], f[f"{c}_s"]) if k == "standard" else (f[f"{c}_a"], (f[f"{c}_b"] or 0) - (f[f"{c}_a"] or 0))
            new[c] = (F.col(c) - F.lit(at)) / F.lit(float(width or 1.0))
        elif k != "none":
            raise ValueError(f"no such scaling: {k}")
    return df.withColumns(new)


def one_hot(df: DataFrame, train: DataFrame, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    """A 0/1 column for each value of ``train``; unknown values are 0 in all. More than CATEGORIES values are an error."""
    for c in columns:
        values = sorted(r[0] for r in train.select(c).distinct().where(F.col(c).isNotNull()).limit(CATEGORIES + 1).collect())
        if len(values) > CATEGORIES:
            raise ValueError(f"{c} has more than {CATEGORIES} values")
        df = df.withColumns({f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("int") for v in values[1 if drop_first else 0 :]}).drop(c)
    return df


def sameness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share) of each column's most frequent value among all rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    top = long.groupBy("column", "value").count().groupBy("column").agg(F.max("count").alias("n"))
    return top.crossJoin(df.agg(F.count("*").alias("rows"))).select("column", (F.col("n") / F.col("rows")).alias("share"))


def low_variance(df: DataFrame, columns: Sequence[str], limit: float, protected: Sequence[str] = (), scaled: bool = True) -> list[str]:
    """Columns whose variance is at most the limit; prefixes in ``protected`` stay. ``scaled`` takes the variance of the
    values in units of their own deviation (about 1, and none for a constant column), else of the values as they are.
    Columns without a variance stay."""
    v = df.agg(*[F.struct(F.var_samp(c), F.var_pop(c)).alias(c) for c in columns]).first()
    seen = {c: (v[c][0] / v[c][1] if v[c][1] else None) if scaled and v[c][0] is not None else v[c][0] for c in columns}
    return [c for c in columns if not c.startswith(tuple(protected)) and seen[c] is not None and seen[c] <= limit]


#: Columns on each side of a block of column pairs, and blocks whose sums a task holds at once, of 0.8 MB each.
SIDE, BLOCKS = 128, 32


def _products(blocks: list[tuple[int, int]], parts: dict[int, tuple[list[str], np.ndarray]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By block of column pairs, over rows where both are there: their number, sums, sums of squares, and of products."""
    total = {b: np.zeros((6, len(parts[b[0]][0]), len(parts[b[1]][0]))) for b in blocks}
    for pdf in batches:
        x, m = {}, {}
        for k, (columns, middle) in parts.items():
            v = pdf[columns].to_numpy(np.float64) - middle
            m[k] = (~np.isnan(v)).astype(np.float64)
            x[k] = np.where(m[k] > 0, v, 0.0)
        for i, j in blocks:
            total[i, j] += np.stack([m[i].T @ m[j], x[i].T @ m[j], m[i].T @ x[j], (x[i] * x[i]).T @ m[j], m[i].T @ (x[j] * x[j]), x[i].T @ x[j]])
    for (i, j), t in total.items():
        yield pd.DataFrame({"i": [i], "j": [j], "width": [t.shape[2]], "sums": [t.tobytes()]})


def _links(limit: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        count, a, b, aa, bb, ab = np.sum([np.frombuffer(x) for x in pdf["sums"]], 0).reshape(6, -1, int(pdf["width"].iloc[0]))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(count > 1, (ab - a * b / count) / np.sqrt((aa - a * a / count) * (bb - b * b / count)), np.nan)
        i, j = np.nonzero(np.abs(r) > limit)
        found = pd.DataFrame({"a": i + key[0] * SIDE, "b": j + key[1] * SIDE, "r": r[i, j]})
        return found[found["a"] < found["b"]] if limit >= 0 else found

    return links


def correlation_links(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    """(a, b, r): numbers of the columns, a before b, whose correlation over the rows where both are there lies beyond the
    limit, either sign; below 0 as a limit gives all pairs, a column's with itself too. Tasks add up sums of products by block of column pairs, BLOCKS of them in one pass and as many
    passes as it takes; only the links of a block leave it, so no one holds the whole matrix."""
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = settled(rows) if len(columns) > SIDE else rows
    means = rows.agg(*[F.avg(c) for c in rows.columns]).first()
    parts = {k: (rows.columns[at : at + SIDE], np.array([x or 0.0 for x in means[at : at + SIDE]])) for k, at in enumerate(range(0, len(columns), SIDE))}
    blocks = [(i, j) for i in parts for j in parts if i <= j]
    found = None
    for at in range(0, len(blocks), BLOCKS):
        now = blocks[at : at + BLOCKS]
        used = {k: parts[k] for k in sorted({k for b in now for k in b})}
        sums = rows.select(*[c for names, _ in used.values() for c in names]).mapInPandas(partial(_products, now, used), "i int, j int, width int, sums binary")
        links = sums.groupBy("i", "j").applyInPandas(_links(limit), "a int, b int, r double")
        found = links if found is None else found.unionAll(links)
    return found


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The whole matrix of a report on a few columns, NaN without two rows that have both or without a spread."""
    out = np.full((len(columns), len(columns)), np.nan)
    for r in correlation_links(df, columns, -1.0).collect():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["r"]
    return out


def correlated(df: DataFrame, columns: Sequence[str], limit: float, protected: Sequence[str] = ()) -> list[str]:
    """Columns that correlate beyond the limit with one before them; prefixes in ``protected`` stay."""
    if len(columns) < 2:
        return []
    late = {r["b"] for r in correlation_links(df, columns, limit).select("b").distinct().collect()}  # numbers of columns
    return [c for i, c in enumerate(columns) if i in late and not c.startswith(tuple(protected))]


def wallet_targets(cohort: DataFrame, features: DataFrame) -> DataFrame:
    """The modeling period's figures for every wallet of the cohort, 0 where it wasn't active."""
    return cohort.select("wallet_address").distinct().join(features, "wallet_address", "left").na.fill(0, [c for c in features.columns if c != "wallet_address"])


def pair_targets(pairs: DataFrame, returns: DataFrame, cutoff: float) -> DataFrame:
    """The asset's return on each pair, 0 where unknown; winsorized, and as a percent rank."""
    rows = pairs.join(returns.select("coin_id", "coin_return"), "coin_id", "left").na.fill(0.0, ["coin_return"])
    rows = winsorize(rows.withColumn("coin_return_winsorized", F.col("coin_return")), ["coin_return_winsorized"], cutoff)
    return pct_rank(rows, "coin_return", "coin_return_pctile")


def preprocess(splits: Mapping[str, DataFrame], categorical: Sequence[str], dropped: Sequence[str], same_share: float, how: Mapping[str, str]) -> dict[str, DataFrame]:
    """Every split encoded, cut and scaled as the train split says: encode, drop by list, drop too uniform columns, scale."""
    train = splits["train"]
    if not train.limit(1).collect():
        raise ValueError("the train split is empty")
    encoded = {n: one_hot(d, train, categorical).drop(*dropped) for n, d in splits.items()}
    base = encoded["train"]
    same = [r["column"] for r in sameness(base, [c for c in how if c in base.columns]).where(F.col("share") > same_share).collect()]
    kept = {n: d.drop(*same) for n, d in encoded.items()}
    rules = {c: k for c, k in how.items() if c not in same and c in base.columns}
    return {n: scale(d, kept["train"], rules) for n, d in kept.items()}


def modeling_cohort(features: DataFrame, targets: DataFrame, inflow: str, min_inflow: float, coins: str, max_coins: int) -> DataFrame:
    """Feature rows of the wallets whose target figures lie within the limits."""
    ok = targets.where((F.col(inflow) >= min_inflow) & (F.col(coins) <= max_coins)).select("wallet_address")
    return features.join(ok, "wallet_address", "left_semi")

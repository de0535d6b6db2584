"""Quality checks that are one aggregation each. The table forms return what is wrong; ``require`` raises on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require(bad: DataFrame, what: str) -> None:
    """Raise if there are any rows of offences."""
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def period_facts(df: DataFrame, start, end) -> DataFrame:
    """One row: what a period ledger must have, as counts of offences."""
    s, e = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    d = F.col("date")
    return df.agg(
        (F.min("date") == F.date_sub(s, 1)).alias("starts"), (F.max("date") == e).alias("ends"), F.count_if(F.col("coin_id").isNull() | F.col("wallet_address").isNull()).alias("null_ids"),
        F.count_if(F.col("is_imputed") & (d != F.date_sub(s, 1)) & (d != e)).alias("imputed_inside"),
        F.count_if((d == F.date_sub(s, 1)) & ((F.col("usd_net_transfers") != 0) | (F.col("usd_inflows") != 0) | ~F.col("is_imputed"))).alias("bad_opening"),
    )


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of the two has, with the side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("right")))


def column_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    return {"missing": [c for c in a.columns if c not in b.columns], "extra": [c for c in b.columns if c not in a.columns], "moved": [] if set(a.columns) != set(b.columns) else [c for c, d in zip(a.columns, b.columns, strict=True) if c != d]}


def interior_nulls(df: DataFrame, column: str, key: str = "coin_id") -> DataFrame:
    """Series with NULLs between their first and last value, and how many."""
    w = Window.partitionBy(key)
    has = F.when(F.col(column).isNotNull(), F.col("date"))
    rows = df.withColumn("_a", F.min(has).over(w)).withColumn("_b", F.max(has).over(w))
    return rows.where(F.col(column).isNull() & F.col("date").between(F.col("_a"), F.col("_b"))).groupBy(key).agg(F.count("*").alias("nulls"))


def calendar_gaps(df: DataFrame, end, key: str = "coin_id") -> DataFrame:
    """Series that lack days or don't end on ``end``."""
    g = df.groupBy(key).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("days"))
    missing = (F.datediff("last", "first") + 1 - F.col("days")).alias("missing")
    return g.select(key, "last", missing.cast("long")).where((F.col("missing") > 0) | (F.col("last") != F.lit(str(end)).cast("date")))


def staleness(df: DataFrame, lookback: int) -> DataFrame:
    """One row: assets with imputed prices on the last day against the fewest in the days before."""
    daily = df.groupBy("date").agg(F.count_if(F.col("days_imputed").isNotNull()).alias("n"))
    last = df.agg(F.max("date").alias("last"))
    rows = daily.crossJoin(F.broadcast(last)).where(F.col("date") >= F.date_sub("last", lookback))
    return rows.agg(F.max_by("n", "date").alias("latest"), F.min("n").alias("least")).withColumn("increase", F.col("latest") - F.col("least")).withColumn("increase_share", F.try_divide(F.col("increase").cast("double"), F.col("least").cast("double")))


def coverage(df: DataFrame, lookback: int) -> DataFrame:
    """One row: distinct assets transferred on the last day against the most in the days before; the drop is a share."""
    daily = df.groupBy("date").agg(F.countDistinct("coin_id").alias("n"))
    last = df.agg(F.max("date").alias("last"))
    rows = daily.crossJoin(F.broadcast(last)).where(F.col("date") >= F.date_sub("last", lookback))
    return rows.agg(F.max_by("n", "date").alias("latest"), F.max("n").alias("most")).withColumn("drop_share", F.try_divide((F.col("most") - F.col("latest")).cast("double"), F.col("most").cast("double")))


def series_gaps(df: DataFrame) -> DataFrame:
    """One row: the longest distance in days between neighbours of a date-only series (a few thousand rows at most)."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return df.withColumn("gap", F.datediff("date", F.lag("date").over(w))).agg(F.max("gap").cast("long").alias("longest"), F.count_if(F.col("gap") > 6).alias("too_long"))


def feature_input(ledger: DataFrame, prices: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row: duplicate keys, (asset, day) without a price, and the share of wallets with a first transfer."""
    keys = ["coin_id", "wallet_address", "date"]
    twice = ledger.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicates"))
    bare = ledger.select("coin_id", "date").distinct().join(prices, ["coin_id", "date"], "left_anti").agg(F.count("*").alias("unpriced"))
    wallets = ledger.select("wallet_address").distinct()
    share = wallets.join(transfers.select("wallet_address", F.lit(1).alias("x")).distinct(), "wallet_address", "left").agg(F.round(F.count("x") / F.count(F.lit(1)), 6).alias("covered"))
    return twice.crossJoin(bare).crossJoin(share)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for all columns by one aggregation."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("x")).select("x.*")


def rows_with_nulls(df: DataFrame) -> DataFrame:
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def offences(df: DataFrame, nonnegative: Sequence[str] = ()) -> DataFrame:
    """(column, negatives, nulls, infinities) of the number columns."""
    cols = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
    dbl = {c: F.col(c).cast("double") for c in cols}
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if((F.col(c) < 0) & F.lit(c in nonnegative)).alias("negatives"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.isnan(dbl[c]) | (F.abs(dbl[c]) == float("inf"))).alias("infinities")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*cols)).alias("x")).select("x.*")


def conservation(windows: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: the sum of absolute transfers over all windows and over the whole period."""
    total = lambda x, n: x.agg(F.round(F.sum(F.abs("usd_net_transfers")), 2).alias(n))
    return total(windows, "windows").crossJoin(total(whole, "whole"))


def scenario_bounds(actual: DataFrame, ideal: DataFrame, worst: DataFrame, column: str = "net_gain") -> DataFrame:
    """One row: wallets whose actual figure is above the ideal or below the worst one by more than 0.01 % or 0.01."""
    pick = lambda x, n: x.select("wallet_address", F.col(column).alias(n))
    slack = F.greatest(F.abs("a") * 0.0001, F.lit(0.01))
    rows = pick(actual, "a").join(pick(ideal, "i"), "wallet_address").join(pick(worst, "w"), "wallet_address")
    return rows.agg(F.count("*").alias("wallets"), F.count_if(F.col("a") > F.col("i") + slack).alias("above_ideal"), F.count_if(F.col("a") < F.col("w") - slack).alias("below_worst"))


def model_input(x: DataFrame, y: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """One row: rows, keys on one side only, duplicate keys, columns that aren't numbers, and the commonest target's share."""
    numbers = [c for c, t in x.dtypes if c not in keys and t not in ("double", "float", "bigint", "int", "boolean", "smallint", "tinyint")]
    alone = key_difference(x, y, keys).agg(F.count("*").alias("unmatched"))
    twice = x.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicates"))
    share = y.groupBy(target).count().agg((F.max("count") / F.sum("count")).alias("commonest_share"))
    return x.agg(F.count("*").alias("rows")).crossJoin(alone).crossJoin(twice).crossJoin(share).withColumn("not_numbers", F.lit(len(numbers)))

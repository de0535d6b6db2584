"""Cleaning, gap filling and imputation of market series and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions import expr

PAIR = ["coin_id", "wallet_address"]


def period(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    """Rows from start to end, both included."""
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def coverage_split(df: DataFrame, start, end, key: str | None = "coin_id", trim: bool = False) -> tuple[DataFrame, DataFrame]:
    """(full, partial): series that reach from start to end, and the others. Without a key the frame is one series."""
    keys = [key] if key else []
    span = df.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    full = span.where((F.col("a") <= F.lit(start).cast("date")) & (F.col("b") >= F.lit(end).cast("date"))).select(*keys)
    rows = period(df, start, end) if trim else df
    if not key:
        n = full.count()
        return rows.where(F.lit(n > 0)), rows.where(F.lit(n == 0))
    return rows.join(full, key, "left_semi"), rows.join(full, key, "left_anti")


def clean_market(df: DataFrame, max_gap_days: int, min_volume: float, start=None, end=None) -> DataFrame:
    """Without the assets that inside the range have a longer imputed gap or a lower mean volume; no lineage column."""
    rows = period(df, start, end) if start else df
    bad = rows.groupBy("coin_id").agg(F.max("days_imputed").alias("gap"), F.avg("volume").alias("v")).where((F.coalesce("gap", F.lit(0)) > max_gap_days) | (F.col("v") < min_volume))
    return rows.join(bad, "coin_id", "left_anti").drop("days_imputed")


def densify(df: DataFrame, keys: Sequence[str] = (), end=None, start=None) -> DataFrame:
    """A row for every day from each series' first (or ``start``) to its last (or ``end``); values carried forward."""
    span = df.groupBy(*keys).agg(F.coalesce(F.lit(start).cast("date"), F.min("date")).alias("a"), F.coalesce(F.lit(end).cast("date"), F.max("date")).alias("b"))
    days = span.where("a <= b").select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    values = [c for c in df.columns if c not in (*keys, "date")]
    return days.join(df, [*keys, "date"], "left").select(*keys, "date", *[F.last(c, True).over(w).alias(c) for c in values])


def impute_market_cap(df: DataFrame, min_coverage: float, max_multiple: float) -> DataFrame:
    """market_cap_imputed: for assets whose caps cover at least ``min_coverage`` of the rows but not all, the cap to price
    ratio is carried backward, then forward, and gives the missing caps; whatever exceeds the largest known cap by more
    than ``max_multiple`` is NULL."""
    w = Window.partitionBy("coin_id").orderBy("date")
    every = Window.partitionBy("coin_id")
    cover = F.count("market_cap").over(every) / F.count(F.lit(1)).over(every)
    known = F.try_divide(F.col("market_cap"), F.col("price"))
    back = F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    forth = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_r", known).withColumn("_c", cover).withColumn("_m", F.max("market_cap").over(every)).withColumn("_f", F.coalesce(back, forth))
    filled = F.when((F.col("_c") >= min_coverage) & (F.col("_c") < 1), F.coalesce("market_cap", F.bround(F.col("price") * F.col("_f")).cast("long"))).otherwise(F.col("market_cap"))
    return rows.withColumn("market_cap_imputed", F.when(filled <= F.col("_m") * max_multiple, filled)).drop("_r", "_c", "_m", "_f")


def force_fill(df: DataFrame, column: str, out: str, default: float, key: str = "coin_id") -> DataFrame:
    """Carried backward, then forward; ``default`` for series without any value."""
    w = Window.partitionBy(key).orderBy("date")
    return df.withColumn(out, F.coalesce(F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))


def market_chain(df: DataFrame, max_gap_days: int, min_volume: float, min_coverage: float, max_multiple: float, default_cap: float, start, end, cap_start: tuple | None = None, cap_end: tuple | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """Cleaning (unless a cohort of assets is given), cap imputation, filling, then limits on the first and last day's cap."""
    rows = clean_market(df, max_gap_days, min_volume, start, end) if cohort is None else period(df, start, end).join(cohort, "coin_id", "left_semi").drop("days_imputed")
    rows = force_fill(impute_market_cap(rows, min_coverage, max_multiple), "market_cap_imputed", "market_cap_filled", default_cap)
    for day, limits in ((start, cap_start), (end, cap_end)):
        if limits:
            bad = rows.where((F.col("date") == F.lit(day).cast("date")) & ~F.col("market_cap_filled").between(*limits)).select("coin_id").distinct()
            rows = rows.join(bad, "coin_id", "left_anti")
    return rows


def clean_ledger(df: DataFrame, max_wallet_inflows: float) -> tuple[DataFrame, DataFrame]:
    """(ledger, exclusions): wallets whose last cumulative inflows, over all assets, reach the limit are taken out."""
    last = df.groupBy(*PAIR).agg(F.max_by("usd_inflows_cumulative", "date").alias("v"))
    out = last.groupBy("wallet_address").agg(expr.exact_sum("v").alias("total_inflows")).where(F.col("total_inflows") >= max_wallet_inflows)
    return df.join(out, "wallet_address", "left_anti"), out


def impute_rows(ledger: DataFrame, prices: DataFrame, dates: Sequence) -> DataFrame:
    """As-of rows: for each date and pair with an earlier row but none on it, one row valued at that day's price.

    A row stands for its pair until the pair's next one, so it gives a row for each of the dates in between: one window
    over the pair serves all dates, and the ledger isn't multiplied by them. Without a price on both days there is no row.
    """
    days = F.array(*[F.lit(str(d)).cast("date") for d in dates])
    after = F.lead("date").over(Window.partitionBy(*PAIR).orderBy("date"))
    keep = ["usd_balance", "profits_cumulative", "usd_inflows_cumulative"]
    between = F.filter("_days", lambda t: (t > F.col("d0")) & (F.col("_next").isNull() | (t < F.col("_next"))))
    rows = ledger.select(*PAIR, F.col("date").alias("d0"), F.struct(*keep).alias("last"), after.alias("_next"), days.alias("_days"))
    asof = rows.select(*PAIR, "d0", "last", F.explode(between).alias("date"))
    now = prices.select("coin_id", "date", F.col("price").alias("p1"))
    then = prices.select("coin_id", F.col("date").alias("d0"), F.col("price").alias("p0"))
    priced = asof.join(now, ["coin_id", "date"]).join(then, ["coin_id", "d0"])
    change = F.try_divide(F.col("p1"), F.col("p0"))
    return priced.select(
        *PAIR, "date", F.lit(0.0).alias("usd_net_transfers"), (F.col("last.usd_balance") * change).alias("usd_balance"), F.lit(0.0).alias("usd_inflows"),
        F.col("last.usd_inflows_cumulative").alias("usd_inflows_cumulative"), (F.col("last.profits_cumulative") + (change - 1) * F.col("last.usd_balance")).alias("profits_cumulative"), F.lit(True).alias("is_imputed"),
    )


def with_imputed(ledger: DataFrame, prices: DataFrame, dates: Sequence) -> DataFrame:
    return ledger.unionByName(impute_rows(ledger, prices, dates))


def normalise_opening(df: DataFrame, day) -> DataFrame:
    """Rows on the opening day count as imputed, without transfers."""
    at = F.col("date") == F.lit(day).cast("date")
    return df.withColumns({"usd_net_transfers": F.when(at, 0.0).otherwise(F.col("usd_net_transfers")), "usd_inflows": F.when(at, 0.0).otherwise(F.col("usd_inflows")), "is_imputed": at | F.col("is_imputed")})


def format_ledger(ledger: DataFrame, prices: DataFrame, opening, start, end, max_wallet_inflows: float) -> DataFrame:
    """The ledger of a period: as-of rows on both ends, opening normalised, large wallets out, rounded, no empty rows."""
    rows = period(with_imputed(ledger, prices, [opening, end]), opening, end)
    rows, _ = clean_ledger(normalise_opening(rows, opening), max_wallet_inflows)
    money = [c for c in rows.columns if c.startswith("usd_") or c == "profits_cumulative"]
    rows = rows.withColumns({c: expr.tidy(c) for c in money})
    return rows.where(~((F.col("usd_balance") == 0) & (F.col("usd_net_transfers") == 0)))


def split_windows(ledger: DataFrame, starts: Sequence, end) -> DataFrame:
    """Rows with the window they belong to: window k runs from the day before its start to the day before the next start;
    a border row closes one window and opens, normalised, the next."""
    spark = ledger.sparkSession
    rows = [(i + 1, str(a), str(b) if b else None) for i, (a, b) in enumerate(zip(starts, [*starts[1:], None], strict=True))]
    t = spark.createDataFrame(rows, "window_id int, s string, n string").select("window_id", F.date_sub(F.to_date("s"), 1).alias("open"), F.coalesce(F.date_sub(F.to_date("n"), 1), F.lit(str(end)).cast("date")).alias("close"))
    both = ledger.join(F.broadcast(t), F.col("date").between(F.col("open"), F.col("close")))
    at = F.col("date") == F.col("open")
    return both.withColumns({"usd_net_transfers": F.when(at, 0.0).otherwise(F.col("usd_net_transfers")), "usd_inflows": F.when(at, 0.0).otherwise(F.col("usd_inflows")), "is_imputed": at | F.col("is_imputed")}).drop("open", "close")


def epoch_slice(ledger: DataFrame, prices: DataFrame, opening, end, min_inflows: float) -> DataFrame:
    rows = period(with_imputed(ledger, prices, [opening, end]), opening, end)
    enough = rows.where(F.col("date") == F.lit(end).cast("date")).where(F.col("usd_inflows_cumulative") >= min_inflows).select(*PAIR)
    return rows.join(enough, PAIR, "left_semi")


def grid_fill(df: DataFrame, end, carried: Sequence[str], flows: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every asset on every day from the first day of all to ``end``: stocks are carried forward, then 0; flows are 0."""
    last = end if isinstance(end, Column) else F.lit(str(end)).cast("date")
    days = df.groupBy(*keys).agg(F.min("date").alias("a")).select(*keys, F.explode(F.sequence("a", last)).alias("date"))
    coins = df.select(*keys, "coin_id").distinct()
    grid = coins.join(F.broadcast(days), list(keys)) if keys else coins.crossJoin(F.broadcast(days))  # a row for each day
    w = Window.partitionBy(*keys, "coin_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    kept = [F.coalesce(F.last(c, True).over(w), F.lit(0.0)).alias(c) for c in carried]
    return grid.join(df, [*keys, "coin_id", "date"], "left").select(*keys, "coin_id", "date", *kept, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in flows])


def scan_ledger(ledger: DataFrame, prices: DataFrame, start, end, min_inflows: float) -> DataFrame:
    """Rows of the period, with an opening row for pairs that have none on its first day, of the pairs with enough inflows."""
    kept = ledger.where(F.col("date") <= F.lit(end).cast("date"))
    enough = kept.groupBy(*PAIR).agg(F.max("usd_inflows_cumulative").alias("m")).where(F.col("m") >= min_inflows)
    kept = kept.join(enough, PAIR, "left_semi")
    return period(with_imputed(kept, prices, [start]), start, end).withColumn("usd_inflows", F.when(F.col("usd_inflows") > 0, F.greatest("usd_inflows", F.lit(0.01))).otherwise(F.col("usd_inflows")))


def wallet_cohort(metrics: DataFrame, limits: dict) -> DataFrame:
    """Wallets within seven limits; an investment or gain at its upper limit is out, a volume or number of coins isn't."""
    m, x = F.col, limits
    return metrics.where(
        (m("max_investment") >= x["min_investment"]) & (m("max_investment") < x["max_investment"]) & (m("unique_coins_traded") >= x["min_coins"]) & (m("unique_coins_traded") <= x["max_coins"])
        & (m("total_volume") >= x["min_volume"]) & (m("total_volume") <= x["max_volume"]) & (F.abs("net_gain") < x["max_gain"])
    )


def imputation_dates(start: str, end: str, window_starts: Sequence[str] = (), lookbacks: Sequence[str] = ()) -> list[str]:
    """Days that need as-of rows: the day before the period, its end, the day before each window but the first, and the
    starts of cohort look-backs."""
    from datetime import date, timedelta

    before = lambda d: str(date.fromisoformat(d) - timedelta(1))
    return sorted({before(start), end, *map(before, window_starts[1:]), *lookbacks})


def cohort_rows(df: DataFrame, cleaned: DataFrame, key: str = "coin_id") -> DataFrame:
    """Rows of the assets that are left after cleaning, for this or any later period."""
    return df.join(cleaned.select(key).distinct(), key, "left_semi")

"""Cohorts, segments, and wallet metrics flattened to assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.functions.order import numbered, quantiles, settled, with_quantiles
from flowledger.operators.cleaning import grid_fill

PAIR = ["coin_id", "wallet_address"]


def classify_cohort(ledger: DataFrame, min_inflows: float, max_inflows: float, profit_win: float, return_win: float, min_wins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Wallets whose inflows, summed over rows, are in the range: assets, profits, wins, and whether they are in the cohort.

    A pair wins if its last profit and its last return reach their limits. A row's return is the profit so far over that
    row's own inflow: without an inflow a profit is beyond every limit, a loss below, and 0 is no return at all.
    """
    p, i = F.col("profits_cumulative"), F.col("usd_inflows")
    ret = F.when(i != 0, p / i).when(p > 0, float("inf")).when(p < 0, float("-inf"))
    pair = ledger.groupBy(*keys, "wallet_address", "coin_id").agg(F.max_by(p, "date").alias("p"), expr.exact_sum(i).alias("i"), F.max_by(ret, F.when(ret.isNotNull(), F.col("date"))).alias("r"))
    win = (F.col("p") >= profit_win) & (F.col("r") >= return_win)
    w = pair.groupBy(*keys, "wallet_address").agg(expr.exact_sum("i").alias("total_inflows"), F.count("*").alias("total_coins"), F.count_if(win).alias("winning_coins"), F.sum("p").alias("total_profits"))
    w = w.where(F.col("total_inflows").between(min_inflows, max_inflows))
    return w.withColumns({"return_rate": expr.try_ratio("total_profits", "total_inflows"), "in_cohort": F.col("winning_coins") >= min_wins})


def activity(ledger: DataFrame, end, keys: Sequence[str] = ()) -> DataFrame:
    """Per asset and day: buyers and sellers, new and repeat, flows and holders, on a full grid of days. With ``keys``, such as
    a window, each is a ledger of its own, and ``end`` may be a column of them."""
    w = Window.partitionBy(*keys, *PAIR).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("usd_net_transfers")
    rows = ledger.withColumn("nb", F.when(t > 0, F.count_if(t > 0).over(w))).withColumn("ns", F.when(t < 0, F.count_if(t < 0).over(w)))
    daily = rows.groupBy(*keys, "coin_id", "date").agg(
        F.count_if(F.col("nb") == 1).alias("buyers_new"), F.count_if(F.col("nb") > 1).alias("buyers_repeat"), F.count("nb").alias("total_buyers"),
        F.count_if(F.col("ns") == 1).alias("sellers_new"), F.count_if(F.col("ns") > 1).alias("sellers_repeat"), F.count("ns").alias("total_sellers"),
        F.sum(expr.positive(t)).alias("total_bought"), F.sum(expr.negative(t)).alias("total_sold"), F.sum(t).alias("total_net_transfers"), F.sum(F.abs(t)).alias("total_volume"),
        F.countDistinct("wallet_address").cast("double").alias("total_holders"), F.sum("usd_balance").alias("total_balance"),
    )
    flows = [c for c in daily.columns if c not in (*keys, "coin_id", "date", "total_holders", "total_balance")]
    return grid_fill(daily, end, ["total_balance", "total_holders"], flows, keys)


#: Chains that become columns of their own at most.
CHAINS = 1_000


def metadata_flags(meta: DataFrame, categories: Sequence[str], chain_threshold: int) -> DataFrame:
    """One boolean for each category, each chain with enough assets, and the other chains; case doesn't matter. More than
    CHAINS such chains are an error."""
    lower = F.transform("categories", F.lower)
    chain = F.lower("chain")
    known = sorted(r["c"] for r in meta.groupBy(chain.alias("c")).count().where((F.col("count") >= chain_threshold) & F.col("c").isNotNull()).select("c").limit(CHAINS + 1).collect())
    if len(known) > CHAINS:
        raise ValueError(f"more than {CHAINS} chains have {chain_threshold} assets")
    flags = [F.coalesce(F.array_contains(lower, c.lower()), F.lit(False)).alias(f"category_{c.lower()}") for c in categories]
    flags += [F.coalesce(chain == c, F.lit(False)).alias(f"chain_{c}") for c in known]
    return meta.select("coin_id", *flags, (~F.coalesce(chain.isin(known), F.lit(False))).alias("chain_other"))


def facts(meta: DataFrame, chains: Sequence[str], word: str) -> DataFrame:
    """Chains outside the list as Other, one boolean for each, and whether the description has the word."""
    c = F.when(F.col("chain").isin(*chains), F.col("chain")).otherwise("Other")
    rows = meta.withColumn("blockchain", c).withColumn("described", F.coalesce(F.upper("description").like(f"%{word.upper()}%"), F.lit(False)))
    return rows.select("coin_id", "described", *[(F.col("blockchain") == x).alias(f"blockchain/{x}") for x in [*chains, "Other"]])


def quantile_edges(df: DataFrame, column: str, cuts: Sequence[float]) -> list[float]:
    """Exact quantiles, for a few cuts."""
    return quantiles(df, [column], cuts).get(column, [])


def quantile_labels(cuts: Sequence[float]) -> list[str]:
    ends = [0.0, *cuts, 1.0]
    return [f"{int(a * 100)}_{int(b * 100)}pct" for a, b in zip(ends, ends[1:], strict=False)]


def quantile_buckets(df: DataFrame, column: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Buckets closed on the right; buckets between equal edges are merged and named by their outer ends."""
    edges, labels = quantile_edges(df, column, cuts), quantile_labels(cuts)
    kept: list[tuple[float, str]] = []
    for e, label in zip(edges, labels, strict=False):
        if kept and kept[-1][0] == e:
            kept[-1] = (e, kept[-1][1].split("_")[0] + "_" + label.split("_")[1])
        else:
            kept.append((e, label))
    c = F.col(column)
    expr_: Column | None = None
    for e, label in kept:
        expr_ = F.when(c <= e, label) if expr_ is None else expr_.when(c <= e, label)
    return df.withColumn(out, F.when(c.isNotNull(), expr_.otherwise(labels[-1])))


def rule_segment(rules: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """1 where every column lies within its limits, else 0."""
    ok = F.lit(True)
    for c, (low, high) in rules.items():
        if low is not None:
            ok = ok & (F.col(c) >= low)
        if high is not None:
            ok = ok & (F.col(c) <= high)
    return F.coalesce(ok, F.lit(False)).cast("int")


def pair_balances(ledger: DataFrame, start, end) -> DataFrame:
    """Balance of each pair on the first and the last day, 0 without a row."""
    on = lambda d: F.coalesce(F.max(F.when(F.col("date") == F.lit(str(d)).cast("date"), F.col("usd_balance"))), F.lit(0.0))
    return ledger.groupBy(*PAIR).agg(on(start).alias("balance_start"), on(end).alias("balance_end"))


def _long(pairs: DataFrame, segments: DataFrame, metrics: Sequence[str], families: Sequence[str]) -> DataFrame:
    rows = pairs.join(segments, "wallet_address")
    m = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in metrics])).alias("m")
    s = F.explode(F.array(*[F.struct(F.lit(x).alias("family"), F.col(x).cast("string").alias("segment")) for x in families])).alias("s")
    cols = [c for c in ("score",) if c in rows.columns]
    return rows.select("coin_id", "wallet_address", *cols, *metrics, *families).select("coin_id", "wallet_address", *cols, m, *families).select("coin_id", "wallet_address", *cols, "m.*", s).select("coin_id", "wallet_address", *cols, "metric", "value", "s.*").where("segment is not null")


def segment_aggregates(pairs: DataFrame, segments: DataFrame, metrics: Sequence[str], families: Sequence[str]) -> DataFrame:
    """Long form (coin, family, segment, metric): sum, count, mean, median, std and share of the asset's total."""
    rows = settled(_long(pairs, segments, metrics, families))
    g = rows.groupBy("coin_id", "family", "segment", "metric").agg(F.sum("value").alias("sum"), F.count("value").alias("count"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    g = with_quantiles(g, rows, ["coin_id", "family", "segment", "metric"], {"value": "median"}, [0.5])
    return g.withColumn("share", F.try_divide(F.col("sum"), F.sum("sum").over(Window.partitionBy("coin_id", "family", "metric"))))


def segment_scores(pairs: DataFrame, segments: DataFrame, metrics: Sequence[str], families: Sequence[str]) -> DataFrame:
    """Long form: score weighted by the metric."""
    return _long(pairs, segments, metrics, families).groupBy("coin_id", "family", "segment", "metric").agg(expr.weighted_mean("score", "value").alias("weighted_score"))


QUANTILES = (0.002, 0.01, 0.05, 0.25, 0.75, 0.95, 0.99, 0.998)


def score_distribution(pairs: DataFrame, segments: DataFrame, metric: str, families: Sequence[str], minimum: float = 20.0) -> DataFrame:
    """Long form: twelve statistics of the scores of wallets with enough of the metric; NULL as 0."""
    rows = settled(_long(pairs, segments, [metric], families).where(F.col("value") >= minimum))
    g = rows.groupBy("coin_id", "family", "segment").agg(F.stddev_samp("score").alias("std"), expr.skewness(F.col("score")).alias("skew"), expr.kurtosis(F.col("score")).alias("kurt"))
    g = with_quantiles(g, rows, ["coin_id", "family", "segment"], {"score": "q"}, [*QUANTILES, 0.5])
    named = [F.col("q")[i].alias(f"p{x * 100:g}".replace(".", "_")) for i, x in enumerate(QUANTILES)]
    return g.select("coin_id", "family", "segment", *named, F.col("q")[len(QUANTILES)].alias("median"), "std", "skew", "kurt").na.fill(0)


def spread(long: DataFrame, values: Sequence[str], columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """family/segment|metric|stat columns for a given list of (family, segment, metric); 0 where an asset has no rows."""
    aggs = [F.coalesce(F.max(F.when((F.col("family") == f) & (F.col("segment") == s) & (F.col("metric") == m), F.col(v))), F.lit(0).cast("double")).alias(f"{f}/{s}|{m}|{v}") for f, s, m in columns for v in values]
    return long.groupBy("coin_id").agg(*aggs)


def eligible(coins: DataFrame, wallets: str, balance: str, cap: str, min_wallets: int, min_balance: float, cap_range: tuple[float, float]) -> DataFrame:
    c = F.col(cap)
    return coins.where((F.col(wallets) >= min_wallets) & (F.col(balance) >= min_balance) & (c.isNull() | c.between(*cap_range)))


def hybrid_map(pairs: DataFrame) -> DataFrame:
    """(coin, wallet, id) of the distinct pairs: ids from 1 in the order of the pairs, so no two share one, and the same
    pairs have the same ids in every run."""
    return numbered(pairs.select(*PAIR).distinct(), PAIR, "hybrid_id")


def extended_map(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """``mapping`` and, for pairs that it doesn't know, ids above its own; known pairs keep theirs."""
    last = mapping.agg(F.coalesce(F.max("hybrid_id"), F.lit(0))).first()[0]
    new = hybrid_map(unmapped(pairs, mapping))
    return mapping.unionByName(new.withColumn("hybrid_id", F.col("hybrid_id") + last))


def collisions(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("hybrid_id").count().where("count > 1")


def hybridize(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """The pair's id in place of the wallet; every pair must be in the map, and no id twice."""
    if twice := collisions(mapping).limit(1).collect():
        raise ValueError(f"two pairs have the id {twice[0]['hybrid_id']}")
    return df.join(mapping, PAIR, "left").withColumn("hybrid_id", F.coalesce("hybrid_id", F.raise_error(F.lit("a pair has no id")).cast("long"))).drop("wallet_address")


def dehybridize(df: DataFrame, mapping: DataFrame) -> DataFrame:
    return df.join(mapping.select("hybrid_id", "wallet_address", *[c for c in ("coin_id",) if c not in df.columns]), "hybrid_id").drop("hybrid_id")


def unmapped(df: DataFrame, mapping: DataFrame) -> DataFrame:
    return df.select(*PAIR).distinct().join(mapping, PAIR, "left_anti")


def with_parent(pairs: DataFrame, wallets: DataFrame, prefix: str = "cw_") -> DataFrame:
    """Pair rows with the wallet's own columns under a prefix."""
    renamed = wallets.toDF(*[c if c == "wallet_address" else prefix + c for c in wallets.columns])
    return pairs.join(renamed, "wallet_address", "left")


def quantile_index(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """1-based bucket of equal counts; where quantile edges coincide, of equal width."""
    r = quantiles(df, [column], [i / n for i in range(n + 1)]).get(column)
    if not r:
        return df.withColumn(out, F.lit(None).cast("int"))
    edges = r[1:-1] if len(set(r)) == n + 1 else [r[0] + (r[-1] - r[0]) * i / n for i in range(1, n)]
    c = F.col(column)
    return df.withColumn(out, F.when(c.isNotNull(), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < c)) + 1))


def pair_metrics(balances: DataFrame, trading: DataFrame, wallets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Balances and trading figures of each pair, 0 where missing, with chosen columns of its wallet, NULL where missing."""
    if missing := [c for c in columns if c not in wallets.columns]:
        raise ValueError(f"no such wallet columns: {missing}")
    rows = trading.join(balances, PAIR, "left")
    rows = rows.na.fill(0, [c for c in rows.columns if c not in PAIR])
    return rows.join(wallets.select("wallet_address", *columns), "wallet_address", "left")


def coin_matrix(wallet_features: DataFrame, macro_row: DataFrame, *others: DataFrame) -> DataFrame:
    """One row for each asset of the wallet features: a date-only row on all, other asset tables joined, NULL kept."""
    if macro_row.limit(2).count() != 1:
        raise ValueError("the date-only features are not one row")
    out = wallet_features.crossJoin(F.broadcast(macro_row))
    for df in others:
        out = out.join(df, "coin_id", "left")
    return out

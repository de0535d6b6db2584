"""Buy signals, their returns over cycles, and stability of parameters over dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.functions.order import pct_rank, quantiles, settled, winsorize, winsorize_by, with_quantiles


def buy_signals(scores: DataFrame, high: float, min_high: int, min_mean: float, top: int) -> DataFrame:
    """Per epoch, the ``top`` assets by mean score among those with more than ``min_high`` high scores."""
    g = scores.groupBy("epoch", "coin_id").agg(F.count_if(F.col("score") > high).alias("n_high"), F.avg("score").alias("mean_score"), F.count("*").alias("n"))
    g = g.where((F.col("n_high") > min_high) & (F.col("mean_score") >= min_mean))
    k = F.row_number().over(Window.partitionBy("epoch").orderBy(F.desc(F.round("mean_score", 9)), "coin_id"))
    return g.withColumn("place", k).where(F.col("place") <= top)


def epoch_returns(market: DataFrame, starts: Sequence[str], days: int) -> DataFrame:
    """(epoch, coin_id, coin_return) from each start to ``days`` - 1 days later."""
    spark = market.sparkSession
    t = spark.createDataFrame([(s,) for s in starts], "s string").select(F.to_date("s").alias("epoch"), F.date_add(F.to_date("s"), days - 1).alias("_e"))
    rows = market.join(F.broadcast(t), (F.col("date") == F.col("epoch")) | (F.col("date") == F.col("_e")))
    g = rows.groupBy("epoch", "coin_id").agg(F.max(F.when(F.col("date") == F.col("epoch"), F.col("price"))).alias("a"), F.max(F.when(F.col("date") == F.col("_e"), F.col("price"))).alias("b"))
    return g.select("epoch", "coin_id", (F.try_divide(F.col("b"), F.col("a")) - 1).alias("coin_return"))


def buys(scores: DataFrame, signals: DataFrame, returns: DataFrame) -> DataFrame:
    """Scored assets with their return and whether they were bought."""
    scored = scores.groupBy("epoch", "coin_id").agg(F.avg("score").alias("score"))
    rows = scored.join(returns, ["epoch", "coin_id"]).join(signals.select("epoch", "coin_id", F.lit(True).alias("_b")), ["epoch", "coin_id"], "left")
    return rows.withColumn("bought", F.coalesce("_b", F.lit(False))).drop("_b")


def epoch_metrics(rows: DataFrame, cutoff: float) -> DataFrame:
    """Per epoch, with returns winsorized inside it: bought against all."""
    r = winsorize_by(rows, "coin_return", cutoff, ["epoch"], "_w")
    r = settled(r.select("epoch", "_w", F.when(F.col("bought"), F.col("_w")).alias("_b")))
    g = r.groupBy("epoch").agg(F.count("*").alias("n_all"), F.avg("_w").alias("mean_all"), F.count("_b").alias("n_bought"), F.avg("_b").alias("mean_bought"), F.max("_b").alias("max_bought"))
    return with_quantiles(g, r, ["epoch"], {"_w": "median_all", "_b": "median_bought"}, [0.5])


def cycles(rows: DataFrame, thresholds: Sequence[float], cutoff: float = 0.005) -> DataFrame:
    """(threshold, epoch): count, mean and median return of all assets and of those scored at least so high, winsorized over
    all epochs; epochs without any stay, with NULL."""
    r = winsorize(rows.withColumn("_w", F.col("coin_return")), ["_w"], cutoff)
    t = r.select("epoch", "score", "_w", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    t = settled(t.select("threshold", "epoch", "_w", F.when(F.col("score") >= F.col("threshold"), F.col("_w")).alias("_p")))
    g = t.groupBy("threshold", "epoch").agg(F.count("_w").alias("n_all"), F.avg("_w").alias("mean_return_all"), F.count("_p").alias("n"), F.avg("_p").alias("mean_return"))
    return with_quantiles(g, t, ["threshold", "epoch"], {"_w": "median_return_all", "_p": "median_return"}, [0.5])


def lifetime(cycles_: DataFrame) -> DataFrame:
    """(threshold): returns of all epochs compounded, for all assets and for those picked, an epoch without picks as 0."""
    product = lambda c: F.product(1 + F.coalesce(c, F.lit(0.0)))
    g = cycles_.groupBy("threshold").agg(product("mean_return_all").alias("a"), product("mean_return").alias("p"), F.sum("n").alias("coins"), F.count_if(F.col("n") > 0).alias("epochs_invested"))
    return g.select("threshold", (F.col("a") - 1).alias("lifetime_return_all"), (F.col("p") - 1).alias("lifetime_return"), "coins", "epochs_invested")


def score_metrics(scores: DataFrame) -> DataFrame:
    """Per epoch: moments and quantiles of the scores."""
    s = F.col("score")
    scores = settled(scores.select("epoch", "score"))
    g = scores.groupBy("epoch").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), expr.skewness(s).alias("skew"), expr.kurtosis(s).alias("kurt"), F.count_if(s > 0.8).alias("above_80"), F.count_if(s > 0.9).alias("above_90"))
    g = with_quantiles(g, scores, ["epoch"], {"score": "q"}, [0.1, 0.5, 0.9])
    return g.select("epoch", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "skew", "kurt")], "above_80", "above_90", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def with_macro(rows: DataFrame, macro: DataFrame, column: str) -> DataFrame:
    """Epoch rows with the indicator's value on the epoch's day; epochs without one are left out."""
    m = macro.where(F.col(column).isNotNull()).select(F.col("date").alias("epoch"), column)
    return rows.join(m, "epoch")


def score_levels(rows: DataFrame, levels: int = 20) -> DataFrame:
    """(level): count and mean return at each score rounded half to even to 1/levels; a missing level has count 0."""
    spark = rows.sparkSession
    t = spark.range(levels + 1).select(F.col("id").cast("int").alias("level"))
    g = rows.groupBy(F.bround(F.round(F.col("score") * levels, 9)).cast("int").alias("level")).agg(F.count("*").alias("n"), F.avg("coin_return").alias("mean_return"))
    return t.join(F.broadcast(g), "level", "left").na.fill(0, ["n"])


def search_summary(results: DataFrame) -> DataFrame:
    """(param, value): scores over dates, with the number of dates on which it beat the date's mean."""
    base = F.avg("score").over(Window.partitionBy("date"))
    s = F.col("score")
    return results.withColumn("_b", base).groupBy("param", "value").agg(F.avg(s).alias("mean"), F.median(s).alias("median"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), (F.max(s) - F.min(s)).alias("range"), F.count_if(s > F.col("_b")).alias("improved"), F.countDistinct("date").alias("dates"))


def search_deltas(results: DataFrame, baseline: int = 0) -> DataFrame:
    """(date, combination): score, the baseline's score on that date, what it is better by, and its place on the date, the
    best first, average of equals; the baseline itself is left out. A date without a baseline has NULL."""
    base = results.where(F.col("combination") == baseline).groupBy("date").agg(F.max("score").alias("baseline"))  # a row for each date
    rows = results.where(F.col("combination") != baseline).join(base, "date", "left").withColumns({"delta": F.col("score") - F.col("baseline"), "_neg": -F.col("score")})
    place = pct_rank(rows, "_neg", "_place", ["date"]).withColumn("place", F.col("_place") * F.count("_neg").over(Window.partitionBy("date")))
    return place.drop("_neg", "_place")


def search_comparison(deltas: DataFrame) -> DataFrame:
    """(combination): over dates, mean score, mean and worst delta to the baseline, mean place, and the share of dates on
    which it beat the baseline; and a row ``all`` over combinations."""
    aggs = [F.countDistinct("date").alias("dates"), F.avg("score").alias("mean_score"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("worst_delta"), F.avg("place").alias("mean_place"), F.avg((F.col("delta") > 0).cast("double")).alias("share_better")]
    each = deltas.groupBy(F.col("combination").cast("string").alias("combination")).agg(*aggs)
    return each.unionByName(deltas.agg(*aggs).select(F.lit("all").alias("combination"), "*"))


def set_scores(results: DataFrame, sets: DataFrame, baseline: int = 0) -> DataFrame:
    """(feature): of searches in which sets of features were left out (``sets``: combination, feature), the mean delta to the
    baseline with the feature and without it, and what the feature is worth: their difference."""
    d = search_deltas(results, baseline).select("combination", "delta")
    features = sets.select("feature").distinct()
    runs = d.crossJoin(F.broadcast(features))  # features of a model: as many as its columns
    out = runs.join(sets.select("combination", "feature", F.lit(True).alias("_out")), ["combination", "feature"], "left")
    kept, left = F.when(F.col("_out").isNull(), F.col("delta")), F.when(F.col("_out"), F.col("delta"))
    g = out.groupBy("feature").agg(F.count(kept).alias("n_with"), F.count(left).alias("n_without"), F.avg(kept).alias("mean_with"), F.avg(left).alias("mean_without"))
    return g.withColumn("worth", F.col("mean_with") - F.col("mean_without"))


def stability(summary: DataFrame, dates: int, limit: float = 0.3) -> DataFrame:
    """Coefficient of variation for positive means, percent ranks of mean and stability weighted 0.3 to 0.7, and whether the
    value is stable and tested on at least 80 % of the dates."""
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))
    r = summary.withColumn("cv", cv).withColumn("_neg", -F.col("cv"))
    r = pct_rank(pct_rank(r, "mean", "_m", ["param"]), "_neg", "_s", ["param"])
    return r.withColumn("combined", 0.3 * F.col("_m") + 0.7 * F.col("_s")).withColumn("stable", F.coalesce(F.col("cv") <= limit, F.lit(False)) & (F.col("dates") >= 0.8 * dates)).drop("_neg", "_m", "_s")


def feature_stats(importances: DataFrame) -> DataFrame:
    """(feature): importance over models, with the population deviation."""
    i = F.col("importance")
    return importances.groupBy("feature").agg(F.avg(i).alias("mean"), F.median(i).alias("median"), F.stddev_pop(i).alias("std"), F.min(i).alias("min"), F.max(i).alias("max"), F.count("*").alias("models"))


def curve_positions(curves: DataFrame, macro: str, positions: int = 20) -> DataFrame:
    """(position): mean of the curves' values where the macro indicator is below its median, and above."""
    mid = quantiles(curves, [macro], [0.5]).get(macro, [None])[0]
    whole = curves.where(F.size("curve") == positions)
    rows = whole.select((F.col(macro) < F.lit(mid)).alias("low"), F.posexplode("curve").alias("position", "v"))
    return rows.groupBy("position").agg(F.avg(F.when(F.col("low"), F.col("v"))).alias("below"), F.avg(F.when(~F.col("low"), F.col("v"))).alias("above"))

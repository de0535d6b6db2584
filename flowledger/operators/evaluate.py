"""Evaluation tables: metrics, curves, buckets, segments, profitability. Scores tie: ties count half, keys break orders."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowledger.functions import expr
from flowledger.functions.order import pct_rank, quantiles, running, running_in, settled, winsorize, with_quantiles


def regression(df: DataFrame, y: str = "actual", p: str = "score") -> DataFrame:
    """One row: errors, R2, explained variance and the residuals' 95 % interval."""
    r = F.col(y) - F.col(p)
    one = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.avg(r * r).alias("mse"), F.var_pop(y).alias("vy"), F.var_pop(r).alias("vr"), F.avg(r).alias("residual_mean"), F.stddev_samp(r).alias("residual_std"))
    return one.select("n", "rmse", "mae", (1 - F.try_divide("mse", "vy")).alias("r2"), (1 - F.try_divide("vr", "vy")).alias("explained_variance"), "residual_mean", "residual_std", (F.col("residual_mean") - 1.96 * F.col("residual_std")).alias("interval_low"), (F.col("residual_mean") + 1.96 * F.col("residual_std")).alias("interval_high"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pct_rank(pct_rank(both, x, "_x"), y, "_y").agg(F.corr("_x", "_y").alias("spearman"))


def classification(df: DataFrame, threshold: float, y: str = "actual", p: str = "score") -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1 (0 without a denominator) and log loss."""
    pos, hit = F.col(y) == 1, F.col(p) >= threshold
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    g = df.agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"), F.avg(-F.when(pos, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    g = g.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": expr.ratio("tp", F.col("tp") + F.col("fp")), "recall": expr.ratio("tp", F.col("tp") + F.col("fn"))})
    return g.withColumn("f1", expr.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts of each distinct score with running totals from the highest down."""
    g = df.groupBy(F.col(p).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return running(g, "score", [], {"tp": "pos", "fp": "neg"}, "_k").drop("_k")


def roc_auc(df: DataFrame, y: str = "actual", p: str = "score") -> DataFrame:
    """One row: the chance that a positive scores above a negative, from average ranks."""
    r = pct_rank(df, p, "_r").agg(F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("s"), F.count_if(F.col(y) == 1).alias("a"), F.count("*").alias("n"))
    b = F.col("n") - F.col("a")
    return r.select(F.try_divide(F.col("s") * F.col("n") - F.col("a") * (F.col("a") + 1) / 2, F.col("a") * b).alias("roc_auc"))


def pr_curve(df: DataFrame, y: str = "actual", p: str = "score") -> DataFrame:
    """(threshold, precision, recall) for every distinct score."""
    total = df.agg(F.count_if(F.col(y) == 1).alias("all"))
    return _by_score(df, y, p).crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), expr.ratio("tp", "all").alias("recall"))


def f_beta(df: DataFrame, betas: Sequence[float] = (0.1, 0.25, 0.5, 1.0, 2.0), y: str = "actual", p: str = "score") -> DataFrame:
    """(beta, threshold, f_score): the threshold with the best F-beta, the highest of equals."""
    c = pr_curve(df, y, p)
    rows = c.select(F.explode(F.array(*map(F.lit, betas))).alias("beta"), "*")
    b2 = F.col("beta") * F.col("beta")
    f = F.round((1 + b2) * F.col("precision") * F.col("recall") / (b2 * F.col("precision") + F.col("recall") + 1e-9), 9)
    best = rows.withColumn("f", f).groupBy("beta").agg(F.max(F.struct("f", "threshold")).alias("x"))
    return best.select("beta", F.col("x.threshold").alias("threshold"), F.col("x.f").alias("f_score"))


def score_cuts(df: DataFrame, threshold: float, ret: str = "actual_return", p: str = "score", cutoff: float = 0.005) -> DataFrame:
    """(cut, n, mean_return, mean_winsorized) for the top 1 % and 5 %, the five highest, and the threshold."""
    q = quantiles(df, [p], [0.99, 0.95])[p]
    rows = winsorize(df.withColumn("_w", F.col(ret)), ["_w"], cutoff)
    five = rows.orderBy(F.desc(p), "wallet_address", "coin_id").limit(5).withColumn("cut", F.lit("top5"))
    parts = [rows.where(F.col(p) >= v).withColumn("cut", F.lit(n)) for n, v in (("top1pct", q[0]), ("top5pct", q[1]), ("threshold", threshold))]
    for x in parts:
        five = five.unionByName(x)
    return five.groupBy("cut").agg(F.count("*").alias("n"), F.avg(ret).alias("mean_return"), F.avg("_w").alias("mean_winsorized"))


def step_buckets(df: DataFrame, step: float = 0.05, ret: str = "actual_return", p: str = "score") -> DataFrame:
    """Buckets of fixed width by score, named by their lower edge."""
    k = F.floor(F.round(F.col(p) / step, 9)).cast("long")
    rows = settled(df.select(k.alias("k"), ret))
    g = rows.groupBy("k").agg(F.count("*").alias("n"), F.avg(ret).alias("mean_return"))
    return with_quantiles(g, rows, ["k"], {ret: "median_return"}, [0.5]).withColumn("midpoint", (F.col("k") + 0.5) * step)


def rank_buckets(df: DataFrame, n: int, column: str = "score", out: str = "bucket") -> DataFrame:
    """Buckets with equal counts as quantile edges give them, 1 the best; equal edges are dropped."""
    cuts = [i / n for i in range(1, n)]
    edges = sorted(set(quantiles(df, [column], cuts).get(column, [])))
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(column))) if edges else F.lit(0)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.lit(len(edges) + 1) - below))


def width_buckets(df: DataFrame, n: int, column: str = "score", ret: str = "actual_return") -> DataFrame:
    """n buckets of equal width between the extremes; a row on an edge counts in both neighbours."""
    a, b = df.agg(F.min(column), F.max(column)).first()
    spark = df.sparkSession
    edges = [(i + 1, a + (b - a) * i / n, a + (b - a) * (i + 1) / n) for i in range(n)]
    t = F.broadcast(spark.createDataFrame(edges, "bucket int, low double, high double"))
    return t.join(df, F.round(F.col(column), 9).between(F.round("low", 9), F.round("high", 9)), "left").groupBy("bucket").agg(F.count(column).alias("n"), F.avg(ret).alias("mean_return"))


def unit_buckets(df: DataFrame, n: int = 10, column: str = "score", ret: str = "actual_return") -> DataFrame:
    """n buckets from 0 to 1; empty ones stay with count 0."""
    spark = df.sparkSession
    t = spark.range(1, n + 1).select(F.col("id").cast("int").alias("bucket"))
    g = df.groupBy(F.least(F.floor(F.round(F.col(column) * n, 9)) + 1, F.lit(n)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg(ret).alias("mean_return"))
    return t.join(F.broadcast(g), "bucket", "left").na.fill(0, ["n"])


def coin_fit(df: DataFrame, min_score: float, min_count: int, ret: str = "actual_return") -> tuple[DataFrame, DataFrame]:
    """(assets, fit): mean score and return of each asset, and the line through them; NULL where all mean scores are equal.
    The means are exact, else their rounding errors would make a line where there is none."""
    coins = df.where(F.col("score") >= min_score).groupBy("coin_id").agg(F.count("*").alias("n"), expr.exact_mean("score").alias("mean_score"), expr.exact_mean(ret).alias("mean_return")).where(F.col("n") >= min_count)
    return coins, coins.agg(F.regr_slope("mean_return", "mean_score").alias("slope"), F.regr_intercept("mean_return", "mean_score").alias("intercept"), F.regr_r2("mean_return", "mean_score").alias("r2"))


def _passed(edges: Sequence[float], column: str, closed: bool) -> Column:
    """How many of the edges lie below the value, or at it too."""
    c = F.col(column)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= c if closed else e < c))


def chi_square_p(x: float | None) -> float | None:
    """Upper tail for one degree of freedom."""
    return None if x is None else math.erfc(math.sqrt(x / 2))


@F.pandas_udf(DoubleType())
def _chi_square_p(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else chi_square_p(v)).astype("float64")


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(n) or n < 1 else t_tail(a, int(n)) for a, n in zip(t, freedom, strict=True)], dtype="float64")


def significant(df: DataFrame, level: float = 0.05) -> DataFrame:
    """A report's rows with ``p_value``, from a column chi2 of one degree of freedom or from t and freedom, and whether it is
    below ``level``, NULL without a statistic. Reports have a row for each feature, so the function of a row is no burden."""
    p = _chi_square_p("chi2") if "chi2" in df.columns else _t_p("t", F.col("freedom").cast("double"))
    return df.withColumn("p_value", p).withColumn("significant", F.col("p_value") < level)


def predictive(report: DataFrame, level: float = 0.05, lift: float = 1.0) -> DataFrame:
    """The bins of ``subpopulations`` that succeed: significant, and with more than ``lift`` times the share of positives."""
    return significant(report, level).where(F.col("significant") & (F.col("lift") > lift))


def group_metrics(df: DataFrame, key: str, y: str = "actual", p: str = "score", threshold: float = 0.5, least: int = 50) -> DataFrame:
    """(key): rows, positives, ROC AUC, log loss, accuracy, precision and recall of each group's scores, all groups in one
    pass; the metrics are NULL for groups of fewer than ``least`` rows, the AUC also where there is one class only.

    Scores are counted by (group, score), and running counts of the negatives below give each positive's wins, ties half.
    """
    rows = settled(df.select(key, F.col(y).cast("int").alias("_y"), F.col(p).cast("double").alias("_p_")).where("_p_ is not null and _y is not null").withColumnRenamed("_p_", "_score"))
    q = F.least(F.greatest(F.col("_score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    hit, pos = F.col("_score") >= threshold, F.col("_y") == 1
    g = rows.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("n"), F.count_if(pos).alias("positives"), F.avg(-F.when(pos, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg((hit == pos).cast("double")).alias("accuracy"),
        F.count_if(hit & pos).alias("_tp"), F.count_if(hit).alias("_hits"),
    )
    counted = rows.groupBy(F.col(key).alias("_key"), "_score").agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") != 1).alias("_neg"))
    wins = running_in(counted, ["_key"], "_score", {"_neg": "_below"}).groupBy(F.col("_key").alias("_k")).agg(F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2)).alias("_wins"))
    both = g.join(wins, F.col("_key").eqNullSafe(F.col("_k")))
    enough = lambda c: F.when(F.col("n") >= least, c)
    auc = F.try_divide("_wins", F.col("positives").cast("double") * (F.col("n") - F.col("positives")))
    return both.select(F.col("_key").alias(key), "n", "positives", enough(auc).alias("roc_auc"), *[enough(F.col(c)).alias(c) for c in ("log_loss", "accuracy")], enough(expr.ratio("_tp", "_hits")).alias("precision"), enough(expr.ratio("_tp", "positives")).alias("recall"))


def subpopulations(df: DataFrame, columns: Sequence[str], n: int, y: str = "actual", least: int = 5) -> DataFrame:
    """(feature, bin): size, positives, lift and chi-square with Yates's correction against all other rows."""
    edges = quantiles(df, columns, [i / n for i in range(1, n)])
    b = [F.struct(F.lit(c).alias("feature"), (_passed(edges[c], c, False) + 1).alias("bin")) for c in columns]
    g = df.select(F.explode(F.array(*b)).alias("x"), (F.col(y) == 1).alias("p")).groupBy("x.feature", "x.bin").agg(F.count("*").alias("n"), F.count_if("p").alias("pos"))
    t = df.agg(F.count("*").alias("tn"), F.count_if(F.col(y) == 1).alias("tp"))
    g = g.crossJoin(F.broadcast(t))
    a, bb, c, d = F.col("pos"), F.col("n") - F.col("pos"), F.col("tp") - F.col("pos"), F.col("tn") - F.col("n") - F.col("tp") + F.col("pos")
    num = F.col("tn") * F.pow(F.greatest(F.abs(a * d - bb * c) - F.col("tn") / 2, F.lit(0.0)), 2.0)
    den = F.col("n").cast("double") * (F.col("tn") - F.col("n")) * F.col("tp") * (F.col("tn") - F.col("tp"))
    g = g.withColumn("chi2", F.when(F.least(a, bb, c, d) >= least, F.try_divide(num, den))).withColumn("lift", expr.ratio(F.col("pos") / F.col("n"), F.col("tp") / F.col("tn")))
    return g.select("feature", "bin", "n", "pos", "lift", "chi2")


def importance(df: DataFrame, depth: int) -> DataFrame:
    """(prefix, total, best_feature): importances added up by the first ``depth`` parts of the name, and the best one."""
    p = F.array_join(F.slice(F.split("feature", r"\|"), 1, depth), "|")
    return df.groupBy(p.alias("prefix")).agg(F.sum("importance").alias("total"), F.max_by("feature", F.struct("importance", "feature")).alias("best_feature"))


def name_parts(df: DataFrame, column: str = "feature") -> DataFrame:
    """family, name, window by |, and the name's parts by /; missing parts are NULL."""
    s = F.split(column, r"\|")
    n = F.split(F.try_element_at(s, F.lit(2)), "/")
    return df.select(column, *[F.try_element_at(s, F.lit(i + 1)).alias(x) for i, x in enumerate(("family", "name", "window"))], *[F.try_element_at(n, F.lit(i + 1)).alias(x) for i, x in enumerate(("metric", "transform", "stat"))])


def group_profile(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Size, share, means and medians of each group (a cluster, quantile group or cohort)."""
    df = settled(df.select(key, *columns))
    g = df.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns])
    g = with_quantiles(g, df, [key], {c: f"{c}_median" for c in columns}, [0.5])
    return g.crossJoin(F.broadcast(df.agg(F.count("*").alias("_t")))).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def with_total(df: DataFrame, key: str, aggs: Sequence[Column], name: str) -> DataFrame:
    """Groups and, as one more, all rows."""
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(*aggs).unionByName(df.agg(*aggs).select(F.lit(name).alias(key), "*"))


def top_by_metric(df: DataFrame, metrics: Sequence[str], n: int, ret: str, keys: Sequence[str] = (), key: str = "coin_id") -> DataFrame:
    """(metric): statistics of the returns of its n highest rows."""
    long = df.select(*keys, key, ret, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*keys, key, ret, "x.*")
    k = F.row_number().over(Window.partitionBy(*keys, "metric").orderBy(F.desc_nulls_last("value"), key))
    return long.withColumn("_k", k).where(F.col("_k") <= n).groupBy(*keys, "metric").agg(F.avg(ret).alias("mean_return"), F.median(ret).alias("median_return"), F.min(ret).alias("min_return"), F.max(ret).alias("max_return"))


def top_report(df: DataFrame, metrics: Sequence[str], n: int, ret: str, cap: str | None = None, caps: tuple[float | None, float | None] = (None, None), key: str = "coin_id") -> DataFrame:
    """(metric): returns of its ``n`` highest rows against those of all, the row ``all``; with ``cap``, only of rows whose
    market cap lies within ``caps``, a missing cap outside of any limit."""
    low, high = caps
    if cap and (low is not None or high is not None):
        inside = F.lit(True) if low is None else F.col(cap) >= low
        df = df.where(inside if high is None else inside & (F.col(cap) <= high))
    df = settled(df.select(key, ret, *metrics))
    stats = [F.count(ret).alias("n"), F.avg(ret).alias("mean_return"), F.min(ret).alias("min_return"), F.max(ret).alias("max_return")]
    long = df.select(key, ret, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(key, ret, "x.*")
    k = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), key))
    top = long.withColumn("_k", k).where(F.col("_k") <= n)
    g = top.groupBy("metric").agg(*stats, F.median(ret).alias("median_return"))  # n rows a metric
    middle = quantiles(df, [ret], [0.5]).get(ret, [None])[0]
    every = df.agg(*stats).select(F.lit("all").alias("metric"), "*", F.lit(middle).cast("double").alias("median_return"))
    mean = every.select(F.col("mean_return").alias("_all"))
    return g.unionByName(every).crossJoin(F.broadcast(mean)).withColumn("against_all", F.col("mean_return") - F.col("_all")).drop("_all")


def consistency(segments: DataFrame, key: str = "segment") -> DataFrame:
    """(metric): mean over segments of the average-tie rank of its mean return."""
    r = pct_rank(segments.withColumn("_neg", -F.col("mean_return")), "_neg", "_r", [key]).withColumn("_rank", F.col("_r") * F.count("_neg").over(Window.partitionBy(key)))
    return r.groupBy("metric").agg(F.avg("_rank").alias("mean_rank"), F.count("*").alias("segments"))


def sign_test(df: DataFrame, metrics: Sequence[str], ret: str) -> DataFrame:
    """(metric): correlation with the return, means for positive and other returns, pooled t and degrees of freedom."""
    long = df.select(ret, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(ret, "x.*")
    up = F.when(F.col(ret) > 0, F.col("v"))
    down = F.when(F.col(ret) <= 0, F.col("v"))
    g = long.groupBy("metric").agg(F.corr("v", ret).alias("correlation"), F.avg(up).alias("mean_up"), F.avg(down).alias("mean_down"), F.count(up).alias("n_up"), F.count(down).alias("n_down"), F.var_samp(up).alias("_vu"), F.var_samp(down).alias("_vd"))
    df_ = F.col("n_up") + F.col("n_down") - 2
    pooled = F.try_divide((F.col("n_up") - 1) * F.col("_vu") + (F.col("n_down") - 1) * F.col("_vd"), df_.cast("double"))
    se = F.sqrt(pooled * (1 / F.nullif("n_up", F.lit(0)) + 1 / F.nullif("n_down", F.lit(0))))
    return g.withColumns({"t": F.try_divide(F.col("mean_up") - F.col("mean_down"), se), "freedom": df_}).drop("_vu", "_vd")


def t_tail(t: float, freedom: int) -> float:
    """Two-sided p of Student's t, by the incomplete beta function's continued fraction; for the few rows of a report."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + top * d)
                c = 1 + top / c
                h *= c * d
            if abs(c * d - 1) < 1e-13:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def tiers(df: DataFrame, ret: str, metrics: Sequence[str], top: float = 0.75, next_: float = 0.5) -> DataFrame:
    """Means of the metrics in the top, next and bottom part by return."""
    q = quantiles(df, [ret], [top, next_])[ret]
    tier = F.when(F.col(ret) >= q[0], "top").when(F.col(ret) >= q[1], "next").otherwise("bottom")
    return df.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.avg(ret).alias("mean_return"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])


def metric_segments(df: DataFrame, metrics: Sequence[str], n: int, ret: str) -> DataFrame:
    """(metric, segment): returns in n quantile segments, lower edges included and the last one closed."""
    edges = quantiles(df, metrics, [i / n for i in range(1, n)])
    s = [F.struct(F.lit(m).alias("metric"), (_passed(edges[m], m, True) + 1).alias("segment")) for m in metrics]
    return df.select(ret, F.explode(F.array(*s)).alias("x")).groupBy("x.metric", "x.segment").agg(F.count("*").alias("n"), F.avg(ret).alias("mean_return"))


def running_profit(df: DataFrame, p: str, ret: str, keys: Sequence[str], groups: Sequence[str] = (), cutoff: float = 0.0) -> DataFrame:
    """By rank: return gathered in the order of the predictions over return gathered in the best order, 0 where that is 0;
    returns are winsorized at ``cutoff``. With ``groups`` (a time window) each is ranked alone, as one task's window."""
    rows = winsorize(df.withColumn("_ret", F.col(ret)), ["_ret"], cutoff) if cutoff else df.withColumn("_ret", F.col(ret))
    rows = rows.select(*groups, *keys, F.col(p).alias("_pred"), "_ret")

    def gathered(column: str, name: str) -> DataFrame:
        if not groups:
            return running(rows, column, keys, {name: "_ret"}, "k").select("k", name)
        w = Window.partitionBy(*groups).orderBy(F.desc(column), *keys)
        return rows.select(*groups, F.row_number().over(w).alias("k"), F.sum("_ret").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name))

    both = gathered("_pred", "model").join(gathered("_ret", "best"), [*groups, "k"])
    return both.select(*groups, "k", "model", "best", expr.ratio("model", "best").alias("profitability"))


def profit_auc(df: DataFrame, p: str, ret: str, keys: Sequence[str], share: float = 1.0, cutoff: float = 0.0, downside: bool = False) -> DataFrame:
    """One row: area by trapezoids under the running profitability of the top share; ``downside`` turns predictions and
    returns around. The inner ranks count whole and the two ends half, so no row needs its neighbour."""
    if downside:
        df = df.withColumn(p, 1 - F.col(p)).withColumn(ret, -F.col(ret))
    n = int(df.count() * share)
    if n < 2:
        raise ValueError("an area needs two rows at least")
    r = running_profit(df, p, ret, keys, cutoff=cutoff).where(F.col("k") <= n)
    weight = F.when(F.col("k").isin(1, n), 0.5).otherwise(1.0)
    return r.agg((F.sum(F.col("profitability") * weight) / (n - 1)).alias("profit_auc"))


def quartiles(df: DataFrame, column: str, cohorts: Mapping[str, Column]) -> DataFrame:
    """(cohort): count, mean, deviation and quartiles; cohorts may overlap."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cohorts.items()]))
    rows = settled(df.select(column, F.explode(names).alias("cohort")))
    g = rows.groupBy("cohort").agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    g = with_quantiles(g, rows, ["cohort"], {column: "q"}, [0.25, 0.75])
    return g.select("cohort", "n", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))

"""Queries: evaluation tables and the investing back-test, over deterministic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowledger.operators import evaluate, invest
from flowledger.plans import views as v
from flowledger.plans.oracle import Q, rounded
from flowledger.plans.registry import query

#: A return for each scored pair, so that both engines see the same numbers.
SCORED = """sc AS (SELECT wallet_address, coin_id, score, CAST((wallet_address * 31 + length(coin_id) * 17) % 200 AS DOUBLE) / 100 - 1 AS actual_return, CAST((wallet_address * 13 + length(coin_id) * 7) % 10 < 3 AS INTEGER) AS actual, score + CAST((wallet_address * 37) % 100 AS DOUBLE) / 500 - 0.1 AS noisy FROM scores)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    w, n = F.col("wallet_address"), F.length("coin_id")
    return v.scores(spark, d).select("wallet_address", "coin_id", "score", ((w * 31 + n * 17) % 200 / 100.0 - 1).alias("actual_return"), ((w * 13 + n * 7) % 10 < 3).cast("int").alias("actual"), (F.col("score") + (w * 37) % 100 / 500.0 - 0.1).alias("noisy"))


@query(Q("scores", """SELECT count(*) AS n, sqrt(avg((noisy - score) ** 2)) AS rmse, avg(abs(noisy - score)) AS mae, 1 - avg((noisy - score) ** 2) / var_pop(noisy) AS r2, 1 - var_pop(noisy - score) / var_pop(noisy) AS explained_variance, avg(noisy - score) AS residual_mean, stddev_samp(noisy - score) AS residual_std,
    avg(noisy - score) - 1.96 * stddev_samp(noisy - score) AS interval_low, avg(noisy - score) + 1.96 * stddev_samp(noisy - score) AS interval_high FROM sc""", "rmse mae r2 explained_variance residual_mean residual_std interval_low interval_high", SCORED))
def x01_regression(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.regression(scored(spark, d), "noisy", "score"))


@query(Q("scores", "SELECT corr(a, b) AS spearman FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY actual_return) + (count(*) OVER (PARTITION BY actual_return) - 1) / 2.0 AS b FROM sc)", "spearman", SCORED))
def x01_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.spearman(scored(spark, d), "score", "actual_return"))


@query(Q("scores", """SELECT 'all' AS cohort, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.75) AS q75 FROM sc UNION ALL SELECT 'winners', count(*), avg(score), stddev_samp(score), quantile_cont(score, 0.25), quantile_cont(score, 0.75) FROM sc WHERE actual_return > 0""", "mean std q25 q75", SCORED))
def x02_x16_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.quartiles(scored(spark, d), "score", {"all": F.lit(True), "winners": F.col("actual_return") > 0}))


@query(Q("scores", """SELECT tp, fp, tn, fn, log_loss, CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count(*) FILTER (actual = 1 AND score >= 0.6) AS tp, count(*) FILTER (actual <> 1 AND score >= 0.6) AS fp, count(*) FILTER (actual <> 1 AND score < 0.6) AS tn, count(*) FILTER (actual = 1 AND score < 0.6) AS fn,
    avg(-CASE WHEN actual = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) AS log_loss FROM sc)""", "log_loss accuracy precision recall f1", SCORED, 5))
def x03_classification(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.classification(scored(spark, d), 0.6), 5)


@query(Q("scores", "SELECT CAST(sum(w) AS DOUBLE) / nullif(count(*), 0) AS roc_auc FROM (SELECT CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END AS w FROM sc p JOIN sc n ON p.actual = 1 AND n.actual = 0)", "roc_auc", SCORED))
def x04_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.roc_auc(scored(spark, d)))


PR = SCORED + """, pr AS (SELECT score AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (SELECT sum(actual) FROM sc) AS recall FROM (SELECT score, sum(sum(actual)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - actual)) OVER (ORDER BY score DESC) AS fp FROM sc GROUP BY score))"""


@query(Q("scores", "SELECT * FROM pr", "threshold precision recall", PR))
def x05_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.pr_curve(scored(spark, d)))


@query(Q("scores", "SELECT beta, max(threshold) AS threshold, max(f) AS f_score FROM (SELECT beta, threshold, round((1 + beta * beta) * precision * recall / (beta * beta * precision + recall + 1e-9), 9) AS f, max(round((1 + beta * beta) * precision * recall / (beta * beta * precision + recall + 1e-9), 9)) OVER (PARTITION BY beta) AS m FROM pr, (VALUES (0.1::DOUBLE), (0.25), (0.5), (1.0), (2.0)) b(beta)) WHERE f = m GROUP BY 1", "beta threshold f_score", PR))
def x05_f_beta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.f_beta(scored(spark, d)))


WINSOR = """, kk AS (SELECT CAST(round_even((count(*) - 1) * {q}, 0) AS BIGINT) AS a, CAST(round_even((count(*) - 1) * (1 - {q}), 0) AS BIGINT) AS z FROM {t}), oo AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS r FROM {t}), ee AS (SELECT max(CASE WHEN r = a THEN x END) AS lo, max(CASE WHEN r = z THEN x END) AS hi FROM oo, kk)"""


@query(Q("scores", """SELECT cut, count(*) AS n, avg(actual_return) AS mean_return, avg(least(greatest(actual_return, lo), hi)) AS mean_winsorized FROM (SELECT 'top1pct' AS cut, * FROM sc WHERE score >= (SELECT quantile_cont(score, 0.99) FROM sc) UNION ALL SELECT 'top5pct', * FROM sc WHERE score >= (SELECT quantile_cont(score, 0.95) FROM sc) UNION ALL SELECT 'threshold', * FROM sc WHERE score >= 0.7 UNION ALL (SELECT 'top5', * FROM sc ORDER BY score DESC, wallet_address, coin_id LIMIT 5)), ee GROUP BY 1""", "mean_return mean_winsorized", SCORED + WINSOR.format(q=0.005, t="sc", c="actual_return")))
def x06_score_cuts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.score_cuts(scored(spark, d), 0.7))


@query(Q("scores", "SELECT CAST(floor(round(score / 0.05, 9)) AS BIGINT) AS k, count(*) AS n, avg(actual_return) AS mean_return, median(actual_return) AS median_return, (floor(round(score / 0.05, 9)) + 0.5) * 0.05 AS midpoint FROM sc GROUP BY 1, 5", "mean_return median_return midpoint", SCORED))
def x07_step_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.step_buckets(scored(spark, d)))


@query(Q("scores", "SELECT wallet_address, coin_id, CAST(5 - (score > a)::INT - (score > b)::INT - (score > c)::INT - (score > e)::INT AS INTEGER) AS bucket FROM sc, (SELECT quantile_cont(score, 0.2) AS a, quantile_cont(score, 0.4) AS b, quantile_cont(score, 0.6) AS c, quantile_cont(score, 0.8) AS e FROM sc)", "", SCORED))
def x08_rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rank_buckets(scored(spark, d), 5).select("wallet_address", "coin_id", "bucket")


@query(Q("scores", "SELECT i AS bucket, count(score) AS n, avg(actual_return) AS mean_return FROM (SELECT CAST(i AS INTEGER) AS i, round(a + (b - a) * (i - 1) / 4, 9) AS lo, round(a + (b - a) * i / 4, 9) AS hi FROM (SELECT min(score) AS a, max(score) AS b FROM sc), range(1, 5) r(i)) LEFT JOIN sc ON round(score, 9) BETWEEN lo AND hi GROUP BY 1", "mean_return", SCORED))
def x09_width_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.width_buckets(scored(spark, d), 4))


@query(Q("scores", "SELECT CAST(i AS INTEGER) AS bucket, count(score) AS n, avg(actual_return) AS mean_return FROM range(1, 11) r(i) LEFT JOIN sc ON least(floor(round(score * 10, 9)) + 1, 10) = i GROUP BY 1", "mean_return", SCORED))
def x10_unit_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.unit_buckets(scored(spark, d)))


@query(Q("scores", "SELECT regr_slope(r, s) AS slope, regr_intercept(r, s) AS intercept, regr_r2(r, s) AS r2 FROM (SELECT coin_id, avg(score) AS s, avg(actual_return) AS r FROM sc WHERE score >= 0.2 GROUP BY 1 HAVING count(*) >= 10)", "slope intercept r2", SCORED, 5))
def x11_coin_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.coin_fit(scored(spark, d), 0.2, 10)[1], 5)


@query(Q("scores", """SELECT feature, bin, n, pos, (CAST(pos AS DOUBLE) / n) / (CAST(tp AS DOUBLE) / tn) AS lift, CASE WHEN least(pos, n - pos, tp - pos, tn - n - tp + pos) >= 5 THEN tn * power(greatest(abs(CAST(pos AS DOUBLE) * (tn - n - tp + pos) - CAST(n - pos AS DOUBLE) * (tp - pos)) - tn / 2.0, 0), 2) / (CAST(n AS DOUBLE) * (tn - n) * tp * (tn - tp)) END AS chi2
    FROM (SELECT 'score' AS feature, CAST(1 + (score > a)::INT + (score > b)::INT AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (actual = 1) AS pos FROM sc, (SELECT quantile_cont(score, 1/3.0) AS a, quantile_cont(score, 2/3.0) AS b FROM sc) GROUP BY 2), (SELECT count(*) AS tn, count(*) FILTER (actual = 1) AS tp FROM sc)""", "lift chi2", SCORED, 5))
def x13_subpopulations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.subpopulations(scored(spark, d), ["score"], 3), 5)


@query("""WITH f AS (SELECT p_type || '|' || p_brand || '|w' || p_size AS feature, p_retailprice AS importance FROM part) SELECT array_to_string(string_split(feature, '|')[1:2], '|') AS prefix, round(sum(importance), 6) AS total, arg_max(feature, (importance, feature)) AS best_feature FROM f GROUP BY 1""")
def x14_importance(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part").select(F.concat_ws("|", "p_type", "p_brand", F.concat(F.lit("w"), F.col("p_size").cast("string"))).alias("feature"), F.col("p_retailprice").alias("importance"))
    return rounded(evaluate.importance(p, 2))


@query("""SELECT DISTINCT feature, string_split(feature, '|')[1] AS family, string_split(feature, '|')[2] AS name, string_split(feature, '|')[3] AS "window", string_split(string_split(feature, '|')[2], '/')[1] AS metric, string_split(string_split(feature, '|')[2], '/')[2] AS transform, string_split(string_split(feature, '|')[2], '/')[3] AS stat FROM (SELECT p_type || '|' || replace(p_brand, '#', '/') || CASE WHEN p_size % 2 = 0 THEN '/mean|w1' ELSE '' END AS feature FROM part)""")
def p18_name_parts(spark: SparkSession, d: str) -> DataFrame:
    f = F.concat(F.col("p_type"), F.lit("|"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("/")), F.when(F.col("p_size") % 2 == 0, "/mean|w1").otherwise(""))
    return evaluate.name_parts(v.table(spark, d, "part").select(f.alias("feature")).distinct())


@query(Q("scores", "SELECT coin_id, count(*) AS n, avg(score) AS score_mean, median(score) AS score_median, count(*) / (SELECT count(*) FROM sc) AS share FROM sc GROUP BY 1", "score_mean score_median share", SCORED))
def x15_group_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.group_profile(scored(spark, d), "coin_id", ["score"]))


@query(Q("scores", "SELECT CASE WHEN grouping(actual) = 1 THEN 'all' ELSE CAST(actual AS VARCHAR) END AS actual, count(*) AS n, avg(actual_return) AS mean_return FROM sc GROUP BY ROLLUP (actual)", "mean_return", SCORED))
def x17_with_total(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.with_total(scored(spark, d), "actual", [F.count("*").alias("n"), F.avg("actual_return").alias("mean_return")], "all"))


PARTS = """pt AS (SELECT p_partkey AS coin_id, p_brand AS segment, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000 - 0.4 AS ret FROM part), ml AS (SELECT coin_id, segment, ret, 'size' AS metric, size AS value FROM pt UNION ALL SELECT coin_id, segment, ret, 'price', price FROM pt)"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("coin_id"), F.col("p_brand").alias("segment"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") * 7919 % 1000 / 1000.0 - 0.4).alias("ret"))


TOP = "SELECT segment, metric, avg(ret) AS mean_return, median(ret) AS median_return, min(ret) AS min_return, max(ret) AS max_return FROM (SELECT *, row_number() OVER (PARTITION BY segment, metric ORDER BY value DESC NULLS LAST, coin_id) AS k FROM ml) WHERE k <= 20 GROUP BY 1, 2"


@query(Q("", TOP, "mean_return median_return min_return max_return", PARTS))
def x18_x19_top_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.top_by_metric(parts(spark, d), ["size", "price"], 20, "ret", ["segment"]))


@query(Q("", "SELECT metric, avg(r) AS mean_rank, count(*) AS segments FROM (SELECT metric, rank() OVER (PARTITION BY segment ORDER BY mean_return DESC) + (count(*) OVER (PARTITION BY segment, mean_return) - 1) / 2.0 AS r FROM t) GROUP BY 1", "mean_rank", PARTS + f", t AS (SELECT segment, metric, round(mean_return, 6) AS mean_return FROM ({TOP}))"))
def x19_w10_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.consistency(rounded(evaluate.top_by_metric(parts(spark, d), ["size", "price"], 20, "ret", ["segment"]))))


@query(Q("", """SELECT metric, correlation, mean_up, mean_down, n_up, n_down, (mean_up - mean_down) / sqrt(((n_up - 1) * vu + (n_down - 1) * vd) / (n_up + n_down - 2) * (1.0 / n_up + 1.0 / n_down)) AS t, n_up + n_down - 2 AS freedom FROM (SELECT metric, corr(value, ret) AS correlation, avg(value) FILTER (ret > 0) AS mean_up, avg(value) FILTER (ret <= 0) AS mean_down, count(*) FILTER (ret > 0) AS n_up, count(*) FILTER (ret <= 0) AS n_down, var_samp(value) FILTER (ret > 0) AS vu, var_samp(value) FILTER (ret <= 0) AS vd FROM ml GROUP BY 1)""", "correlation mean_up mean_down t", PARTS, 5))
def x20_sign_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.sign_test(parts(spark, d), ["size", "price"], "ret"), 5)


@query(Q("", "SELECT CASE WHEN ret >= a THEN 'top' WHEN ret >= b THEN 'next' ELSE 'bottom' END AS tier, count(*) AS n, avg(ret) AS mean_return, avg(size) AS size_mean FROM pt, (SELECT quantile_cont(ret, 0.75) AS a, quantile_cont(ret, 0.5) AS b FROM pt) GROUP BY 1", "mean_return size_mean", PARTS))
def x21_tiers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.tiers(parts(spark, d), "ret", ["size"]))


@query(Q("", "SELECT metric, CAST(1 + (value >= a)::INT + (value >= b)::INT + (value >= c)::INT AS INTEGER) AS segment, count(*) AS n, avg(ret) AS mean_return FROM ml JOIN (SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM ml GROUP BY 1) USING (metric) GROUP BY 1, 2", "mean_return", PARTS))
def x22_metric_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metric_segments(parts(spark, d), ["size", "price"], 4, "ret"))


RUN = PARTS + """, a AS (SELECT row_number() OVER (ORDER BY size DESC, coin_id) AS k, ret AS x FROM pt), b AS (SELECT row_number() OVER (ORDER BY ret DESC, coin_id) AS k, ret AS y FROM pt), rp AS (SELECT k, sum(x) OVER (ORDER BY k) AS model, sum(y) OVER (ORDER BY k) AS best FROM a JOIN b USING (k))"""


@query(Q("", "SELECT k, model, best, CASE WHEN best = 0 THEN 0 ELSE model / best END AS profitability FROM rp", "model best profitability", RUN))
def x23_running_profit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.running_profit(parts(spark, d), "size", "ret", ["coin_id"]))


AREA = "SELECT sum((p + q) / 2) / (max(k) - 1) AS profit_auc FROM (SELECT k, model / best AS p, lag(model / best) OVER (ORDER BY k) AS q FROM rp WHERE k <= CAST(floor((SELECT count(*) FROM pt) * {share}) AS BIGINT))"


@query(Q("", AREA.format(share=0.2), "profit_auc", RUN))
def x23_profit_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.profit_auc(parts(spark, d), "size", "ret", ["coin_id"], 0.2))


@query(Q("", AREA.format(share=0.5), "profit_auc", PARTS + WINSOR.format(q=0.01, t="pt", c="ret") + """, a AS (SELECT row_number() OVER (ORDER BY size DESC, coin_id) AS k, least(greatest(ret, lo), hi) AS x FROM pt, ee), b AS (SELECT row_number() OVER (ORDER BY least(greatest(ret, lo), hi) DESC, coin_id) AS k, least(greatest(ret, lo), hi) AS y FROM pt, ee), rp AS (SELECT k, sum(x) OVER (ORDER BY k) AS model, sum(y) OVER (ORDER BY k) AS best FROM a JOIN b USING (k))"""))
def x23_winsorized_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.profit_auc(parts(spark, d), "size", "ret", ["coin_id"], 0.5, cutoff=0.01))


@query(Q("", AREA.format(share=0.2), "profit_auc", PARTS + """, a AS (SELECT row_number() OVER (ORDER BY 1 - size DESC, coin_id) AS k, -ret AS x FROM pt), b AS (SELECT row_number() OVER (ORDER BY -ret DESC, coin_id) AS k, -ret AS y FROM pt), rp AS (SELECT k, sum(x) OVER (ORDER BY k) AS model, sum(y) OVER (ORDER BY k) AS best FROM a JOIN b USING (k))"""))
def x23_downside_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.profit_auc(parts(spark, d), "size", "ret", ["coin_id"], 0.2, downside=True))


@query(Q("", "SELECT segment, k, model, best, CASE WHEN best = 0 THEN 0 ELSE model / best END AS profitability FROM (SELECT segment, k, sum(x) OVER (PARTITION BY segment ORDER BY k) AS model, sum(y) OVER (PARTITION BY segment ORDER BY k) AS best FROM (SELECT segment, ret AS x, row_number() OVER (PARTITION BY segment ORDER BY size DESC, coin_id) AS k FROM pt) JOIN (SELECT segment, ret AS y, row_number() OVER (PARTITION BY segment ORDER BY ret DESC, coin_id) AS k FROM pt) USING (segment, k))", "model best profitability", PARTS, 5))
def x24_curves_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.running_profit(parts(spark, d), "size", "ret", ["coin_id"], ["segment"]), 5)


#: Epochs of the back-test: scores shift by epoch.
EPOCHS = ["2024-01-06", "2024-01-11", "2024-01-16", "2024-01-21"]
EPOCH_SCORES = """ep(epoch, i) AS (VALUES (DATE '2024-01-06', 0), (DATE '2024-01-11', 1), (DATE '2024-01-16', 2), (DATE '2024-01-21', 3)), es AS (SELECT epoch, wallet_address, coin_id, CAST((wallet_address * 7919 + length(coin_id) * 104729 + i * 313) % 1000 AS DOUBLE) / 1000 AS score FROM scores, ep),
sig AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY round(mean_score, 9) DESC, coin_id) AS place FROM (SELECT epoch, coin_id, count(*) FILTER (score > 0.8) AS n_high, avg(score) AS mean_score, count(*) AS n FROM es GROUP BY 1, 2) WHERE n_high > 20 AND mean_score >= 0.3 QUALIFY place <= 2),
er AS (SELECT epoch, coin_id, max(price) FILTER (date = epoch + 4) / nullif(max(price) FILTER (date = epoch), 0) - 1 AS coin_return FROM market JOIN ep ON date = epoch OR date = epoch + 4 GROUP BY 1, 2),
by_ AS (SELECT s.epoch, s.coin_id, score, coin_return, sig.coin_id IS NOT NULL AS bought FROM (SELECT epoch, coin_id, avg(score) AS score FROM es GROUP BY 1, 2) s JOIN er USING (epoch, coin_id) LEFT JOIN sig ON sig.epoch = s.epoch AND sig.coin_id = s.coin_id)"""


def epoch_scores(spark: SparkSession, d: str) -> DataFrame:
    i = F.posexplode(F.array(*[F.to_date(F.lit(e)) for e in EPOCHS])).alias("i", "epoch")
    return v.scores(spark, d).select("wallet_address", "coin_id", i).select("epoch", "wallet_address", "coin_id", ((F.col("wallet_address") * 7919 + F.length("coin_id") * 104729 + F.col("i") * 313) % 1000 / 1000.0).alias("score"))


def bought(spark: SparkSession, d: str) -> DataFrame:
    s = epoch_scores(spark, d)
    return invest.buys(s, invest.buy_signals(s, 0.8, 20, 0.3, 2), invest.epoch_returns(v.market(spark, d), EPOCHS, 5))


@query(Q("market scores", "SELECT epoch, coin_id, n_high, mean_score, n, CAST(place AS INTEGER) AS place FROM sig", "mean_score", EPOCH_SCORES))
def b01_buy_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.buy_signals(epoch_scores(spark, d), 0.8, 20, 0.3, 2))


@query(Q("market scores", "SELECT * FROM by_", "score coin_return", EPOCH_SCORES))
def b02_epoch_buys(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bought(spark, d))


@query(Q("market scores", """SELECT epoch, count(*) AS n_all, avg(w) AS mean_all, median(w) AS median_all, count(*) FILTER (bought) AS n_bought, avg(w) FILTER (bought) AS mean_bought, median(w) FILTER (bought) AS median_bought, max(w) FILTER (bought) AS max_bought FROM (SELECT *, least(greatest(coin_return, max(CASE WHEN r = round_even((c - 1) * 0.25, 0) THEN coin_return END) OVER e), max(CASE WHEN r = round_even((c - 1) * 0.75, 0) THEN coin_return END) OVER e) AS w FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY coin_return) - 1 AS r, count(*) OVER (PARTITION BY epoch) AS c FROM by_) WINDOW e AS (PARTITION BY epoch)) GROUP BY 1""", "mean_all median_all mean_bought median_bought max_bought", EPOCH_SCORES))
def b04_epoch_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.epoch_metrics(bought(spark, d), 0.25))


CYCLES = EPOCH_SCORES + WINSOR.format(q=0.05, t="by_", c="coin_return") + """, cy AS (SELECT threshold, epoch, count(*) AS n_all, avg(least(greatest(coin_return, lo), hi)) AS mean_return_all, median(least(greatest(coin_return, lo), hi)) AS median_return_all, count(*) FILTER (score >= threshold) AS n, avg(least(greatest(coin_return, lo), hi)) FILTER (score >= threshold) AS mean_return, median(least(greatest(coin_return, lo), hi)) FILTER (score >= threshold) AS median_return FROM by_, ee, (VALUES (0.4::DOUBLE), (0.5), (0.6)) t(threshold) GROUP BY 1, 2)"""


@query(Q("market scores", "SELECT * FROM cy", "mean_return_all median_return_all mean_return median_return threshold", CYCLES))
def b05_cycles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.cycles(bought(spark, d), [0.4, 0.5, 0.6], 0.05))


@query(Q("market scores", "SELECT threshold, product(1 + mean_return_all) - 1 AS lifetime_return_all, product(1 + coalesce(mean_return, 0)) - 1 AS lifetime_return, CAST(sum(n) AS BIGINT) AS coins, count(*) FILTER (n > 0) AS epochs_invested FROM cy GROUP BY 1", "threshold lifetime_return_all lifetime_return", CYCLES))
def b06_lifetime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.lifetime(invest.cycles(bought(spark, d), [0.4, 0.5, 0.6], 0.05)))


@query(Q("market scores", "SELECT epoch, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std, round(skewness(score), 4) AS skew, round(kurtosis(score), 4) AS kurt, count(*) FILTER (score > 0.8) AS above_80, count(*) FILTER (score > 0.9) AS above_90, round(quantile_cont(score, 0.1), 4) AS p10, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.9), 4) AS p90 FROM es GROUP BY 1", "mean std skew kurt p10 p50 p90", EPOCH_SCORES, 6))
def b07_score_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.score_metrics(epoch_scores(spark, d)), 6)


@query(Q("market scores macro", "SELECT b.epoch, coin_id, coin_return, total_value FROM by_ b JOIN macro m ON m.date = b.epoch", "coin_return total_value", EPOCH_SCORES))
def b08_with_macro(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.with_macro(bought(spark, d), v.macro(spark, d), "total_value").select("epoch", "coin_id", "coin_return", "total_value"))


@query(Q("market scores", "SELECT CAST(i AS INTEGER) AS level, count(score) AS n, avg(coin_return) AS mean_return FROM range(0, 21) r(i) LEFT JOIN by_ ON round_even(round(score * 20, 9), 0) = i GROUP BY 1", "mean_return", EPOCH_SCORES))
def b10_score_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.score_levels(bought(spark, d)))


SEARCH = """sr AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, o_orderpriority AS param, o_orderstatus AS value, round(avg(o_totalprice) / 100000, 6) AS score FROM orders GROUP BY 1, 2, 3),
su AS (SELECT param, value, avg(score) AS mean, median(score) AS median, coalesce(stddev_samp(score), 0) AS std, min(score) AS min, max(score) AS max, max(score) - min(score) AS range, count(*) FILTER (score > b) AS improved, count(DISTINCT date) AS dates FROM (SELECT *, round(avg(score) OVER (PARTITION BY date), 9) AS b FROM sr) GROUP BY 1, 2)"""


def search(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date"), F.col("o_orderpriority").alias("param"), F.col("o_orderstatus").alias("value")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("score"))


@query(Q("", "SELECT * FROM su", "mean median std min max range", SEARCH))
def b11_search_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(invest.search_summary(search(spark, d)))


@query(Q("", """SELECT param, value, mean, cv, 0.3 * (rank() OVER (PARTITION BY param ORDER BY mean)) / count(*) OVER (PARTITION BY param) + 0.7 * (rank() OVER (PARTITION BY param ORDER BY cv DESC)) / count(cv) OVER (PARTITION BY param) AS combined, coalesce(cv <= 0.1, false) AND dates >= 0.8 * 80 AS stable FROM (SELECT *, CASE WHEN mean > 0 THEN std / mean END AS cv FROM su)""", "mean cv combined", SEARCH))
def b12_stability(spark: SparkSession, d: str) -> DataFrame:
    s = invest.stability(invest.search_summary(search(spark, d)), 80, 0.1)
    return rounded(s.select("param", "value", "mean", "cv", "combined", "stable"))


@query("""SELECT p_name AS feature, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, round(stddev_pop(p_retailprice), 6) AS std, min(p_retailprice) AS min, max(p_retailprice) AS max, count(*) AS models FROM part GROUP BY 1""")
def b14_feature_stats(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part").select(F.col("p_name").alias("feature"), F.col("p_retailprice").alias("importance"))
    return rounded(invest.feature_stats(p))


@query("""WITH c AS (SELECT user_id, avg(value) AS macro, list(value ORDER BY event_id)[1:20] AS curve FROM events GROUP BY 1 HAVING count(*) >= 20), m AS (SELECT median(macro) AS mid FROM c), x AS (SELECT macro < mid AS low, CAST(unnest(range(0, 20)) AS INTEGER) AS position, unnest(curve) AS v FROM c, m) SELECT position, round(avg(v) FILTER (low), 6) AS below, round(avg(v) FILTER (NOT low), 6) AS above FROM x GROUP BY 1""")
def b15_curve_positions(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 20")
    curve = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda r: r["value"])  # 20 values
    c = first.groupBy("user_id").agg(curve.alias("curve")).join(e.groupBy("user_id").agg(F.avg("value").alias("macro")), "user_id")
    return rounded(invest.curve_positions(c, "macro"))


CLUSTERS = SCORED + """, cl AS (SELECT *, CAST(wallet_address % 7 AS INTEGER) AS cluster FROM sc WHERE wallet_address % 7 < 6 OR wallet_address % 5 = 0), pairs_ AS (SELECT p.cluster, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auc FROM cl p JOIN cl n ON p.cluster = n.cluster AND p.actual = 1 AND n.actual = 0 GROUP BY 1)"""


@query(Q("scores", """SELECT cluster, n, positives, CASE WHEN n >= 50 THEN auc END AS roc_auc, CASE WHEN n >= 50 THEN ll END AS log_loss, CASE WHEN n >= 50 THEN CAST(ok AS DOUBLE) / n END AS accuracy,
    CASE WHEN n >= 50 THEN coalesce(CAST(tp AS DOUBLE) / nullif(hits, 0), 0) END AS precision, CASE WHEN n >= 50 THEN coalesce(CAST(tp AS DOUBLE) / nullif(positives, 0), 0) END AS recall
    FROM (SELECT cluster, count(*) AS n, count(*) FILTER (actual = 1) AS positives, avg(-CASE WHEN actual = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) AS ll, count(*) FILTER ((score >= 0.5) = (actual = 1)) AS ok, count(*) FILTER (actual = 1 AND score >= 0.5) AS tp, count(*) FILTER (score >= 0.5) AS hits FROM cl GROUP BY 1) LEFT JOIN pairs_ USING (cluster)""", "roc_auc log_loss accuracy precision recall", CLUSTERS, 5))
def x15_cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Model metrics of every cluster of wallets, in one pass."""
    rows = scored(spark, d).withColumn("cluster", (F.col("wallet_address") % 7).cast("int")).where("cluster < 6 or wallet_address % 5 = 0")
    return rounded(evaluate.group_metrics(rows, "cluster"), 5)


#: Upper tail of chi-square with one degree of freedom, by the series of the error function that has positive terms only.
CHI_P = "greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} / 2) * sqrt({x} / 2) * list_sum(list_transform(range(0, 120), lambda i: exp(i * ln(greatest({x}, 1e-300)) - list_sum(list_transform(range(0, i + 1), lambda j: ln(2 * j + 1)))))))"
SUBS = SCORED + """, fe AS (SELECT 'score' AS feature, score AS v, actual FROM sc UNION ALL SELECT 'noisy', noisy, actual FROM sc), ed AS (SELECT feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM fe GROUP BY 1),
bi AS (SELECT feature, CAST(1 + (v > a)::INT + (v > b)::INT + (v > c)::INT AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (actual = 1) AS pos FROM fe JOIN ed USING (feature) GROUP BY 1, 2), tt AS (SELECT count(*) AS tn, count(*) FILTER (actual = 1) AS tp FROM sc),
ch AS (SELECT feature, bin, n, pos, (CAST(pos AS DOUBLE) / n) / (CAST(tp AS DOUBLE) / tn) AS lift, tn * power(greatest(abs(CAST(pos AS DOUBLE) * (tn - n - tp + pos) - CAST(n - pos AS DOUBLE) * (tp - pos)) - tn / 2.0, 0), 2) / (CAST(n AS DOUBLE) * (tn - n) * tp * (tn - tp)) AS chi2 FROM bi, tt)"""


@query(Q("scores", f"SELECT feature, bin, n, pos, lift, chi2, {CHI_P.format(x='chi2')} AS p_value, {CHI_P.format(x='chi2')} < 0.3 AS significant FROM ch", "lift chi2 p_value", SUBS, 4))
def x13_significance(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of two features with their p-values against all other rows."""
    return rounded(evaluate.significant(evaluate.subpopulations(scored(spark, d), ["score", "noisy"], 4), 0.3), 4)


REPORT = PARTS + ", pc AS (SELECT * FROM pt WHERE price BETWEEN 905 AND 1500), mc AS (SELECT coin_id, ret, 'size' AS metric, size AS value FROM pc UNION ALL SELECT coin_id, ret, 'price', price FROM pc)"


@query(Q("", """SELECT *, mean_return - (SELECT avg(ret) FROM pc) AS against_all FROM (SELECT metric, count(*) AS n, avg(ret) AS mean_return, median(ret) AS median_return, min(ret) AS min_return, max(ret) AS max_return FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, coin_id) AS k FROM mc) WHERE k <= 25 GROUP BY 1
    UNION ALL SELECT 'all', count(*), avg(ret), median(ret), min(ret), max(ret) FROM pc)""", "mean_return median_return min_return max_return against_all", REPORT))
def x18_top_report(spark: SparkSession, d: str) -> DataFrame:
    """Top assets of each metric against all assets, within limits of the market cap, for which the price stands."""
    return rounded(evaluate.top_report(parts(spark, d), ["size", "price"], 25, "ret", "price", (905.0, 1500.0)))

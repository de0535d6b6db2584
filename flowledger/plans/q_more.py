"""Queries: the remaining checks, jobs made of several operators, and small building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.functions.order import pct_rank, winsorize
from flowledger.operators import checks, cleaning, coin, evaluate, flatten, indicators, invest, models, targets, wallet
from flowledger.plans import views as v
from flowledger.plans.oracle import PERIOD, TRADING, Q, rounded
from flowledger.plans.q_basic import COLUMNS, wallet_matrix
from flowledger.plans.q_evaluate import EPOCH_SCORES, SCORED, bought, epoch_scores, scored, search
from flowledger.plans.q_features import PAIRS, pairs, segments, series_returns
from flowledger.plans.q_features import SERIES_RETURNS as RETURNS
from flowledger.plans.q_ledger import F40, _perform, _relative, _scenario, period, trading
from flowledger.plans.registry import query

BOTH = ",".join([PERIOD, TRADING, F40, _scenario("ideal"), _scenario("worst")])


def scenarios(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, m = period(spark, d), v.market(spark, d)
    rg = wallet.price_ranges(p, m, v.START)
    return trading(spark, d), *[wallet.trading(wallet.scenario(p, rg, m, v.END, k), v.START, v.END) for k in ("ideal", "worst")]


@query(Q("ledger market", "SELECT count(*) AS wallets, count(*) FILTER (a.net_gain > i.net_gain + greatest(abs(a.net_gain) * 0.0001, 0.01)) AS above_ideal, count(*) FILTER (a.net_gain < w.net_gain - greatest(abs(a.net_gain) * 0.0001, 0.01)) AS below_worst FROM trading a JOIN trading_ideal i USING (wallet_address) JOIN trading_worst w USING (wallet_address)", "", BOTH))
def v11_scenario_bounds(spark: SparkSession, d: str) -> DataFrame:
    return checks.scenario_bounds(*scenarios(spark, d))


@query(Q("ledger market", "SELECT wallet_address, " + ", ".join(f"""CASE WHEN abs(w."{c}" + i."{c}") < 1e-10 THEN 0 ELSE i."{c}" / nullif(w."{c}" + i."{c}", 0) END AS "net_perf/{c}\"""" for c in wallet.NET) + " FROM rel_ideal i JOIN rel_worst w USING (wallet_address)",
    " ".join(f"net_perf/{c}" for c in wallet.NET), ",".join([BOTH, _perform("trading", "pf"), _relative("ideal"), _relative("worst")]), 4))
def f44_net_performance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.scenario_features(period(spark, d), v.market(spark, d), v.START, v.END).select("wallet_address", *[F.col(f"`net_perf/{c}`") for c in wallet.NET]), 4)


@query(Q("scores", "SELECT count(*) AS rows, 0::BIGINT AS unmatched, 0::BIGINT AS duplicates, max(n) / sum(n) AS commonest_share, CAST(1 AS INTEGER) AS not_numbers FROM (SELECT actual, count(*) AS n FROM sc GROUP BY 1)", "commonest_share", SCORED).replace("count(*) AS rows, 0", "CAST(sum(n) AS BIGINT) AS rows, 0"))
def v12_model_input(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("key", F.concat_ws("|", F.col("wallet_address").cast("string"), "coin_id"))
    return rounded(checks.model_input(s.select("key", "score", "coin_id"), s.select("key", "actual"), ["key"], "actual"))


@query(Q("ledger market", "SELECT coin_id, count(*) AS n, count(DISTINCT wallet_address) AS wallets FROM ledger WHERE coin_id IN (SELECT coin_id FROM market GROUP BY 1 HAVING avg(volume) >= 1000) GROUP BY 1"))
def t15_coin_cohort(spark: SparkSession, d: str) -> DataFrame:
    left = cleaning.clean_market(v.market(spark, d), 4, 1000.0)
    return cleaning.cohort_rows(v.ledger(spark, d), left).groupBy("coin_id").agg(F.count("*").alias("n"), F.countDistinct("wallet_address").alias("wallets"))


@query(Q("ledger market", "SELECT d AS date, count(*) AS n FROM lr WHERE ld < d GROUP BY 1", "", """dd(d) AS (VALUES (DATE '2024-01-05'), (DATE '2024-01-10'), (DATE '2024-01-15'), (DATE '2024-01-20')), lr AS (SELECT coin_id, wallet_address, d, max(date) AS ld FROM ledger JOIN dd ON date <= d GROUP BY 1, 2, 3)"""))
def t08_imputation_dates(spark: SparkSession, d: str) -> DataFrame:
    """As-of rows for all borders of a period's windows, counted by day."""
    days = cleaning.imputation_dates(v.START, v.END, ["2024-01-06", "2024-01-11", "2024-01-16"])
    return cleaning.impute_rows(v.ledger(spark, d), v.market(spark, d), days).groupBy("date").agg(F.count("*").alias("n"))


@query(Q("market", "SELECT coin_id, date, price, price_sma_5 FROM (SELECT coin_id, date, price, CASE WHEN count(*) OVER w = 5 THEN avg(price) OVER w END AS price_sma_5 FROM market WHERE date <= DATE '2024-01-20' WINDOW w AS (PARTITION BY coin_id ORDER BY date ROWS 4 PRECEDING)) WHERE date >= DATE '2024-01-05'", "price price_sma_5"))
def i10_period_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Indicators over the full history up to the period's end, then the period's rows."""
    m = v.market(spark, d).where(F.col("date") <= v.END).select("coin_id", "date", "price")
    return rounded(cleaning.period(indicators.generate(m, {"price": {"sma": {"window": [5]}}}), v.OPEN, v.END))


@query(Q("market", """SELECT coin_id, avg(price) AS "market|price/mean", max(volume) AS "market|volume/max" FROM market GROUP BY 1""", "market|price/mean market|volume/max"))
def l07_prefixed_features(spark: SparkSession, d: str) -> DataFrame:
    spec = {"price": {"aggregations": ["mean"]}, "volume": {"aggregations": ["max"]}}
    return rounded(flatten.prefixed(flatten.flatten(v.market(spark, d), spec), "market", ["coin_id"], list(spec)))


@query(Q("market", "SELECT w AS time_window, coin_id, avg(price) AS price_mean, arg_max(price, date) AS price_last FROM market JOIN (VALUES (DATE '2024-01-21'), (DATE '2024-01-16'), (DATE '2024-01-11')) t(w) ON date BETWEEN w - 10 AND w - 1 GROUP BY 1, 2", "price_mean price_last", "", 4))
def l09_e07_window_features(spark: SparkSession, d: str) -> DataFrame:
    """Features for every time window in one pass."""
    rows = flatten.in_windows(v.market(spark, d), targets.windows("2024-01-21", 3, 5), 10)
    return rounded(flatten.flatten(rows, {"price": {"aggregations": ["mean", "last"]}}, ["time_window", "coin_id"]), 4)


@query(Q("ledger market", """SELECT w AS time_window, coin_id, sum(abs(usd_net_transfers)) AS total_volume FROM ledger JOIN (VALUES (DATE '2024-01-21'), (DATE '2024-01-16')) t(w) ON date BETWEEN w - 10 AND w - 1 JOIN ok ON ok.time_window = w AND ok.wallet_address = ledger.wallet_address GROUP BY 1, 2""", "total_volume", """ok AS (SELECT w AS time_window, wallet_address FROM (SELECT w, wallet_address, sum(usd_inflows) AS i FROM ledger JOIN (VALUES (DATE '2024-01-21'), (DATE '2024-01-16')) t(w) ON date BETWEEN w - 10 AND w - 1 GROUP BY 1, 2) WHERE i >= 250)"""))
def l10_window_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """A cohort by inflows in each window, and what it moved."""
    rows = flatten.in_windows(v.ledger(spark, d), ["2024-01-21", "2024-01-16"], 10)
    ok = rows.groupBy("time_window", "wallet_address").agg(expr.exact_sum("usd_inflows").alias("i")).where("i >= 250").select("time_window", "wallet_address")
    return rounded(rows.join(ok, ["time_window", "wallet_address"], "left_semi").groupBy("time_window", "coin_id").agg(F.sum(F.abs("usd_net_transfers")).alias("total_volume")))


@query(Q("macro", "SELECT date, total_value, users FROM macro", "total_value"))
def c04_macro_columns(spark: SparkSession, d: str) -> DataFrame:
    m = v.macro(spark, d).withColumn("holes", F.when(F.dayofmonth("date") % 2 == 0, 1.0))
    return rounded(flatten.without_nulls(m, ["total_value", "holes", "users"]))


@query(Q("scores", "SELECT wallet_address, coin_id, CAST(1 + (score > a)::INT + (score > b)::INT + (score > c)::INT AS INTEGER) AS bucket, CAST(1 + (flag > 0.5)::INT AS INTEGER) AS flag_bucket FROM (SELECT *, (wallet_address % 4 = 0)::INT AS flag FROM sc), (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM sc)", "", SCORED))
def c14_quantile_index(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of equal counts, and of equal width where the edges coincide."""
    s = scored(spark, d).withColumn("flag", (F.col("wallet_address") % 4 == 0).cast("double"))
    return coin.quantile_index(coin.quantile_index(s, "score", 4, "bucket"), "flag", 2, "flag_bucket").select("wallet_address", "coin_id", "bucket", "flag_bucket")


@query(Q("ledger scores market", "SELECT p.coin_id, p.wallet_address, p.volume, coalesce(b.balance_end, 0) AS balance_end, ws FROM pm p LEFT JOIN (SELECT coin_id, wallet_address, max(usd_balance) FILTER (date = DATE '2024-01-20') AS balance_end FROM ledger GROUP BY 1, 2) b USING (coin_id, wallet_address) LEFT JOIN (SELECT * FROM ws WHERE ws >= 0.5) w USING (wallet_address)", "volume balance_end ws", PAIRS))
def c21_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = coin.pair_balances(v.ledger(spark, d), v.START, v.END).select("coin_id", "wallet_address", "balance_end")
    w = segments(spark, d).where("ws >= 0.5").select("wallet_address", "ws")
    return rounded(coin.pair_metrics(b, pairs(spark, d).select("coin_id", "wallet_address", "volume"), w, ["ws"]))


@query(Q("ledger scores market macro", "SELECT coin_id, s AS score_mean, t AS total_value_mean, p AS price_mean FROM (SELECT coin_id, avg(score) AS s FROM scores GROUP BY 1) a CROSS JOIN (SELECT avg(total_value) AS t FROM macro) b LEFT JOIN (SELECT coin_id, avg(price) AS p FROM market WHERE coin_id <> 'click' GROUP BY 1) c USING (coin_id)", "score_mean total_value_mean price_mean"))
def c26_coin_matrix(spark: SparkSession, d: str) -> DataFrame:
    w = v.scores(spark, d).groupBy("coin_id").agg(F.avg("score").alias("score_mean"))
    m = flatten.flatten(v.macro(spark, d), {"total_value": {"aggregations": ["mean"]}}, [])
    return rounded(coin.coin_matrix(w, m, flatten.flatten(v.market(spark, d).where("coin_id <> 'click'"), {"price": {"aggregations": ["mean"]}})))


@query(Q("ledger market", "SELECT coin_id, wallet_address, n, p AS price_mean FROM (SELECT coin_id, wallet_address, count(*) AS n FROM ledger GROUP BY 1, 2) LEFT JOIN (SELECT coin_id, avg(price) AS p FROM market WHERE coin_id <> 'click' GROUP BY 1) USING (coin_id)", "price_mean"))
def h05_coin_features_on_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pair rows by id, back to their assets, with the assets' features; NULL where an asset has none."""
    led = v.ledger(spark, d)
    m = coin.hybrid_map(led)
    g = coin.dehybridize(coin.hybridize(led, m).groupBy("hybrid_id").agg(F.count("*").alias("n")), m)
    return rounded(g.join(flatten.flatten(v.market(spark, d).where("coin_id <> 'click'"), {"price": {"aggregations": ["mean"]}}), "coin_id", "left").select("coin_id", "wallet_address", "n", "price_mean"))


@query(Q("ledger market", "SELECT s.wallet_address, coalesce(t.total_volume, 0) AS total_volume, coalesce(t.net_gain, 0) AS net_gain FROM (SELECT DISTINCT wallet_address FROM ledger) s LEFT JOIN trading t USING (wallet_address)", "total_volume net_gain", PERIOD + "," + TRADING, 4))
def g06_wallet_targets(spark: SparkSession, d: str) -> DataFrame:
    t = trading(spark, d).select("wallet_address", "total_volume", "net_gain")
    return rounded(targets.wallet_targets(v.ledger(spark, d), t), 4)


@query(Q("scores market", "SELECT wallet_address, coin_id, r AS coin_return, (rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0) / count(*) OVER () AS coin_return_pctile FROM (SELECT wallet_address, coin_id, coalesce(r, 0) AS r FROM scores LEFT JOIN (SELECT coin_id, max(price) FILTER (date = DATE '2024-01-25') / max(price) FILTER (date = DATE '2024-01-21') - 1 AS r FROM market WHERE coin_id <> 'view' GROUP BY 1) USING (coin_id))", "coin_return coin_return_pctile"))
def g07_pair_targets(spark: SparkSession, d: str) -> DataFrame:
    r = targets.coin_performance(v.market(spark, d).where("coin_id <> 'view'"), v.MODEL_START, v.MODEL_END)
    return rounded(targets.pair_targets(v.scores(spark, d).select("wallet_address", "coin_id"), r, 0.01).select("wallet_address", "coin_id", "coin_return", "coin_return_pctile"))


@query(Q("market", "SELECT coin_id, max(price) FILTER (date = DATE '2024-01-25') / max(price) FILTER (date = DATE '2024-01-21') - 1 AS coin_return FROM market GROUP BY 1", "coin_return"))
def g02_strict_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(targets.strict_returns(v.market(spark, d), v.MODEL_START, v.MODEL_END))


@query("""WITH t AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part WHERE p_partkey % 3 <> 0) SELECT p_partkey, round((p_retailprice - m) / s, 6) + 0.0 AS p_retailprice, CAST(p_type = 'LARGE' AS INTEGER) AS "p_type_LARGE", p_size FROM part, t WHERE p_partkey % 3 = 0""")
def m08_preprocess(spark: SparkSession, d: str) -> DataFrame:
    """The test split as the train split's encoding, drops and scaling make it."""
    p = v.table(spark, d, "part").select("p_partkey", "p_retailprice", "p_type", "p_name", "p_size").withColumn("flat", F.lit(1.0))
    parts = {"train": p.where("p_partkey % 3 <> 0"), "test": p.where("p_partkey % 3 = 0")}
    out = targets.preprocess(parts, ["p_type"], ["p_name"], 0.95, {"p_retailprice": "standard", "flat": "minmax", "p_size": "none"})["test"]
    return rounded(out.select("p_partkey", "p_retailprice", "p_type_LARGE", "p_size"))


@query(Q("ledger market", "SELECT wallet_address, n FROM (SELECT wallet_address, count(*) AS n FROM ledger GROUP BY 1) WHERE wallet_address IN (SELECT wallet_address FROM trading WHERE crypto_inflows >= 300 AND unique_coins_traded <= 5)", "", PERIOD + "," + TRADING))
def m12_modeling_cohort(spark: SparkSession, d: str) -> DataFrame:
    f = v.ledger(spark, d).groupBy("wallet_address").agg(F.count("*").alias("n"))
    return targets.modeling_cohort(f, trading(spark, d), "crypto_inflows", 300.0, "unique_coins_traded", 5)


@query(Q("scores", "SELECT wallet_address, coin_id, score FROM (SELECT *, row_number() OVER (PARTITION BY wallet_address ORDER BY score DESC, coin_id) AS k FROM scores) WHERE k = 1", "score"))
def w01_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The best pair of each wallet by one aggregation, without a sort."""
    best = F.max_by(F.struct("coin_id", "score"), F.struct("score", F.transform(F.split(F.col("coin_id"), ""), lambda c: -F.ascii(c))))
    return rounded(v.scores(spark, d).groupBy("wallet_address").agg(best.alias("b")).select("wallet_address", "b.*"))


@query(Q("", "SELECT date, param, value, score, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS score_rank FROM sr", "score score_rank", "sr AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, o_orderpriority AS param, o_orderstatus AS value, round(avg(o_totalprice) / 100000, 6) AS score FROM orders GROUP BY 1, 2, 3)"))
def b16_rank_by_date(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pct_rank(search(spark, d), "score", "score_rank", ["date"]))


@query(Q("", "SELECT CAST(date AS VARCHAR) AS date, avg(score) AS mean_score, max(score) AS best_score, count(*) AS n FROM sr GROUP BY 1 UNION ALL SELECT 'all', avg(score), max(score), count(*) FROM sr", "mean_score best_score", "sr AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, o_orderpriority AS param, o_orderstatus AS value, round(avg(o_totalprice) / 100000, 6) AS score FROM orders GROUP BY 1, 2, 3)"))
def b13_model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Scores by date, and a summary row."""
    return rounded(evaluate.with_total(search(spark, d), "date", [F.avg("score").alias("mean_score"), F.max("score").alias("best_score"), F.count("*").alias("n")], "all"))


@query(Q("series", "SELECT coin_id, coin_return FROM sr WHERE coin_return IS NOT NULL ORDER BY coin_return DESC, coin_id LIMIT 5", "coin_return", RETURNS))
def x18_top_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series_returns(spark, d).orderBy(F.desc("coin_return"), "coin_id").limit(5))


@query("""SELECT "column", negatives, nulls, infinities FROM (SELECT 'o_orderkey' AS "column", 0::BIGINT AS negatives, count(*) FILTER (o_orderkey IS NULL) AS nulls, 0::BIGINT AS infinities FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice < 0), count(*) FILTER (o_totalprice IS NULL), 0 FROM orders)""")
def p19_offences(spark: SparkSession, d: str) -> DataFrame:
    return checks.offences(v.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query(Q("ledger market", "SELECT coin_id, wallet_address, date, greatest(usd_net_transfers, 0.0) AS bought, greatest(-usd_net_transfers, 0.0) AS sold, CASE WHEN usd_balance = 0 THEN 0 ELSE usd_net_transfers / nullif(usd_balance, 0) END AS turnover, least(usd_balance, 50.0) AS capped FROM ledger", "bought sold turnover capped"))
def p13_p17_scalars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(v.ledger(spark, d).select("coin_id", "wallet_address", "date", expr.positive("usd_net_transfers").alias("bought"), expr.negative("usd_net_transfers").alias("sold"), expr.ratio("usd_net_transfers", "usd_balance").alias("turnover"), expr.clip("usd_balance", high=50.0).alias("capped")))


@query("""SELECT o_orderpriority, least(greatest(o_totalprice, 50000), 300000) AS clipped, count(*) AS n FROM orders WHERE o_totalprice < 50000 OR o_totalprice > 300000 GROUP BY 1, 2""".replace("least(greatest(o_totalprice, 50000), 300000)", "CAST(least(greatest(o_totalprice, 50000), 300000) AS DOUBLE)"))
def p17_clip(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").where("o_totalprice < 50000 or o_totalprice > 300000")
    return o.groupBy("o_orderpriority", expr.clip("o_totalprice", 50000.0, 300000.0).alias("clipped")).agg(F.count("*").alias("n"))


@query(Q("market scores macro", "SELECT b.epoch, count(*) AS n, avg(coin_return) AS mean_return, any_value(total_value) AS total_value FROM by_ b JOIN macro m ON m.date = b.epoch WHERE bought GROUP BY 1", "mean_return total_value", EPOCH_SCORES))
def b09_cycle_results(spark: SparkSession, d: str) -> DataFrame:
    """What each cycle's buys returned, with the macro value at its start."""
    rows = invest.with_macro(bought(spark, d).where("bought"), v.macro(spark, d), "total_value")
    return rounded(rows.groupBy("epoch").agg(F.count("*").alias("n"), F.avg("coin_return").alias("mean_return"), F.first("total_value").alias("total_value")))


@query()
def b03_d06_scored_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Two score models fitted once, then applied to every wallet as of a later date."""
    def features(end: str) -> DataFrame:
        g = v.ledger(spark, d).where(F.col("date") <= end).groupBy("wallet_address")
        return g.agg(F.avg("usd_balance").alias("balance"), F.max("usd_balance").alias("peak"), F.count("*").cast("double").alias("rows"), F.countDistinct("date").cast("double").alias("days"), F.sum(F.abs("usd_net_transfers")).alias("volume"))

    train = features("2024-01-15")
    mid = train.agg(F.median("volume")).first()[0]
    fitted = {n: (models.build("rf_classifier", COLUMNS, label=n, numTrees=5).fit(train.withColumn(n, c.cast("double"))), 0.5) for n, c in (("large", F.col("volume") > mid), ("active", F.col("rows") > 20))}
    return models.score_epochs(fitted, features("2024-01-30"))


@query()
def f56_m11_selected_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Columns cut by variance and correlation, clustered, with the nearest centre as label."""
    m = wallet_matrix(spark, d)
    drop = models.select_features(m, COLUMNS, 0.0, 0.98)
    kept = [c for c in COLUMNS if c in drop.transform(m).columns]
    out = models.cluster_distances(drop.transform(m), kept, min(2, len(kept)), [3])
    return evaluate.group_profile(out.withColumn("cluster", models.nearest_cluster(3)), "cluster", ["volume"])


@query(Q("market scores", "SELECT epoch, coin_id, avg(score) AS score FROM es GROUP BY 1, 2", "score", EPOCH_SCORES))
def a04_two_level(spark: SparkSession, d: str) -> DataFrame:
    """Pair rows to assets of each epoch."""
    return rounded(epoch_scores(spark, d).groupBy("epoch", "coin_id").agg(F.avg("score").alias("score")))


@query(Q("series", "SELECT coin_id, w AS ret FROM (SELECT coin_id, least(greatest(coin_return, lo), hi) AS w FROM sr, (SELECT max(CASE WHEN r = round_even((n - 1) * 0.1, 0) THEN coin_return END) AS lo, max(CASE WHEN r = round_even((n - 1) * 0.9, 0) THEN coin_return END) AS hi FROM (SELECT coin_return, row_number() OVER (ORDER BY coin_return) - 1 AS r, count(*) OVER () AS n FROM sr)))", "ret", RETURNS))
def d08_winsorized_returns(spark: SparkSession, d: str) -> DataFrame:
    """What the return scorers average."""
    return rounded(winsorize(series_returns(spark, d).select("coin_id", F.col("coin_return").alias("ret")), ["ret"], 0.1))

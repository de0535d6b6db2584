"""Queries: indicators, flattening, joins, cohorts, segments, hybrid keys, epochs, targets, splits, preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowledger.operators import coin, flatten, indicators, targets
from flowledger.plans import views as v
from flowledger.plans.oracle import Q, rounded
from flowledger.plans.registry import query


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pair metrics with a score: (coin_id, wallet_address, balance, volume, score)."""
    g = v.ledger(spark, d).groupBy("coin_id", "wallet_address").agg(F.max_by("usd_balance", "date").alias("balance"), F.round(F.sum(F.abs("usd_net_transfers")), 4).alias("volume"))
    return g.join(v.scores(spark, d), ["coin_id", "wallet_address"])


def segments(spark: SparkSession, d: str) -> DataFrame:
    s = v.scores(spark, d).groupBy("wallet_address").agg(F.round(F.avg("score"), 9).alias("ws"))
    s = coin.quantile_buckets(s, "ws", [0.4, 0.8], "score_band")
    return s.withColumn("high", coin.rule_segment({"ws": (0.5, None)})).withColumn("all_wallets", F.lit("all"))


PAIRS = """pm AS (SELECT coin_id, wallet_address, balance, volume, score FROM (SELECT coin_id, wallet_address, arg_max(usd_balance, date) AS balance, round(sum(abs(usd_net_transfers)), 4) AS volume FROM ledger GROUP BY 1, 2) JOIN scores USING (coin_id, wallet_address)),
ws AS (SELECT wallet_address, round(avg(score), 9) AS ws FROM scores GROUP BY 1), eg AS (SELECT quantile_cont(ws, 0.4) AS a, quantile_cont(ws, 0.8) AS b FROM ws),
sg AS (SELECT wallet_address, ws, CASE WHEN ws <= a THEN '0_40pct' WHEN ws <= b THEN '40_80pct' ELSE '80_100pct' END AS score_band, CAST(ws >= 0.5 AS INTEGER) AS high, 'all' AS all_wallets FROM ws, eg),
lg AS (SELECT coin_id, pm.wallet_address, score, m AS metric, CASE m WHEN 'balance' THEN balance ELSE volume END AS value, f AS family, CASE f WHEN 'score_band' THEN score_band WHEN 'high' THEN CAST(high AS VARCHAR) ELSE all_wallets END AS segment FROM pm JOIN sg USING (wallet_address), (VALUES ('balance'), ('volume')) ms(m), (VALUES ('score_band'), ('high'), ('all_wallets')) fs(f))"""
FAMILIES = ["score_band", "high", "all_wallets"]


@query(Q("market", """SELECT coin_id, date, price, CASE WHEN count(*) OVER w3 = 3 THEN avg(price) OVER w3 END AS price_sma_3, CASE WHEN count(*) OVER w5 = 5 THEN CASE WHEN avg(greatest(-dd, 0)) OVER w5 = 0 THEN 1.0 ELSE 1 - 1 / (1 + avg(greatest(dd, 0)) OVER w5 / nullif(avg(greatest(-dd, 0)) OVER w5, 0)) END END AS price_rsi_5,
    CASE WHEN count(*) OVER w5 = 5 THEN avg(price) OVER w5 + 2 * stddev_pop(price) OVER w5 END AS price_bollinger_upper_5, CASE WHEN count(*) OVER w5 = 5 THEN avg(price) OVER w5 - 2 * stddev_pop(price) OVER w5 END AS price_bollinger_lower_5
    FROM (SELECT *, coalesce(price - lag(price) OVER (PARTITION BY coin_id ORDER BY date), 0) AS dd FROM market) WINDOW w3 AS (PARTITION BY coin_id ORDER BY date ROWS 2 PRECEDING), w5 AS (PARTITION BY coin_id ORDER BY date ROWS 4 PRECEDING)""", "price price_sma_3 price_rsi_5 price_bollinger_upper_5 price_bollinger_lower_5"))
def i01_indicators(spark: SparkSession, d: str) -> DataFrame:
    spec = {"price": {"sma": {"window": [3]}, "rsi": {"window": [5]}, "bollinger_upper": {"window": [5], "num_std": 2}, "bollinger_lower": {"window": [5], "num_std": 2}}}
    return rounded(indicators.generate(v.market(spark, d).select("coin_id", "date", "price"), spec))


EMA = """nr AS (SELECT coin_id, date, price, row_number() OVER (PARTITION BY coin_id ORDER BY date) AS k FROM market),
em AS (WITH RECURSIVE r AS (SELECT coin_id, date, price, k, price AS e FROM nr WHERE k = 1 UNION ALL SELECT n.coin_id, n.date, n.price, n.k, r.e * (1 - 2.0 / {n1}) + n.price * 2.0 / {n1} FROM r JOIN nr n ON n.coin_id = r.coin_id AND n.k = r.k + 1) SELECT * FROM r)"""


@query(Q("market", "SELECT coin_id, date, price, CASE WHEN k >= 5 THEN e END AS price_ema_5 FROM em", "price price_ema_5", EMA.format(n1=6)))
def i03_ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.ema_table(v.market(spark, d).select("coin_id", "date", "price"), "price", 5, "price_ema_5"))


@query(Q("market", """SELECT coin_id, date, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING), 0.5) AS mfi FROM (SELECT coin_id, date, CASE WHEN row_number() OVER o >= 5 THEN CASE WHEN sum(n) OVER w = 0 AND sum(p) OVER w > 0 THEN 100 ELSE 100 - 100 / (1 + sum(p) OVER w / nullif(sum(n) OVER w, 0)) END END AS m FROM (SELECT coin_id, date, CASE WHEN price > lag(price) OVER x THEN price * volume ELSE 0 END AS p, CASE WHEN price < lag(price) OVER x THEN price * volume ELSE 0 END AS n FROM market WINDOW x AS (PARTITION BY coin_id ORDER BY date)) WINDOW o AS (PARTITION BY coin_id ORDER BY date), w AS (PARTITION BY coin_id ORDER BY date ROWS 4 PRECEDING))""", "mfi"))
def i06_mfi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.mfi(v.market(spark, d).select("coin_id", "date", "price", "volume"), "price", "volume", 5, "mfi").select("coin_id", "date", "mfi"))


@query(Q("market", """SELECT coin_id, date, obv - first_value(obv) OVER (PARTITION BY coin_id ORDER BY (date < DATE '2024-01-05'), date) AS obv FROM (SELECT coin_id, date, sum(s) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT coin_id, date, coalesce(sign(price - lag(price) OVER (PARTITION BY coin_id ORDER BY date)), 0) * volume AS s FROM market))""", "obv", "", 4))
def i07_i08_obv(spark: SparkSession, d: str) -> DataFrame:
    o = indicators.obv(v.market(spark, d).select("coin_id", "date", "price", "volume"), "price", "volume", "obv")
    return rounded(indicators.rebase(o, "obv", v.OPEN).select("coin_id", "date", "obv"), 4)


@query(Q("market", """SELECT coin_id, date, CASE WHEN p <= 0 AND n > 0 THEN 1 WHEN p >= 0 AND n < 0 THEN -1 ELSE 0 END AS cross FROM (SELECT *, lag(n) OVER (PARTITION BY coin_id ORDER BY date) AS p FROM (SELECT coin_id, date, price - round(avg(price) OVER (PARTITION BY coin_id ORDER BY date ROWS 4 PRECEDING), 6) AS n FROM market))"""))
def i09_crossover(spark: SparkSession, d: str) -> DataFrame:
    w = indicators.over()
    rows = v.market(spark, d).withColumn("slow", F.round(F.avg("price").over(w.rowsBetween(-4, 0)), 6))
    return rows.select("coin_id", "date", indicators.crossover("price", "slow", w).alias("cross"))


SPEC = {"price": {"aggregations": ["sum", "mean", "median", "std", "max", "min", "first", "last"], "rolling": {"duration": 5, "lookbacks": 3, "aggregations": ["sum", "max"], "comparisons": ["change", "pct_change"]}}}
_FLAT = ", ".join([f"{f}(price) AS price_{n}" for n, f in (("sum", "sum"), ("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))] + ["arg_min(price, date) AS price_first", "arg_max(price, date) AS price_last"] + [
    x for i in (1, 2, 3) for x in (f"CASE WHEN count(*) FILTER (b = {i}) = 5 THEN sum(price) FILTER (b = {i}) END AS price_sum_5d_period_{i}", f"CASE WHEN count(*) FILTER (b = {i}) = 5 THEN max(price) FILTER (b = {i}) END AS price_max_5d_period_{i}",
    f"CASE WHEN count(*) FILTER (b = {i}) = 5 THEN arg_max(price, date) FILTER (b = {i}) - arg_min(price, date) FILTER (b = {i}) END AS price_change_5d_period_{i}", f"CASE WHEN count(*) FILTER (b = {i}) = 5 THEN least(arg_max(price, date) FILTER (b = {i}) / arg_min(price, date) FILTER (b = {i}) - 1, 5) END AS price_pct_change_5d_period_{i}")])


@query(Q("market", f"SELECT coin_id, {_FLAT} FROM (SELECT *, (row_number() OVER (PARTITION BY coin_id ORDER BY date DESC) - 1) // 5 + 1 AS b FROM market) GROUP BY 1", " ".join(flatten.names(SPEC))))
def l06_flatten(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flatten.flatten(v.market(spark, d).select("coin_id", "date", "price"), SPEC))


@query(Q("macro", "SELECT sum(total_value) AS total_value_sum, avg(total_value) AS total_value_mean, arg_max(users, date) AS users_last, CASE WHEN count(*) >= 5 THEN (SELECT sum(users) FROM (SELECT users FROM macro ORDER BY date DESC LIMIT 5)) END AS users_sum_5d_period_1 FROM macro", "total_value_sum total_value_mean"))
def l05_flatten_dates(spark: SparkSession, d: str) -> DataFrame:
    spec = {"total_value": {"aggregations": ["sum", "mean"]}, "users": {"aggregations": ["last"], "rolling": {"duration": 5, "lookbacks": 1, "aggregations": ["sum"]}}}
    return rounded(flatten.flatten(v.macro(spark, d), spec, []))


@query(Q("ledger market", """SELECT k.time_window, k.coin_id, coalesce(a.buys, 0) AS buys, m.price_mean, e.total FROM (SELECT time_window, coin_id FROM a UNION SELECT time_window, coin_id FROM m) k LEFT JOIN a USING (time_window, coin_id) LEFT JOIN m USING (time_window, coin_id) LEFT JOIN e USING (time_window)""", "price_mean total",
    """a AS (SELECT CASE WHEN date < DATE '2024-01-16' THEN 'w1' ELSE 'w2' END AS time_window, coin_id, count(*) AS buys FROM ledger WHERE usd_net_transfers > 60 GROUP BY 1, 2), m AS (SELECT CASE WHEN date < DATE '2024-01-16' THEN 'w1' ELSE 'w2' END AS time_window, coin_id, avg(price) AS price_mean FROM market GROUP BY 1, 2), e AS (SELECT CASE WHEN date < DATE '2024-01-16' THEN 'w1' ELSE 'w2' END AS time_window, sum(volume) AS total FROM market GROUP BY 1)"""))
def j09_policy_join(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("date") < "2024-01-16", "w1").otherwise("w2").alias("time_window")
    m = v.market(spark, d)
    sets = {
        "a": (v.ledger(spark, d).where("usd_net_transfers > 60").groupBy(w, "coin_id").agg(F.count("*").alias("buys")), "fill_zeros"),
        "m": (m.groupBy(w, "coin_id").agg(F.avg("price").alias("price_mean")), "retain_nulls"),
        "e": (m.groupBy(w).agg(F.sum("volume").alias("total")), "extend_coin_ids"),
    }
    return rounded(flatten.join_by_policy(sets))


@query(Q("ledger market", """SELECT *, total_profits / nullif(total_inflows, 0) AS return_rate, winning_coins >= 1 AS in_cohort FROM (SELECT wallet_address, sum(i) AS total_inflows, count(*) AS total_coins, count(*) FILTER (p >= 5 AND r >= 0.05) AS winning_coins, sum(p) AS total_profits FROM (SELECT coin_id, wallet_address, arg_max(profits_cumulative, date) AS p, sum(usd_inflows) AS i, arg_max(CASE WHEN usd_inflows <> 0 THEN profits_cumulative / usd_inflows WHEN profits_cumulative > 0 THEN 1e300 ELSE -1e300 END, date) FILTER (usd_inflows <> 0 OR profits_cumulative <> 0) AS r FROM ledger GROUP BY 1, 2) GROUP BY 1) WHERE total_inflows BETWEEN 800 AND 1500""", "total_inflows total_profits return_rate"))
def c01_classify_cohort(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coin.classify_cohort(v.ledger(spark, d), 800, 1500, 5, 0.05, 1))


@query(Q("ledger market", """SELECT g.coin_id, g.date, coalesce(last_value(total_balance IGNORE NULLS) OVER w, 0) AS total_balance, coalesce(last_value(total_holders IGNORE NULLS) OVER w, 0) AS total_holders, coalesce(buyers_new, 0) AS buyers_new, coalesce(buyers_repeat, 0) AS buyers_repeat, coalesce(sellers_new, 0) AS sellers_new, coalesce(total_bought, 0) AS total_bought, coalesce(total_sold, 0) AS total_sold
    FROM (SELECT coin_id, CAST(x AS DATE) AS date FROM (SELECT DISTINCT coin_id FROM big), (SELECT unnest(generate_series((SELECT min(date) FROM big), DATE '2024-01-30', INTERVAL 1 DAY)) AS x)) g LEFT JOIN dy USING (coin_id, date) WINDOW w AS (PARTITION BY g.coin_id ORDER BY g.date ROWS UNBOUNDED PRECEDING)""", "total_balance total_holders buyers_new buyers_repeat sellers_new total_bought total_sold",
    """big AS (SELECT * FROM ledger), sq AS (SELECT *, count(*) FILTER (usd_net_transfers > 0) OVER w AS kb, count(*) FILTER (usd_net_transfers < 0) OVER w AS ks FROM big WINDOW w AS (PARTITION BY coin_id, wallet_address ORDER BY date ROWS UNBOUNDED PRECEDING)),
dy AS (SELECT coin_id, date, sum(usd_balance) AS total_balance, count(DISTINCT wallet_address) AS total_holders, count(*) FILTER (usd_net_transfers > 0 AND kb = 1) AS buyers_new, count(*) FILTER (usd_net_transfers > 0 AND kb > 1) AS buyers_repeat, count(*) FILTER (usd_net_transfers < 0 AND ks = 1) AS sellers_new, sum(greatest(usd_net_transfers, 0.0)) AS total_bought, sum(greatest(-usd_net_transfers, 0.0)) AS total_sold FROM sq GROUP BY 1, 2)"""))
def c02_activity(spark: SparkSession, d: str) -> DataFrame:
    a = coin.activity(v.ledger(spark, d), "2024-01-30")
    return rounded(a.select("coin_id", "date", "total_balance", "total_holders", "buyers_new", "buyers_repeat", "sellers_new", "total_bought", "total_sold"))


@query(Q("meta", "SELECT coin_id, coalesce(list_contains(categories, 'red'), false) AS category_red, coalesce(list_contains(categories, 'ring'), false) AS category_ring, coalesce(lower(chain) = 'economy', false) AS chain_economy, coalesce(lower(chain) = 'small', false) AS chain_small FROM meta"))
def c03_metadata_flags(spark: SparkSession, d: str) -> DataFrame:
    f = coin.metadata_flags(v.meta(spark, d), ["RED", "ring"], 2)
    return f.select("coin_id", "category_red", "category_ring", "chain_economy", "chain_small")


@query(Q("meta", """SELECT coin_id, coalesce(upper(description) LIKE '%RING%', false) AS described, CASE WHEN chain IN ('ECONOMY', 'SMALL') THEN chain ELSE 'Other' END = 'ECONOMY' AS "blockchain/ECONOMY", CASE WHEN chain IN ('ECONOMY', 'SMALL') THEN chain ELSE 'Other' END = 'SMALL' AS "blockchain/SMALL", CASE WHEN chain IN ('ECONOMY', 'SMALL') THEN chain ELSE 'Other' END = 'Other' AS "blockchain/Other" FROM meta"""))
def s05_facts(spark: SparkSession, d: str) -> DataFrame:
    return coin.facts(v.meta(spark, d), ["ECONOMY", "SMALL"], "ring")


@query(Q("ledger scores", "SELECT wallet_address, score_band, high, all_wallets FROM sg", "", PAIRS))
def c11_c13_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).drop("ws")


@query(Q("ledger market", """SELECT coin_id, wallet_address, coalesce(max(usd_balance) FILTER (date = DATE '2024-01-06'), 0) AS balance_start, coalesce(max(usd_balance) FILTER (date = DATE '2024-01-20'), 0) AS balance_end FROM ledger GROUP BY 1, 2""", "balance_start balance_end"))
def c20_pair_balances(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coin.pair_balances(v.ledger(spark, d), v.START, v.END))


@query(Q("ledger scores", """SELECT *, sum / nullif(sum(sum) OVER (PARTITION BY coin_id, family, metric), 0) AS share FROM (SELECT coin_id, family, segment, metric, sum(value) AS sum, count(value) AS count, avg(value) AS mean, median(value) AS median, coalesce(stddev_samp(value), 0) AS std FROM lg GROUP BY 1, 2, 3, 4)""", "sum mean median std share", PAIRS, 5))
def c22_segment_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coin.segment_aggregates(pairs(spark, d), segments(spark, d), ["balance", "volume"], FAMILIES), 5)


@query(Q("ledger scores", "SELECT coin_id, family, segment, metric, sum(score * value) / nullif(sum(value), 0) AS weighted_score FROM lg GROUP BY 1, 2, 3, 4", "weighted_score", PAIRS))
def c23_segment_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coin.segment_scores(pairs(spark, d), segments(spark, d), ["balance", "volume"], FAMILIES))


@query(Q("ledger scores", "SELECT coin_id, family, segment, coalesce(quantile_cont(score, 0.05), 0) AS p5, coalesce(quantile_cont(score, 0.998), 0) AS p99_8, coalesce(median(score), 0) AS median, coalesce(stddev_samp(score), 0) AS std, coalesce(skewness(score), 0) AS skew, coalesce(kurtosis(score), 0) AS kurt FROM lg WHERE metric = 'volume' AND value >= 100 GROUP BY 1, 2, 3", "p5 p99_8 median std skew kurt", PAIRS, 5))
def c24_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = coin.score_distribution(pairs(spark, d), segments(spark, d), "volume", FAMILIES, 100.0)
    return rounded(s.select("coin_id", "family", "segment", "p5", "p99_8", "median", "std", "skew", "kurt"), 5)


@query(Q("ledger scores", """SELECT coin_id, coalesce(sum(value) FILTER (family = 'high' AND segment = '1' AND metric = 'volume'), 0) AS "high/1|volume|sum", coalesce(sum(value) FILTER (family = 'all_wallets' AND metric = 'volume'), 0) AS "all_wallets/all|volume|sum" FROM lg GROUP BY 1""", "high/1|volume|sum all_wallets/all|volume|sum", PAIRS, 4))
def c25_flatten_segments(spark: SparkSession, d: str) -> DataFrame:
    long = coin.segment_aggregates(pairs(spark, d), segments(spark, d), ["balance", "volume"], FAMILIES)
    return rounded(coin.spread(long, ["sum"], [("high", "1", "volume"), ("all_wallets", "all", "volume")]), 4)


@query(Q("ledger scores", """SELECT * FROM (SELECT coin_id, count(*) AS wallets, sum(balance) AS balance FROM pm GROUP BY 1) WHERE wallets >= 100 AND balance >= 1000""", "balance", PAIRS, 4))
def c27_eligible(spark: SparkSession, d: str) -> DataFrame:
    g = pairs(spark, d).groupBy("coin_id").agg(F.count("*").alias("wallets"), F.sum("balance").alias("balance"))
    return rounded(coin.eligible(g, "wallets", "balance", "balance", 100, 1000.0, (0.0, 1e15)), 4)


@query(Q("ledger market", "SELECT coin_id, wallet_address, count(*) AS n FROM ledger GROUP BY 1, 2"))
def h01_h02_hybrid_keys(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to ids and back."""
    led = v.ledger(spark, d)
    m = coin.hybrid_map(led)
    g = coin.hybridize(led, m).groupBy("hybrid_id").agg(F.count("*").alias("n"))
    return coin.dehybridize(g, m).select("coin_id", "wallet_address", "n")


@query(Q("ledger scores", "SELECT pm.coin_id, pm.wallet_address, volume, ws AS cw_ws FROM pm LEFT JOIN ws USING (wallet_address)", "volume cw_ws", PAIRS))
def h04_parent_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coin.with_parent(pairs(spark, d).select("coin_id", "wallet_address", "volume"), segments(spark, d).select("wallet_address", "ws")))


@query(Q("ledger market", "SELECT a AS epoch_start_date, wallet_address, sum(abs(usd_net_transfers)) AS volume FROM ledger JOIN (VALUES (DATE '2024-01-06', DATE '2024-01-15'), (DATE '2024-01-11', DATE '2024-01-20'), (DATE '2024-01-16', DATE '2024-01-25')) e(a, b) ON date BETWEEN a AND b GROUP BY 1, 2", "volume"))
def e03_e05_epochs(spark: SparkSession, d: str) -> DataFrame:
    """A feature for every epoch of an offset list, in one pass over the ledger."""
    e = targets.epochs(spark, {"start_date": "2024-01-06", "end_date": "2024-01-15"}, {"modeling": [0, 5], "validation": [10]})
    rows = targets.in_epochs(v.ledger(spark, d), e)
    return rounded(rows.groupBy("epoch_start_date", "wallet_address").agg(F.sum(F.abs("usd_net_transfers")).alias("volume")))


@query(Q("market", "SELECT coin_id, max(price) FILTER (date = DATE '2024-01-25') / nullif(max(price) FILTER (date = DATE '2024-01-21'), 0) - 1 AS coin_return FROM market GROUP BY 1", "coin_return"))
def g01_coin_performance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(targets.coin_performance(v.market(spark, d), v.MODEL_START, v.MODEL_END))


SERIES_RETURNS = """sr AS (SELECT coin_id || ' ' || strftime(date, '%Y-%m') AS coin_id, round(arg_max(price, date) / arg_min(price, date) - 1, 9) AS coin_return FROM series GROUP BY 1)"""


def series_returns(spark: SparkSession, d: str) -> DataFrame:
    """The return of each series in each month, as an asset of its own."""
    return v.series(spark, d).groupBy(F.concat_ws(" ", "coin_id", F.date_format("date", "yyyy-MM")).alias("coin_id")).agg(F.round(F.max_by("price", "date") / F.min_by("price", "date") - 1, 9).alias("coin_return"))


@query(Q("series", """SELECT coin_id, coin_return, CAST(coin_return >= 0.5 OR (coin_return < 0.5 AND km <= CAST(floor((SELECT count(*) FROM sr) * 0.3) AS BIGINT) - (SELECT count(*) FROM sr WHERE coin_return >= 0.5)) AS INTEGER) AS is_moon, CAST(coin_return <= -0.5 OR kc <= CAST(floor((SELECT count(*) FROM sr) * 0.3) AS BIGINT) - (SELECT count(*) FROM sr WHERE coin_return <= -0.5) AS INTEGER) AS is_crater
    FROM (SELECT *, row_number() OVER (PARTITION BY coin_return >= 0.5 ORDER BY coin_return DESC, coin_id) AS km, row_number() OVER (PARTITION BY coin_return <= -0.5 ORDER BY coin_return, coin_id) AS kc FROM sr)""", "coin_return", SERIES_RETURNS))
def g03_moon_crater(spark: SparkSession, d: str) -> DataFrame:
    return rounded(targets.moon_crater(series_returns(spark, d), 0.5, -0.5, 0.3, 0.3))


@query(Q("market", "SELECT w AS time_window, coin_id, max(price) FILTER (date = w) AS s, max(price) FILTER (date = w + 4) / nullif(max(price) FILTER (date = w), 0) - 1 AS coin_return FROM market JOIN (VALUES (DATE '2024-01-21'), (DATE '2024-01-16'), (DATE '2024-01-11')) t(w) ON date = w OR date = w + 4 GROUP BY 1, 2", "coin_return").replace("SELECT * REPLACE", "SELECT * EXCLUDE (s) REPLACE"))
def g04_window_targets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(targets.window_targets(v.market(spark, d), targets.windows("2024-01-21", 3, 5), 4))


@query(Q("series", """SELECT coin_id, coin_return, least(greatest(coin_return, lo), hi) AS coin_return_winsorized, (rank() OVER (ORDER BY coin_return) + (count(*) OVER (PARTITION BY coin_return) - 1) / 2.0) / count(*) OVER () AS coin_return_pctile FROM sr, e""", "coin_return coin_return_winsorized coin_return_pctile", SERIES_RETURNS + """, k AS (SELECT CAST(round_even((count(*) - 1) * 0.05, 0) AS BIGINT) AS a, CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) AS z FROM sr), o AS (SELECT coin_return AS x, row_number() OVER (ORDER BY coin_return) - 1 AS r FROM sr), e AS (SELECT max(CASE WHEN r = a THEN x END) AS lo, max(CASE WHEN r = z THEN x END) AS hi FROM o, k)"""))
def g05_coin_targets(spark: SparkSession, d: str) -> DataFrame:
    m = series_returns(spark, d)
    prices = m.select("coin_id", F.to_date(F.lit("2024-01-01")).alias("date"), F.lit(1.0).alias("price")).unionByName(m.select("coin_id", F.to_date(F.lit("2024-01-02")).alias("date"), (F.col("coin_return") + 1).alias("price")))
    out = targets.coin_targets(prices, "2024-01-01", "2024-01-02", 0.05)
    return rounded(out)


@query(Q("series", "SELECT coin_id, CASE WHEN coin_return < -0.1 THEN 0 WHEN coin_return >= 0.2 THEN 2 ELSE 1 END AS target3, CAST(coin_return >= -0.2 AND coin_return <= 0.3 AS INTEGER) AS target_band FROM sr", "", SERIES_RETURNS))
def g08_select_target(spark: SparkSession, d: str) -> DataFrame:
    return series_returns(spark, d).select("coin_id", targets.select_target("coin_return", loss=-0.1, win=0.2).alias("target3"), targets.select_target("coin_return", low=-0.2, high=0.3).alias("target_band"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, date_trunc('year', o_orderdate) AS y FROM orders), w AS (SELECT DISTINCT y FROM o ORDER BY y DESC LIMIT 2), c AS (SELECT o_custkey, row_number() OVER (ORDER BY (o_custkey * 2654435761 + 0) % 4294967296, o_custkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM o)),
v AS (SELECT o_custkey FROM c WHERE k <= round_even(n * 0.2, 0)) SELECT o_orderkey, y IN (SELECT y FROM w) AS is_future, o_custkey IN (SELECT o_custkey FROM v) AS is_validation FROM o""")
def m01_m02_splits(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.trunc(F.to_date("o_orderdate"), "year").alias("time_window"))
    return targets.share_split(targets.future_split(o, 2), "o_custkey", 0.2, "is_validation").select("o_orderkey", "is_future", "is_validation")


@query("""SELECT o_orderkey, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'test' WHEN k <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'eval' ELSE 'train' END AS split FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 2654435761 + 0) % 4294967296, o_orderkey) AS k FROM orders)""")
def m04_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return targets.stratified_split(o, "o_orderkey", "o_orderpriority", {"test": 0.2, "eval": 0.1}, "train").select("o_orderkey", "split")


@query("""WITH f AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, min(p_size) AS a, max(p_size) AS b FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, round((p_retailprice - m) / s, 6) + 0.0 AS p_retailprice, round(CAST(p_size - a AS DOUBLE) / (b - a), 6) + 0.0 AS p_size, CAST(p_type = 'PROMO' AS INTEGER) AS p_type_PROMO FROM part, f""")
def m05_m06_scale_encode(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", "p_type")
    train = p.where("p_partkey % 2 = 0")
    out = targets.one_hot(targets.scale(p, train, {"p_retailprice": "standard", "p_size": "minmax"}), train, ["p_type"])
    return rounded(out.select("p_partkey", "p_retailprice", "p_size", "p_type_PROMO"))


@query("""SELECT 'p_type' AS "column", round((SELECT max(c) FROM (SELECT count(*) AS c FROM part GROUP BY p_type)) / count(*), 6) AS share FROM part UNION ALL SELECT 'p_brand', round((SELECT max(c) FROM (SELECT count(*) AS c FROM part GROUP BY p_brand)) / count(*), 6) FROM part""")
def m07_sameness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(targets.sameness(v.table(spark, d, "part"), ["p_type", "p_brand"]))


@query("""SELECT feature, 'low_variance' AS reason FROM (SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem) WHERE v <= 0.01
UNION ALL SELECT 'l_extendedprice', 'correlated' FROM lineitem HAVING abs(corr(l_quantity, l_extendedprice)) > 0.0001""")
def m09_m10_feature_selection(spark: SparkSession, d: str) -> DataFrame:
    """Columns that the selectors drop from the line items."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = v.table(spark, d, "lineitem").select(*cols)
    low = targets.low_variance(li, cols, 0.01, scaled=False)
    rest = [c for c in cols if c not in low]
    return spark.createDataFrame([(c, "low_variance") for c in low] + [(c, "correlated") for c in targets.correlated(li, rest, 0.0001)], "feature string, reason string")

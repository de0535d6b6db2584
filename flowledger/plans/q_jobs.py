"""Queries: jobs over windows and epochs, models with their splits, investment cycles, exports and date tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.operators import checks, coin, flatten, jobs, models, targets, wallet
from flowledger.plans import views as v
from flowledger.plans.oracle import Q, rounded
from flowledger.plans.q_basic import COLUMNS, wallet_matrix
from flowledger.plans.q_evaluate import SCORED, WINSOR, epoch_scores, scored
from flowledger.plans.q_ledger import F61
from flowledger.plans.registry import query
from flowledger.sources import tables

STARTS = ["2024-01-21", "2024-01-16", "2024-01-11"]
WIN = "win(w) AS (VALUES (DATE '2024-01-21'), (DATE '2024-01-16'), (DATE '2024-01-11'))"
RULES = {"min_inflows": 100, "max_inflows": 2000, "profit_win": 1, "return_win": 0.02, "min_wins": 2}

COHORT = WIN + """, dts AS (SELECT w, w - k AS dd FROM win, (VALUES (12), (11), (1)) x(k)),
lr AS (SELECT coin_id, wallet_address, w, dd, max(date) AS ld FROM ledger JOIN dts ON date <= dd GROUP BY 1, 2, 3, 4),
rows_ AS (SELECT w, coin_id, wallet_address, date, usd_net_transfers, usd_balance, usd_inflows, profits_cumulative FROM ledger JOIN win ON date BETWEEN w - 12 AND w - 1 UNION ALL
    SELECT r.w, r.coin_id, r.wallet_address, r.dd, 0.0, l.usd_balance * (n.price / o.price), 0.0, l.profits_cumulative + (n.price / o.price - 1) * l.usd_balance FROM lr r JOIN ledger l ON l.coin_id = r.coin_id AND l.wallet_address = r.wallet_address AND l.date = r.ld JOIN market n ON n.coin_id = r.coin_id AND n.date = r.dd JOIN market o ON o.coin_id = r.coin_id AND o.date = r.ld WHERE r.ld < r.dd),
prs AS (SELECT w, coin_id, wallet_address, arg_max(profits_cumulative, date) AS p, sum(usd_inflows) AS i, arg_max(CASE WHEN usd_inflows <> 0 THEN profits_cumulative / usd_inflows WHEN profits_cumulative > 0 THEN 1e300 ELSE -1e300 END, date) FILTER (usd_inflows <> 0 OR profits_cumulative <> 0) AS r FROM rows_ GROUP BY 1, 2, 3),
coh AS (SELECT w, wallet_address FROM prs GROUP BY 1, 2 HAVING sum(i) BETWEEN 100 AND 2000 AND count(*) FILTER (p >= 1 AND r >= 0.02) >= 2),
sq AS (SELECT *, count(*) FILTER (usd_net_transfers > 0) OVER (PARTITION BY w, coin_id, wallet_address ORDER BY date ROWS UNBOUNDED PRECEDING) AS kb FROM rows_ JOIN coh USING (w, wallet_address)),
dy AS (SELECT w, coin_id, date, sum(usd_balance) AS bal, sum(abs(usd_net_transfers)) AS vol, count(*) FILTER (usd_net_transfers > 0 AND kb = 1) AS fresh FROM sq GROUP BY 1, 2, 3),
gr AS (SELECT c.w, coin_id, CAST(x AS DATE) AS date FROM (SELECT DISTINCT w, coin_id FROM dy) c JOIN (SELECT w, unnest(generate_series(min(date), w - 1, INTERVAL 1 DAY)) AS x FROM dy GROUP BY w) g USING (w)),
fi AS (SELECT w, coin_id, date, coalesce(last_value(bal IGNORE NULLS) OVER o, 0) AS bal, coalesce(vol, 0) AS vol, coalesce(fresh, 0) AS fresh FROM gr LEFT JOIN dy USING (w, coin_id, date) WINDOW o AS (PARTITION BY w, coin_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
sm AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY w, coin_id ORDER BY date) >= 3 THEN avg(vol) OVER (PARTITION BY w, coin_id ORDER BY date ROWS 2 PRECEDING) END AS sma FROM fi)"""


@query(Q("ledger market", "SELECT w AS time_window, coin_id, sum(vol) AS total_volume_sum, arg_max(bal, date) AS total_balance_last, sum(fresh) AS buyers_new_sum, arg_max(sma, date) AS total_volume_sma_3_last FROM sm GROUP BY 1, 2", "total_volume_sum total_balance_last buyers_new_sum total_volume_sma_3_last", COHORT, 4))
def l10_window_cohort_job(spark: SparkSession, d: str) -> DataFrame:
    """What each window's own cohort did: as-of rows, cohort, activity, indicators and flattening in one pass."""
    spec = {"total_volume": {"aggregations": ["sum"]}, "total_balance": {"aggregations": ["last"]}, "buyers_new": {"aggregations": ["sum"]}, "total_volume_sma_3": {"aggregations": ["last"]}}
    return rounded(jobs.window_cohorts(v.ledger(spark, d), v.market(spark, d), STARTS, 10, 12, RULES, spec, {"total_volume": {"sma": {"window": [3]}}}), 4)


@query(Q("market", "SELECT e AS epoch_start_date, coin_id, date, price, sma AS price_sma_5 FROM (SELECT coin_id, date, price, CASE WHEN row_number() OVER o >= 5 THEN avg(price) OVER (PARTITION BY coin_id ORDER BY date ROWS 4 PRECEDING) END AS sma FROM market WINDOW o AS (PARTITION BY coin_id ORDER BY date)) JOIN (VALUES (DATE '2024-01-06'), (DATE '2024-01-11'), (DATE '2024-01-16')) t(e) ON date BETWEEN e AND e + 9", "price price_sma_5"))
def e09_epoch_indicators(spark: SparkSession, d: str) -> DataFrame:
    e = targets.epochs(spark, {"start_date": "2024-01-06", "end_date": "2024-01-15"}, {"modeling": [0, 5], "validation": [10]})
    return rounded(jobs.epoch_indicators(v.market(spark, d).select("coin_id", "date", "price"), {"price": {"sma": {"window": [5]}}}, e))


@query(Q("ledger market", """SELECT coin_id, arg_max(holders, date) AS holders, avg(holders) AS holders_mean, arg_max(pct, date) AS pct_of_ath FROM (SELECT coin_id, date, price / nullif(max(price) OVER w, 0) AS pct, coalesce(last_value(holders IGNORE NULLS) OVER w, 0) AS holders FROM market LEFT JOIN ho USING (coin_id, date) WINDOW w AS (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING)) WHERE date <= DATE '2024-01-20' GROUP BY 1""", "holders_mean pct_of_ath", F61))
def f65_coin_trend_features(spark: SparkSession, d: str) -> DataFrame:
    spec = {"holders": {"aggregations": ["last", "mean"]}, "pct_of_ath": {"aggregations": ["last"]}}
    return rounded(jobs.coin_trend_features(wallet.coin_trends(v.ledger(spark, d), v.market(spark, d), 5.0), spec, v.END))


SPEC = {"price": {"aggregations": ["mean", "last"]}}
EPOCHS = WIN + """, ps AS (SELECT w, coin_id, wallet_address, arg_max(usd_balance, date) AS b FROM ledger JOIN win ON date BETWEEN w - 10 AND w - 1 GROUP BY 1, 2, 3),
wc AS (SELECT w, coin_id, sum(b) AS balance, count(*) AS holders, sum(score * b) / sum(b) AS score_by_balance FROM ps JOIN scores USING (coin_id, wallet_address) WHERE b > 0 GROUP BY 1, 2),
mk AS (SELECT w, coin_id, avg(price) AS price_mean, arg_max(price, date) AS price_last FROM market JOIN win ON date BETWEEN w - 10 AND w - 1 GROUP BY 1, 2),
rt AS (SELECT w, coin_id, max(price) FILTER (date = w + 4) / nullif(max(price) FILTER (date = w), 0) - 1 AS r FROM market JOIN win ON date = w OR date = w + 4 GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY w) AS n FROM rt WHERE r IS NOT NULL),
rw AS (SELECT *, greatest(r, max(CASE WHEN k = CAST(round_even((n - 1) * 0.3, 0) AS BIGINT) THEN r END) OVER (PARTITION BY w)) AS up, max(CASE WHEN k = CAST(round_even((n - 1) * 0.7, 0) AS BIGINT) THEN r END) OVER (PARTITION BY w) AS hi FROM rk)"""


@query(Q("ledger market scores", """SELECT w AS time_window, coin_id, coalesce(balance, 0) AS balance, coalesce(holders, 0) AS holders, coalesce(score_by_balance, 0) AS score_by_balance, price_mean, price_last, r AS coin_return, least(up, hi) AS coin_return_winsorized, (rank() OVER (PARTITION BY w ORDER BY r) + (count(*) OVER (PARTITION BY w, r) - 1) / 2.0) / n AS coin_return_pctile FROM mk LEFT JOIN wc USING (w, coin_id) JOIN rw USING (w, coin_id)""", "balance score_by_balance price_mean price_last coin_return coin_return_winsorized coin_return_pctile", EPOCHS, 5))
def e06_coin_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Features and targets of every asset in every epoch."""
    return rounded(jobs.coin_epochs(v.ledger(spark, d), v.scores(spark, d), v.market(spark, d), STARTS, 10, 5, SPEC, 0.3), 5)


@query(Q("ledger market scores", """SELECT epoch AS epoch_start_date, coin_id, wallet_address, score, least(greatest(r, lo), hi) AS coin_return FROM es JOIN inf USING (epoch, coin_id, wallet_address) JOIN rr USING (epoch, coin_id), ee""", "score coin_return", """ep(epoch, i) AS (VALUES (DATE '2024-01-06', 0), (DATE '2024-01-11', 1), (DATE '2024-01-16', 2), (DATE '2024-01-21', 3)), es AS (SELECT epoch, wallet_address, coin_id, CAST((wallet_address * 7919 + length(coin_id) * 104729 + i * 313) % 1000 AS DOUBLE) / 1000 AS score FROM scores, ep),
inf AS (SELECT epoch, coin_id, wallet_address FROM ledger JOIN ep ON date < epoch GROUP BY 1, 2, 3 HAVING sum(usd_inflows) > 60), rr AS (SELECT epoch, coin_id, max(price) FILTER (date = epoch + 7) / nullif(max(price) FILTER (date = epoch), 0) - 1 AS r FROM market JOIN ep ON date = epoch OR date = epoch + 7 GROUP BY 1, 2 HAVING r IS NOT NULL)""" + WINSOR.format(q=0.1, t="rr", c="r")))
def x12_validation_returns(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs of each epoch with enough inflows before it, against their assets' winsorized returns."""
    s = epoch_scores(spark, d).withColumnRenamed("epoch", "epoch_start_date")
    starts = s.select("epoch_start_date").distinct()
    i = v.ledger(spark, d).join(F.broadcast(starts), F.col("date") < F.col("epoch_start_date")).groupBy("epoch_start_date", "coin_id", "wallet_address").agg(expr.exact_sum("usd_inflows").alias("inflows"))
    return rounded(jobs.validation_returns(s, i, v.market(spark, d), ["2024-01-06", "2024-01-11", "2024-01-16", "2024-01-21"], 7, 60.0, 0.1).select("epoch_start_date", "coin_id", "wallet_address", "score", "coin_return"))


@query(Q("scores", """SELECT 'neg_log_loss' AS metric, -avg(-CASE WHEN actual = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) AS value FROM sc UNION ALL SELECT 'neg_rmse', -sqrt(avg((noisy - score) ** 2)) FROM sc UNION ALL SELECT 'r2', 1 - avg((noisy - score) ** 2) / var_pop(noisy) FROM sc
UNION ALL SELECT 'auc', (sum(k) FILTER (actual = 1) - any_value(a) * (any_value(a) + 1) / 2) / (any_value(a) * (count(*) - any_value(a))) FROM (SELECT actual, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k, sum(actual) OVER () AS a FROM sc)
UNION ALL SELECT 'above_threshold', avg(least(greatest(actual_return, lo), hi)) FROM sc, ee WHERE score >= 0.9""", "value", SCORED + WINSOR.format(q=0.005, t="sc", c="actual_return")))
def d08_scorers(spark: SparkSession, d: str) -> DataFrame:
    """What a search maximises, each on the same scored pairs."""
    s = scored(spark, d)
    rows = [(m, models.MetricEvaluator(m, "actual" if m in ("neg_log_loss", "auc") else "noisy").evaluate(s)) for m in ("neg_log_loss", "auc", "neg_rmse", "r2")]
    rows.append(("above_threshold", models.ReturnEvaluator(above=0.9).evaluate(s)))
    return rounded(spark.createDataFrame(rows, "metric string, value double"))


# models: results hang on Spark ML's own random numbers, so tests hold properties


def window_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Features of every wallet in every window, and what it moved in the five days after."""
    rows = flatten.in_windows(v.ledger(spark, d), STARTS, 10)
    f = rows.groupBy("time_window", "wallet_address").agg(F.sum(F.abs("usd_net_transfers")).alias("volume"), F.avg("usd_balance").alias("balance"), F.max("usd_balance").alias("peak"), F.count("*").cast("double").alias("rows"), F.countDistinct("date").cast("double").alias("days"))
    t = f.select("time_window").distinct()
    later = v.ledger(spark, d).join(F.broadcast(t), F.col("date").between(F.col("time_window"), F.date_add("time_window", 4))).groupBy("time_window", "wallet_address").agg(F.sum("usd_net_transfers").alias("later"))
    return f.join(later, ["time_window", "wallet_address"], "left").na.fill(0, ["later"])


FEATURES = ["volume", *COLUMNS]


@query()
def d04_wallet_model_job(spark: SparkSession, d: str) -> DataFrame:
    """A boosted wallet model from features to metrics on test rows and on the latest window."""
    m = window_matrix(spark, d)
    last = F.col("time_window") == F.lit(STARTS[0]).cast("date")
    done = jobs.model_job(m.where(~last), FEATURES, targets.select_target("later", 0.01), "gbt_classifier", "wallet_address", validation=m.where(last), correlation=0.98, maxIter=5, maxDepth=3)
    return done["metrics"].select("data", "tp", "fp", "tn", "fn", "log_loss", "roc_auc").withColumn("threshold", F.lit(done["threshold"]))


@query()
def d04_coin_model_job(spark: SparkSession, d: str) -> DataFrame:
    """A forest over assets by epoch; its residuals on test rows."""
    starts = [f"2024-01-{k:02}" for k in range(11, 26)]
    e = jobs.coin_epochs(v.ledger(spark, d), v.scores(spark, d), v.market(spark, d), starts, 10, 3, SPEC)
    rows = e.withColumn("number", F.crc32(F.concat_ws("|", F.col("time_window").cast("string"), "coin_id").cast("binary")).cast("long"))
    done = jobs.model_job(rows, ["balance", "holders", "score_by_balance", "price_mean", "price_last"], F.col("coin_return_winsorized"), "rf_regressor", "number", stratum="coin_id", shares={"test": 0.3}, numTrees=10)
    return done["metrics"].select("data", "n", "rmse", "mae", "r2")


@query()
def d06_train_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two scores learned on earlier windows, saved, read again, and given to the wallets of the latest one."""
    m = window_matrix(spark, d)
    last = F.col("time_window") == F.lit(STARTS[0]).cast("date")
    folder = tables.scratch(spark, "scores")
    definitions = {"inflow": {"target": targets.select_target("later", 0.01), "kind": "rf_classifier", "numTrees": 5}, "outflow": {"target": targets.select_target("later", None, -0.01), "kind": "rf_classifier", "threshold": 0.4, "numTrees": 5}}
    for _ in range(2):  # the second time they are only read
        trained = jobs.train_scores(definitions, m.where(~last), FEATURES, "wallet_address", folder)
    return models.score_epochs(trained, m.where(last))


@query()
def b03_b09_investment_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Models of all epochs over by each buying day, their scores on that day, and the returns, by cycle and threshold."""
    starts = [f"2024-01-{k:02}" for k in range(8, 27)]
    e = jobs.coin_epochs(v.ledger(spark, d), v.scores(spark, d), v.market(spark, d), starts, 7, 3, SPEC)
    scored_ = jobs.investment_cycles(e, ["balance", "holders", "score_by_balance", "price_mean", "price_last"], F.col("coin_return_winsorized") > 0, "rf_classifier", ["2024-01-20", "2024-01-23", "2024-01-26"], 3, numTrees=10)
    by_cycle, _ = jobs.cycle_report(scored_, [0.4, 0.5, 0.6])
    return by_cycle


@query()
def d01_k_fold(spark: SparkSession, d: str) -> DataFrame:
    return jobs.k_fold(wallet_matrix(spark, d), COLUMNS, "rf_classifier", "wallet_address", 3, models.MetricEvaluator("auc"), numTrees=5)


@query()
def d07_target_variants(spark: SparkSession, d: str) -> DataFrame:
    """A search in which the target, too, is drawn."""
    m = wallet_matrix(spark, d)
    variants = {"high": (F.col("volume") > 900).cast("double"), "low": (F.col("volume") < 800).cast("double")}
    return models.random_search(m.where("wallet_address % 3 <> 0"), m.where("wallet_address % 3 = 0"), {"maxDepth": [2, 3], "target": ["high", "low"]}, 3, "rf_classifier", COLUMNS, models.MetricEvaluator("neg_log_loss"), variants=variants)


# date tables over the ledger, checks, exports


@query(Q("ledger market", "SELECT period, count(*) AS n, round(sum(usd_net_transfers), 2) + 0.0 AS net FROM ledger JOIN (VALUES ('training', DATE '2024-01-01', DATE '2024-01-15'), ('modeling', DATE '2024-01-16', DATE '2024-01-20'), ('coin_modeling', DATE '2024-01-21', DATE '2024-01-25'), ('investing', DATE '2024-01-26', DATE '2024-01-30')) p(period, a, b) ON date BETWEEN a AND b GROUP BY 1"))
def e01_periods(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows and net flow of each period of a modeling start."""
    p = targets.periods(spark, "2024-01-16", 15, 5)
    rows = v.ledger(spark, d).join(F.broadcast(p), F.col("date").between(F.col("start_date"), F.col("end_date")))
    return rounded(rows.groupBy("period").agg(F.count("*").alias("n"), F.sum("usd_net_transfers").alias("net")), 2)


@query(Q("ledger market", "SELECT w AS time_window, count(*) AS n, count(DISTINCT wallet_address) AS wallets FROM ledger JOIN (VALUES (DATE '2024-01-26'), (DATE '2024-01-22'), (DATE '2024-01-18'), (DATE '2024-01-14')) t(w) ON date BETWEEN w - 4 AND w - 1 GROUP BY 1"))
def e02_windows(spark: SparkSession, d: str) -> DataFrame:
    return flatten.in_windows(v.ledger(spark, d), targets.windows("2024-01-26", 4, 4), 4).groupBy("time_window").agg(F.count("*").alias("n"), F.countDistinct("wallet_address").alias("wallets"))


@query(Q("ledger market", "SELECT CAST(o AS INTEGER) AS offset_days, count(*) AS n FROM ledger JOIN (SELECT DISTINCT a + b AS o FROM (VALUES (0), (5), (10)) x(a), (VALUES (0), (5), (7)) y(b)) ON date = DATE '2024-01-06' + CAST(o AS INTEGER) GROUP BY 1"))
def e04_offset_superset(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows on the start of every epoch that two lists of offsets lead to."""
    o = targets.offset_superset(spark, [0, 5, 10], [0, 5, 7])
    return v.ledger(spark, d).join(F.broadcast(o), F.col("date") == F.date_add(F.lit("2024-01-06").cast("date"), F.col("offset_days"))).groupBy("offset_days").agg(F.count("*").alias("n"))


@query(Q("ledger market", "SELECT wallet_address, 1::BIGINT AS n, true AS known FROM ledger WHERE date BETWEEN DATE '2024-01-06' AND DATE '2024-01-25' GROUP BY 1"))
def e08_one_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Every wallet keeps one of its epochs; which one hangs on a hash, that it is one of its own is checked."""
    e = targets.epochs(spark, {"start_date": "2024-01-06", "end_date": "2024-01-15"}, {"modeling": [0, 5], "validation": [10]})
    own = targets.in_epochs(v.ledger(spark, d), e).select("wallet_address", "epoch_start_date").distinct()
    one = targets.one_epoch(own).join(own.withColumn("_known", F.lit(True)), ["wallet_address", "epoch_start_date"], "left")
    return one.groupBy("wallet_address").agg(F.count("*").alias("n"), F.min(F.coalesce("_known", F.lit(False))).alias("known"))


@query(Q("ledger market", "SELECT offset_days, n FROM (SELECT CAST(o AS INTEGER) AS offset_days, count(*) AS n FROM ledger JOIN (VALUES (0), (5), (10)) t(o) ON date BETWEEN DATE '2024-01-01' + CAST(o AS INTEGER) AND DATE '2024-01-10' + CAST(o AS INTEGER) WHERE DATE '2024-01-10' + CAST(o AS INTEGER) > DATE '2024-01-13' GROUP BY 1)"))
def v14_epoch_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Modeling epochs that reach into the first validation epoch, with the ledger rows that they would take there."""
    e = targets.epochs(spark, {"start_date": "2024-01-01", "end_date": "2024-01-10"}, {"modeling": [0, 5, 10], "validation": [12, 15]})
    bad = targets.overlap(e)
    return v.ledger(spark, d).join(F.broadcast(bad), F.col("date").between(F.col("start_date"), F.col("end_date"))).groupBy("offset_days").agg(F.count("*").alias("n"))


@query("SELECT 'missing' AS side, column_name AS name FROM (DESCRIBE SELECT * FROM orders) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM lineitem)) UNION ALL SELECT 'extra', column_name FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM orders))")
def v03_column_difference(spark: SparkSession, d: str) -> DataFrame:
    found = checks.column_difference(v.table(spark, d, "orders"), v.table(spark, d, "lineitem"))
    return spark.createDataFrame([(s, c) for s in ("missing", "extra", "moved") for c in found[s]], "side string, name string")


@query(Q("ledger market", "SELECT coin_id, wallet_address, 'left' AS side FROM ledger GROUP BY 1, 2 HAVING max(usd_net_transfers) <= 0"))
def v10_hybrid_map_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that a map made of buyers lacks; two pairs with one id would be an error."""
    led = v.ledger(spark, d)
    mapping = coin.hybrid_map(led.where("usd_net_transfers > 0"))
    if coin.collisions(mapping).count():
        raise ValueError("two pairs share an id")
    return checks.key_difference(led, mapping, ["coin_id", "wallet_address"])


@query(Q("market", "SELECT * FROM (SELECT 'price_mean' AS name, count(DISTINCT coin_id) AS n FROM market UNION ALL SELECT 'price_last', count(DISTINCT coin_id) FROM market UNION ALL SELECT 'volume_sum_5d_period_1', count(*) FROM (SELECT coin_id FROM market GROUP BY 1 HAVING count(*) >= 5) UNION ALL SELECT 'volume_sum_5d_period_2', count(*) FROM (SELECT coin_id FROM market GROUP BY 1 HAVING count(*) >= 10))"))
def l08_expected_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a spec leads to, each with the number of assets that have a value there."""
    spec = {"price": {"aggregations": ["mean", "last"]}, "volume": {"rolling": {"duration": 5, "lookbacks": 2, "aggregations": ["sum"]}}}
    flat = flatten.flatten(v.market(spark, d), spec)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNotNull().alias("there")) for c in flatten.names(spec)])
    return flat.select(F.explode(pairs).alias("x")).groupBy("x.name").agg(F.count_if("x.there").alias("n"))


@query(Q("ledger market", "(SELECT 'train' AS name, coin_id, wallet_address, date FROM ledger WHERE date <= DATE '2024-01-15' ORDER BY coin_id, wallet_address, date LIMIT 1000) UNION ALL (SELECT 'test', coin_id, wallet_address, date FROM ledger WHERE date > DATE '2024-01-15' ORDER BY coin_id, wallet_address, date LIMIT 1000)"))
def s16_o05_export(spark: SparkSession, d: str) -> DataFrame:
    """Two splits exported, and the development samples of them read back; the sample is the feature."""
    led = v.ledger(spark, d).select("coin_id", "wallet_address", "date")
    folder = tables.scratch(spark, "export")
    tables.export_splits({"train": led.where("date <= '2024-01-15'"), "test": led.where("date > '2024-01-15'")}, folder, "240101", ["coin_id", "wallet_address", "date"])
    part = lambda n: spark.read.parquet(f"{folder}/{n}_240101_dev").select(F.lit(n).alias("name"), "*")
    return part("train").unionByName(part("test"))

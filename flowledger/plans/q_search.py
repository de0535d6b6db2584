"""Queries: searches over several dates against their baselines, and data sets of time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.operators import flatten, invest, jobs, models
from flowledger.plans import views as v
from flowledger.plans.oracle import Q, rounded
from flowledger.plans.q_basic import COLUMNS, wallet_matrix
from flowledger.plans.registry import query
from flowledger.sources import tables

#: Results of a search as the orders give them: a date for each month, a combination for each priority; 0 is the baseline.
RESULTS = """se AS (SELECT strftime(o_orderdate, '%Y-%m') AS date, CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS combination, round(avg(o_totalprice) / 100000, 6) AS score FROM orders GROUP BY 1, 2),
de AS (SELECT s.date, s.combination, s.score, b.score AS baseline, s.score - b.score AS delta, rank() OVER (PARTITION BY s.date ORDER BY s.score DESC) + (count(*) OVER (PARTITION BY s.date, s.score) - 1) / 2.0 AS place FROM se s LEFT JOIN (SELECT * FROM se WHERE combination = 0) b USING (date) WHERE s.combination <> 0)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("date"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("combination")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("score"))


@query(Q("", "SELECT * FROM de", "score baseline delta place", RESULTS))
def b11_search_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a search against the baseline of their date."""
    return rounded(invest.search_deltas(results(spark, d)))


COMPARE = "count(DISTINCT date) AS dates, avg(score) AS mean_score, avg(delta) AS mean_delta, min(delta) AS worst_delta, avg(place) AS mean_place, avg(CAST(delta > 0 AS DOUBLE)) AS share_better"


@query(Q("", f"SELECT CAST(combination AS VARCHAR) AS combination, {COMPARE} FROM de GROUP BY 1 UNION ALL SELECT 'all', {COMPARE} FROM de", "mean_score mean_delta worst_delta mean_place share_better", RESULTS))
def b13_search_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Combinations compared over dates, with a summary row."""
    return rounded(invest.search_comparison(invest.search_deltas(results(spark, d))))


LEFT_OUT = "lo(combination, feature) AS (VALUES (1, 'a'), (1, 'b'), (2, 'b'), (3, 'a'), (3, 'c'), (4, 'c'))"


@query(Q("", "SELECT feature, count(delta) FILTER (kept) AS n_with, count(delta) FILTER (NOT kept) AS n_without, avg(delta) FILTER (kept) AS mean_with, avg(delta) FILTER (NOT kept) AS mean_without, avg(delta) FILTER (kept) - avg(delta) FILTER (NOT kept) AS worth FROM (SELECT f.feature, de.delta, lo.feature IS NULL AS kept FROM de CROSS JOIN (SELECT DISTINCT feature FROM lo) f LEFT JOIN lo ON lo.combination = de.combination AND lo.feature = f.feature) GROUP BY 1", "mean_with mean_without worth", RESULTS + "," + LEFT_OUT))
def b14_set_scores(spark: SparkSession, d: str) -> DataFrame:
    """What each feature is worth, by the searches with and without it."""
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "a"), (3, "c"), (4, "c")], "combination int, feature string")
    return rounded(invest.set_scores(results(spark, d), sets))


@query()
def d07_date_search(spark: SparkSession, d: str) -> DataFrame:
    """Forests fitted with sampled parameters on two dates, each against the date's baseline."""
    parts = [wallet_matrix(spark, d).withColumn("date", F.lit(day)).withColumn("target", (F.col("volume") > limit).cast("double")) for day, limit in (("2024-01-15", 800), ("2024-01-20", 900))]
    rows = parts[0].unionByName(parts[1]).withColumn("split", F.when(F.col("wallet_address") % 3 == 0, "test").otherwise("train"))
    space = {"maxDepth": [2, 4], "numTrees": [3, 5], "drop_patterns": [["pea*"], ["day*"]]}
    found = models.date_search(rows, space, 2, "rf_classifier", COLUMNS, models.MetricEvaluator("auc"), tables.scratch(spark, "search"))
    return invest.search_deltas(found)


SETS = """w(time_window) AS (VALUES (DATE '2024-01-21'), (DATE '2024-01-16'), (DATE '2024-01-11')), mk AS (SELECT time_window, coin_id, avg(price) AS pm, arg_max(price, date) AS pl FROM market JOIN w ON date BETWEEN time_window - 10 AND time_window - 1 GROUP BY 1, 2),
ma AS (SELECT time_window, sum(total_value) AS tv FROM macro JOIN w ON date BETWEEN time_window - 10 AND time_window - 1 GROUP BY 1),
ic AS (SELECT time_window, wallet_address FROM ledger JOIN w ON date BETWEEN time_window - 10 AND time_window - 1 GROUP BY 1, 2 HAVING sum(usd_inflows) >= 250),
ac AS (SELECT time_window, coin_id, sum(abs(usd_net_transfers)) AS vo, sum(greatest(usd_net_transfers, 0)) AS bo, count(DISTINCT wallet_address) AS wa FROM ledger JOIN w ON date BETWEEN time_window - 10 AND time_window - 1 JOIN ic USING (time_window, wallet_address) GROUP BY 1, 2)"""


def window_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    starts, led = ["2024-01-21", "2024-01-16", "2024-01-11"], v.ledger(spark, d)
    cohort = flatten.in_windows(led, starts, 10).groupBy("time_window", "wallet_address").agg(expr.exact_sum("usd_inflows").alias("i")).where("i >= 250").select("time_window", "wallet_address")
    return jobs.window_datasets(led, v.market(spark, d), v.macro(spark, d), cohort, starts, 10, {"price": {"aggregations": ["mean", "last"]}}, {"total_value": {"aggregations": ["sum"]}})


@query(Q("ledger macro", """SELECT time_window, coin_id, pm AS "market|price_mean", pl AS "market|price_last", coalesce(vo, 0) AS "cohort|volume", coalesce(bo, 0) AS "cohort|bought", coalesce(wa, 0) AS "cohort|wallets", tv AS "macro|total_value_sum" FROM mk LEFT JOIN ac USING (time_window, coin_id) LEFT JOIN ma USING (time_window)""", "market|price_mean market|price_last cohort|volume cohort|bought macro|total_value_sum", SETS, 4))
def e07_window_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Market, macro and cohort features of all time windows, joined by policy."""
    return rounded(window_sets(spark, d)[0], 4)


@query(Q("ledger macro", """SELECT CAST(step AS INTEGER) AS step, name, policy, matched, rows_before, rows_after FROM (SELECT 0 AS step, 'market' AS name, 'drop_records' AS policy, (SELECT count(*) FROM mk) AS matched, (SELECT count(*) FROM (SELECT time_window, coin_id FROM mk UNION SELECT time_window, coin_id FROM ac)) AS rows_before, (SELECT count(*) FROM mk) AS rows_after
    UNION ALL SELECT 1, 'cohort', 'fill_zeros', (SELECT count(*) FROM ac), (SELECT count(*) FROM mk), (SELECT count(*) FROM mk) UNION ALL SELECT 2, 'macro', 'extend_coin_ids', (SELECT count(*) FROM (SELECT time_window, coin_id FROM mk UNION SELECT time_window, coin_id FROM ac) JOIN ma USING (time_window)), (SELECT count(*) FROM mk), (SELECT count(*) FROM mk))""", "", SETS))
def e07_join_log(spark: SparkSession, d: str) -> DataFrame:
    return window_sets(spark, d)[1]


@query(Q("ledger scores", """SELECT a.coin_id, a.holders, b.wallets, b.mean_score FROM (SELECT coin_id, count(DISTINCT wallet_address) AS holders FROM ledger WHERE usd_balance > 100 GROUP BY 1) a JOIN (SELECT coin_id, count(*) AS wallets, avg(score) AS mean_score FROM scores GROUP BY 1) b USING (coin_id)""", "mean_score"))
def j10_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of asset features, joined where both know the asset."""
    held = v.ledger(spark, d).where("usd_balance > 100").groupBy("coin_id").agg(F.countDistinct("wallet_address").alias("holders"))
    scored = v.scores(spark, d).groupBy("coin_id").agg(F.count("*").alias("wallets"), F.avg("score").alias("mean_score"))
    return rounded(jobs.join_features(held, scored))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 45""")
def p09_matching_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that match a glob are dropped, but for the protected ones."""
    li = v.table(spark, d, "lineitem").where("l_quantity > 45")
    wanted = ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus"]
    gone = models.matching(li.columns, ["l_*date", "l_*key", "l_*t", "l_*y", "l_ext*", "l_tax"], wanted)
    return li.drop(*gone)

"""Queries: joins, aggregates, windows, orders, set operations; sinks read back; model jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.functions.order import highest, with_quantiles
from flowledger.operators import cleaning, evaluate, models
from flowledger.plans import views as v
from flowledger.plans.oracle import Q, rounded
from flowledger.plans.q_evaluate import SCORED, scored
from flowledger.plans.registry import query
from flowledger.sources import tables


@query("""SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) + 0.0 AS total, o2.last_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o.o_custkey LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_order FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o2 ON c_custkey = o2.o_custkey""")
def j02_j03_left_joins(spark: SparkSession, d: str) -> DataFrame:
    """A left join filled with 0 in the joined columns alone, and one whose NULLs stay."""
    c, o = v.table(spark, d, "customer").select("c_custkey"), v.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    f = o.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    p = o.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last_order"))
    return rounded(c.join(f, "c_custkey", "left").na.fill(0, ["n", "total"]).join(p, "c_custkey", "left"), 2)


@query(Q("ledger market", "SELECT wallet_address, date, b.n AS bought, s.n AS sold FROM (SELECT wallet_address, date, count(*) AS n FROM ledger WHERE usd_net_transfers > 0 GROUP BY 1, 2) b FULL JOIN (SELECT wallet_address, date, count(*) AS n FROM ledger WHERE usd_net_transfers < 0 GROUP BY 1, 2) s USING (wallet_address, date)"))
def j04_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Buys and sales of each wallet and day, either of which may be missing."""
    led = v.ledger(spark, d)
    n = lambda x, name: x.groupBy("wallet_address", "date").agg(F.count("*").alias(name))
    return n(led.where("usd_net_transfers > 0"), "bought").join(n(led.where("usd_net_transfers < 0"), "sold"), ["wallet_address", "date"], "outer")


@query(Q("ledger macro", "SELECT wallet_address, total_value, users FROM (SELECT DISTINCT wallet_address FROM ledger), (SELECT avg(total_value) AS total_value, max(users) AS users FROM macro)", "total_value"))
def j05_cross_one_row(spark: SparkSession, d: str) -> DataFrame:
    m = v.macro(spark, d).agg(F.avg("total_value").alias("total_value"), F.max("users").alias("users"))
    return rounded(v.ledger(spark, d).select("wallet_address").distinct().crossJoin(F.broadcast(m)))


@query(Q("ledger", "SELECT wallet_address, sum(least(usd_balance, 50) * abs(usd_net_transfers)) / nullif(sum(abs(usd_net_transfers)), 0) AS weighted, coalesce(sum(usd_net_transfers) FILTER (usd_net_transfers > 0), 0) AS bought, count(*) FILTER (usd_net_transfers < 0) AS sales, count(DISTINCT coin_id) AS coins FROM ledger GROUP BY 1", "weighted bought"))
def a01_a03_conditional_weighted(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("usd_net_transfers")
    rows = v.ledger(spark, d).withColumn("c", F.least("usd_balance", F.lit(50))).withColumn("w", F.abs(t))
    return rounded(rows.groupBy("wallet_address").agg(expr.weighted_mean("c", "w").alias("weighted"), expr.sum0(F.when(t > 0, t)).alias("bought"), F.count_if(t < 0).alias("sales"), F.countDistinct("coin_id").alias("coins")))


@query("""SELECT l_shipmode_like AS k, round(quantile_cont(x, 0.002), 4) AS p02, round(quantile_cont(x, 0.998), 4) AS p998, round(median(x), 4) AS median, round(stddev_samp(x), 3) AS std, round(skewness(x), 5) AS skew, round(kurtosis(x), 5) AS kurt FROM (SELECT l_returnflag AS l_shipmode_like, l_quantity * l_quantity AS x FROM lineitem) GROUP BY 1""")
def a05_moments(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") * F.col("l_quantity")).alias("x"))
    x = F.col("x")
    g = rows.groupBy("k").agg(F.round(F.stddev_samp(x), 3).alias("std"), F.round(expr.skewness(x), 5).alias("skew"), F.round(expr.kurtosis(x), 5).alias("kurt"))
    g = with_quantiles(g, rows, ["k"], {"x": "q"}, [0.002, 0.5, 0.998])
    return g.select("k", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p02", "median", "p998"))], "std", "skew", "kurt")


@query("""WITH m AS (SELECT event_type, CAST(ts AS DATE) AS date, round(avg(value), 4) AS p FROM events GROUP BY 1, 2) SELECT event_type, round(product(1 + coalesce(r, 0)) - 1, 4) + 0.0 AS compounded FROM (SELECT event_type, p / lag(p) OVER (PARTITION BY event_type ORDER BY date) - 1 AS r FROM m) GROUP BY 1""")
def a07_compounding(spark: SparkSession, d: str) -> DataFrame:
    m = v.table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 4).alias("p"))
    r = F.try_divide(F.col("p"), F.lag("p").over(Window.partitionBy("event_type").orderBy("date"))) - 1
    return rounded(m.withColumn("r", r).groupBy("event_type").agg((F.product(1 + F.coalesce("r", F.lit(0.0))) - 1).alias("compounded")), 4)


@query(Q("ledger", """SELECT coin_id, wallet_address, date, CASE WHEN usd_net_transfers > 0 THEN count(*) FILTER (usd_net_transfers > 0) OVER w END AS nth_buy, max(usd_balance) OVER w AS high, last_value(CASE WHEN usd_net_transfers < 0 THEN date END IGNORE NULLS) OVER w AS last_sale, sum(usd_balance) OVER (PARTITION BY wallet_address, date) AS day_total, row_number() OVER (PARTITION BY coin_id, wallet_address ORDER BY date DESC) = 1 AS latest
    FROM ledger WINDOW w AS (PARTITION BY coin_id, wallet_address ORDER BY date ROWS UNBOUNDED PRECEDING)""", "high day_total"))
def w01_w07_windows(spark: SparkSession, d: str) -> DataFrame:
    """Nth buy, running maximum, last non-null, group total on rows, latest row of a pair."""
    o = Window.partitionBy("coin_id", "wallet_address").orderBy("date")
    w, t = o.rowsBetween(Window.unboundedPreceding, 0), F.col("usd_net_transfers")
    return rounded(v.ledger(spark, d).select(
        "coin_id", "wallet_address", "date", F.when(t > 0, F.count_if(t > 0).over(w)).alias("nth_buy"), F.max("usd_balance").over(w).alias("high"), F.last(F.when(t < 0, F.col("date")), True).over(w).alias("last_sale"),
        F.sum("usd_balance").over(Window.partitionBy("wallet_address", "date")).alias("day_total"), (F.lead("date").over(o).isNull()).alias("latest"),
    ))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o02_top_n(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT CAST(ceil(count(*) * 0.01) AS BIGINT) FROM orders)")
def o04_top_percent(spark: SparkSession, d: str) -> DataFrame:
    """The top one percent of the rows, one at least."""
    o = v.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return highest(o, "o_totalprice", max(1, -(-o.count() // 100)), ["o_orderkey"]).select("o_orderkey")


@query("""SELECT key, bool_or(a) AS in_a, bool_or(b) AS in_b FROM (SELECT l_partkey AS key, true AS a, false AS b FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT l_partkey, false, true FROM lineitem WHERE l_discount > 0.095) GROUP BY 1 HAVING NOT (bool_or(a) AND bool_or(b))""")
def u02_u05_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the union that aren't in the intersection, with their side: distinct union, intersection, difference."""
    li = v.table(spark, d, "lineitem")
    a, b = li.where("l_quantity > 49").select(F.col("l_partkey").alias("key")), li.where("l_discount > 0.095").select(F.col("l_partkey").alias("key"))
    return a.union(b).distinct().subtract(a.intersect(b)).join(a.distinct().withColumn("in_a", F.lit(True)), "key", "left").na.fill(False).withColumn("in_b", ~F.col("in_a"))


@query(Q("ledger market", "SELECT coin_id, wallet_address, date, usd_balance FROM ledger WHERE wallet_address = 3 AND coin_id = 'click'"))
def p05_pair_filter(spark: SparkSession, d: str) -> DataFrame:
    return v.ledger(spark, d).where("wallet_address = 3 and coin_id = 'click'").select("coin_id", "wallet_address", "date", "usd_balance").orderBy("date")


@query(Q("ledger market", "SELECT coin_id, wallet_address, date, usd_balance FROM ledger WHERE (coin_id, wallet_address) IN (SELECT (coin_id, wallet_address) FROM (SELECT DISTINCT coin_id, wallet_address FROM ledger) ORDER BY (wallet_address * 2654435761) % 4294967296, coin_id LIMIT 10)"))
def p06_pair_sample(spark: SparkSession, d: str) -> DataFrame:
    """All rows of ten pairs in hash order."""
    led = v.ledger(spark, d)
    some = led.select("coin_id", "wallet_address").distinct().orderBy(F.col("wallet_address") * 2654435761 % (1 << 32), "coin_id").limit(10)
    return led.join(F.broadcast(some), ["coin_id", "wallet_address"], "left_semi").select("coin_id", "wallet_address", "date", "usd_balance")


# sinks, read back


@query(Q("market", "SELECT coin_id, date, price, volume FROM market"))
def s09_s10_parquet_cache(spark: SparkSession, d: str) -> DataFrame:
    """Built and written once, read the second time."""
    path = tables.scratch(spark, "market")
    build = lambda: v.market(spark, d).select("coin_id", "date", "price", "volume")
    tables.cached(spark, path, build, covers=("2024-01-01", "2024-01-30"))
    return tables.cached(spark, path, build, covers=("2024-01-01", "2024-01-30"))


@query(Q("market", "SELECT coin_id, date, price, volume FROM market WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"))
def s10_growing_days(spark: SparkSession, d: str) -> DataFrame:
    """A data set that grows: a first period, then a longer one, of which only the days before and after are built."""
    m = v.market(spark, d).select("coin_id", "date", "price", "volume")
    path = tables.scratch(spark, "growing")
    build = lambda a, b: m.where(F.col("date").between(a, b))
    tables.grown(spark, path, build, "2024-01-08", "2024-01-15")
    return tables.grown(spark, path, build, "2024-01-03", "2024-01-25").select("coin_id", "date", "price", "volume")


@query(Q("market", "SELECT coin_id, strftime(date, '%Y-%m-%d') AS day, price, NULL::DOUBLE AS volume FROM market WHERE date < DATE '2024-01-16' UNION ALL SELECT coin_id, strftime(date, '%Y-%m-%d'), price, volume FROM market WHERE date >= DATE '2024-01-16'", "price volume"))
def s11_csv_union(spark: SparkSession, d: str) -> DataFrame:
    m = v.market(spark, d).withColumn("day", F.col("date").cast("string"))
    a, b = tables.scratch(spark, "csv"), tables.scratch(spark, "csv")
    tables.write_csv(m.where("date < '2024-01-16'").select("coin_id", "day", "price"), a, ["coin_id", "day"])
    tables.write_csv(m.where("date >= '2024-01-16'").select("coin_id", "day", "price", "volume"), b, ["coin_id", "day"])
    return rounded(tables.read_csv_union(spark, [a, b], ["coin_id string, day string, price double", "coin_id string, day string, price double, volume double"]))


@query(Q("scores", "SELECT split, count(*) AS n, sum(score) AS total FROM (SELECT *, CASE WHEN wallet_address % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM sc) GROUP BY 1", "total", SCORED))
def s12_model_input(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    path = tables.scratch(spark, "model_input")
    x = s.select("wallet_address", "coin_id", "score", F.when(F.col("wallet_address") % 5 == 0, "test").otherwise("train").alias("split"))
    tables.write_model_input(x, s.select("wallet_address", "coin_id", "actual"), ["wallet_address", "coin_id"], path)
    return rounded(spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"), F.sum("score").alias("total")))


@query(Q("scores", "SELECT epoch, wallet_address, avg(score) AS score FROM scores, (VALUES (DATE '2024-01-06'), (DATE '2024-01-11')) e(epoch) GROUP BY 1, 2", "score"))
def s13_s15_score_append(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two epochs appended with their runs, read again by a glob."""
    w = v.scores(spark, d).groupBy("wallet_address").agg(F.avg("score").alias("score"))
    path, runs = tables.scratch(spark, "scores"), tables.scratch(spark, "runs")
    for e in ("2024-01-06", "2024-01-11"):
        tables.append_scores(w.withColumn("epoch", F.to_date(F.lit(e))), path, runs, {"model": "m"})
    return rounded(tables.read_scores(spark, f"{path}/*.parquet").join(spark.read.parquet(runs).select("run_id"), "run_id").select("epoch", "wallet_address", "score"))


@query(Q("scores", 'SELECT wallet_address, avg(score) AS "score|low", CAST(avg(score) >= 0.4 AS INTEGER) AS "binary|low", avg(score) FILTER (coin_id = \'click\') AS "score|click", CAST(avg(score) FILTER (coin_id = \'click\') >= 0.6 AS INTEGER) AS "binary|click" FROM scores GROUP BY 1', "score|low score|click"))
def s17_c10_wallet_scores(spark: SparkSession, d: str) -> DataFrame:
    s = v.scores(spark, d)
    g = lambda x: x.groupBy("wallet_address").agg(F.avg("score").alias("score"))
    return rounded(tables.join_scores({"low": tables.wallet_scores(g(s), "low", 0.4), "click": tables.wallet_scores(g(s.where("coin_id = 'click'")), "click", 0.6)}))


@query(Q("scores", "SELECT count(*) AS n, avg(score) AS mean FROM scores", "mean"))
def s18_report(spark: SparkSession, d: str) -> DataFrame:
    """A report stored as JSON and loaded by its model's id."""
    path = tables.scratch(spark, "reports")
    one = v.scores(spark, d).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    tables.store_report(spark, path, "m1", one.select(F.to_json(F.struct("*"))).first()[0])
    return rounded(tables.load_report(spark, path, "m1").select(F.from_json("report", "n long, mean double").alias("r")).select("r.*"))


@query(Q("ledger market", "SELECT coin_id, count(*) AS n FROM ledger WHERE wallet_address % 7 = 1 GROUP BY 1"))
def s14_key_upload(spark: SparkSession, d: str) -> DataFrame:
    """The ledger cut to a cohort of keys, as a view that SQL reads."""
    keys = v.ledger(spark, d).select("wallet_address").where("wallet_address % 7 = 1")
    tables.replace_view(v.ledger(spark, d), "cohort_ledger", keys, ["wallet_address"])
    return spark.sql("SELECT coin_id, count(*) AS n FROM cohort_ledger GROUP BY coin_id")


# model jobs: seeded, without an SQL form


def wallet_matrix(spark: SparkSession, d: str) -> DataFrame:
    g = v.ledger(spark, d).groupBy("wallet_address").agg(F.sum(F.abs("usd_net_transfers")).alias("volume"), F.avg("usd_balance").alias("balance"), F.max("usd_balance").alias("peak"), F.count("*").cast("double").alias("rows"), F.countDistinct("date").cast("double").alias("days"))
    return g.withColumn("target", (F.col("volume") > 880).cast("double"))


COLUMNS = ["balance", "peak", "rows", "days"]


@query()
def f55_cluster_distances(spark: SparkSession, d: str) -> DataFrame:
    return models.cluster_distances(wallet_matrix(spark, d), COLUMNS, 2, [2, 4], labels=True)


@query()
def f57_cluster_sweep(spark: SparkSession, d: str) -> DataFrame:
    return models.cluster_sweep(wallet_matrix(spark, d), COLUMNS, [2, 3, 4, 5])


@query()
def d01_d05_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees with early stopping, scored, with the F1 threshold learned on the evaluation rows."""
    m = models.class_weights(wallet_matrix(spark, d)).withColumn("stop", F.col("wallet_address") % 4 == 0)
    fitted = models.build("gbt_classifier", COLUMNS, weight="weight", validation="stop", maxIter=10).fit(m)
    s = models.score(fitted, m)
    t = models.threshold(s.where("stop"), "f1", "target", "score")
    return s.select("wallet_address", "target", "score", (F.col("score") >= t).cast("int").alias("binary"))


@query()
def d03_three_class(spark: SparkSession, d: str) -> DataFrame:
    m = wallet_matrix(spark, d).withColumn("target", F.when(F.col("volume") < 800, 0.0).when(F.col("volume") >= 950, 2.0).otherwise(1.0))
    fitted = models.build("rf_classifier", COLUMNS, numTrees=10).fit(m)
    return models.dispersion(fitted, models.score(fitted, m, classes=(2,)), COLUMNS).select("wallet_address", "target", "score", "confidence")


@query()
def d07_d09_random_search(spark: SparkSession, d: str) -> DataFrame:
    m = wallet_matrix(spark, d).withColumn("actual_return", F.col("volume") / 1000 - 0.5)
    train, test = m.where("wallet_address % 3 <> 0"), m.where("wallet_address % 3 = 0")
    r = models.random_search(train, test, {"maxDepth": [2, 4], "numTrees": [5, 10], "drop_patterns": [["pea*"], ["day*"]]}, 3, "rf_classifier", COLUMNS, models.ReturnEvaluator(share=0.2))
    return models.search_report(r)


@query(Q("ledger market scores", "SELECT CAST(floor(round(score / 0.05, 9)) AS BIGINT) AS k, count(*) AS n, avg(r) AS mean_return, median(r) AS median_return, (floor(round(score / 0.05, 9)) + 0.5) * 0.05 AS midpoint FROM scores JOIN (SELECT coin_id, wallet_address FROM ledger WHERE date <= DATE '2024-01-20' GROUP BY 1, 2 HAVING max(usd_inflows_cumulative) >= 100) USING (coin_id, wallet_address) JOIN (SELECT coin_id, max(price) FILTER (date = DATE '2024-01-25') / nullif(max(price) FILTER (date = DATE '2024-01-21'), 0) - 1 AS r FROM market GROUP BY 1) USING (coin_id) GROUP BY 1, 5", "mean_return median_return midpoint"))
def x12_scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs with enough inflows against the returns of the following days."""
    from flowledger.operators import targets

    led = v.ledger(spark, d).where("date <= '2024-01-20'").groupBy("coin_id", "wallet_address").agg(F.max("usd_inflows_cumulative").alias("i")).where("i >= 100")
    r = targets.coin_performance(v.market(spark, d), v.MODEL_START, v.MODEL_END)
    return rounded(evaluate.step_buckets(v.scores(spark, d).join(led, ["coin_id", "wallet_address"]).join(r.withColumnRenamed("coin_return", "actual_return"), "coin_id")))


@query(Q("market", """SELECT coin_id, date, market_cap_filled FROM (SELECT coin_id, date, coalesce(first_value(market_cap_imputed IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(market_cap_imputed IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) AS market_cap_filled FROM imp2) z
    WHERE coin_id NOT IN (SELECT coin_id FROM imp2 WHERE date = DATE '2024-01-06' AND coalesce(market_cap_imputed, 0) NOT BETWEEN 300000 AND 350000)""", "market_cap_filled", """m2 AS (SELECT * FROM market WHERE date BETWEEN DATE '2024-01-06' AND DATE '2024-01-20'),
k AS (SELECT *, count(market_cap) OVER p / count(*) OVER p AS cover, max(market_cap) OVER p AS most, market_cap / price AS r FROM m2 WINDOW p AS (PARTITION BY coin_id)),
f AS (SELECT *, coalesce(first_value(r IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(r IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS fr FROM k),
imp2 AS (SELECT coin_id, date, CASE WHEN c <= most * 1.5 THEN c END AS market_cap_imputed FROM (SELECT *, coalesce(market_cap, CAST(round_even(price * fr, 0) AS BIGINT)) AS c FROM f))"""))
def t05_market_chain(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.market_chain(v.market(spark, d), 4, 1.0, 0.5, 1.5, 1.0, v.START, v.END, cap_start=(300_000, 350_000))
    return rounded(out.select("coin_id", "date", F.col("market_cap_filled").cast("double").alias("market_cap_filled")))

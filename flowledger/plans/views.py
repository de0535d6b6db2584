"""The ledger, market, macro and other base tables, derived from the given tables; in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, START, END = "2024-01-05", "2024-01-06", "2024-01-20"
MODEL_START, MODEL_END = "2024-01-21", "2024-01-25"
PAIR = ["coin_id", "wallet_address"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset x day series with holes in market_cap and lineage in days_imputed."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("coin_id"), F.to_date("ts").alias("date"), "value")
    day = F.dayofmonth("date")
    m = e.groupBy("coin_id", "date").agg(F.round(F.avg("value"), 6).alias("price"), F.round(F.sum("value"), 4).alias("volume"))
    cap = F.round(F.col("price") * 1000 * (1 + F.length("coin_id"))).cast("long")
    return m.withColumn("market_cap", F.when(day % 5 != 0, cap)).withColumn("days_imputed", F.when(day % 5 >= 3, (day % 5).cast("long")))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    m = e.groupBy("date").agg(F.round(F.sum("value"), 4).alias("total_value"), F.count("*").alias("n_events"), F.countDistinct("user_id").alias("users"))
    return m.where(F.dayofmonth("date") % 3 != 0)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse wallet x asset x day ledger."""
    e = table(spark, sf_dir, "events")
    signed = F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value"))
    net = e.groupBy(F.col("event_type").alias("coin_id"), F.col("user_id").alias("wallet_address"), F.to_date("ts").alias("date")).agg(F.round(F.sum(signed), 2).alias("usd_net_transfers"))
    priced = net.join(market(spark, sf_dir).select("coin_id", "date", "price"), ["coin_id", "date"])
    w = Window.partitionBy(*PAIR).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.greatest(F.sum(F.col("usd_net_transfers") / F.col("price")).over(w), F.lit(0.0))
    inflow = F.greatest("usd_net_transfers", F.lit(0.0))
    rows = priced.select(*PAIR, "date", "usd_net_transfers", F.round(tokens * F.col("price"), 2).alias("usd_balance"), inflow.alias("usd_inflows"), F.round(F.sum(inflow).over(w), 2).alias("usd_inflows_cumulative"), F.round(F.sum("usd_net_transfers").over(w), 2).alias("_net"))
    return rows.withColumn("profits_cumulative", F.round(F.col("usd_balance") - F.col("_net"), 2)).withColumn("is_imputed", F.lit(False)).drop("_net")


def ledger_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger, sparser ledger from line items: (coin_id, wallet_address, date, usd_net_transfers)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("v"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("wallet_address"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("coin_id"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("coin_id", "wallet_address", "date").agg(F.round(F.sum("v"), 2).alias("usd_net_transfers"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily series per order priority with missing days: (coin_id, date, price, volume)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("coin_id"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return o.groupBy("coin_id", "date").agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.count("*").cast("double").alias("volume"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every wallet-asset pair: (wallet_address, coin_id, score)."""
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("wallet_address"), F.col("event_type").alias("coin_id")).distinct()
    return pairs.withColumn("score", (F.col("wallet_address") * 7919 + F.length("coin_id") * 104729) % 1000 / 1000.0)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset metadata: (coin_id, categories, chain, description)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("coin_id"), F.split("p_name", " ").alias("categories"), F.col("p_type").alias("chain"), F.col("p_name").alias("description"))


_SQL = {
    "market": """market AS (SELECT *, CASE WHEN day(date) % 5 <> 0 THEN CAST(round(price * 1000 * (1 + length(coin_id))) AS BIGINT) END AS market_cap,
        CASE WHEN day(date) % 5 >= 3 THEN CAST(day(date) % 5 AS BIGINT) END AS days_imputed
        FROM (SELECT event_type AS coin_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS price, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2))""",
    "macro": """macro AS (SELECT CAST(ts AS DATE) AS date, round(sum(value), 4) AS total_value, count(*) AS n_events, count(DISTINCT user_id) AS users
        FROM events GROUP BY 1 HAVING day(CAST(ts AS DATE)) % 3 <> 0)""",
    "ledger": """flows AS (SELECT event_type AS coin_id, user_id AS wallet_address, CAST(ts AS DATE) AS date, round(sum(CASE WHEN event_id % 3 = 0 THEN -value ELSE value END), 2) AS usd_net_transfers FROM events GROUP BY 1, 2, 3),
        running AS (SELECT f.*, greatest(f.usd_net_transfers, 0.0) AS usd_inflows, m.price, greatest(sum(f.usd_net_transfers / m.price) OVER w, 0.0) AS tokens, round(sum(greatest(f.usd_net_transfers, 0.0)) OVER w, 2) AS usd_inflows_cumulative, round(sum(f.usd_net_transfers) OVER w, 2) AS net
            FROM flows f JOIN market m USING (coin_id, date) WINDOW w AS (PARTITION BY coin_id, wallet_address ORDER BY date ROWS UNBOUNDED PRECEDING)),
        ledger AS (SELECT coin_id, wallet_address, date, usd_net_transfers, round(tokens * price, 2) AS usd_balance, usd_inflows, usd_inflows_cumulative, round(round(tokens * price, 2) - net, 2) AS profits_cumulative, false AS is_imputed FROM running)""",
    "ledger_large": """ledger_large AS (SELECT CAST(s_nationkey AS BIGINT) AS coin_id, o_custkey AS wallet_address, CAST(l_shipdate AS DATE) AS date, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS usd_net_transfers
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)""",
    "series": """series AS (SELECT o_orderpriority AS coin_id, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 4) AS price, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)""",
    "scores": """scores AS (SELECT DISTINCT user_id AS wallet_address, event_type AS coin_id, CAST((user_id * 7919 + length(event_type) * 104729) % 1000 AS DOUBLE) / 1000 AS score FROM events)""",
    "meta": """meta AS (SELECT p_partkey AS coin_id, string_split(p_name, ' ') AS categories, p_type AS chain, p_name AS description FROM part)""",
}
_NEEDS = {"ledger": ["market"]}


def sql(body: str, *names: str) -> str:
    """``body`` with the named views in front; a body that starts with more common tables starts with a comma."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(_SQL[n] for n in order) + "\n" + body

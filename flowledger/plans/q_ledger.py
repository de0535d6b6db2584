"""Queries: cleaning, imputation, checks, wallet families."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.functions.order import pct_rank, winsorize
from flowledger.operators import checks, cleaning, wallet
from flowledger.plans import views as v
from flowledger.plans.oracle import COST, PERIOD, TRADING, Q, rounded
from flowledger.plans.registry import query
from flowledger.sources import tables

TRADING_DOUBLES = "crypto_inflows crypto_outflows net_crypto_flows net_gain max_investment total_volume average_transaction cash_buys cash_sells net_cash_flow"
ROW_DOUBLES = "usd_net_transfers usd_balance usd_inflows usd_inflows_cumulative profits_cumulative"


def period(spark: SparkSession, d: str) -> DataFrame:
    """The training period's ledger with opening and closing rows."""
    rows = cleaning.period(cleaning.with_imputed(v.ledger(spark, d), v.market(spark, d), [v.OPEN, v.END]), v.OPEN, v.END)
    rows = cleaning.normalise_opening(rows, v.OPEN)
    return rows.withColumns({c: expr.tidy(c) for c in ("usd_balance", "usd_inflows_cumulative", "profits_cumulative")})


def trading(spark: SparkSession, d: str) -> DataFrame:
    return wallet.trading(period(spark, d), v.START, v.END)


@query(Q("ledger market", f"SELECT wallet_address, {', '.join(f'CASE WHEN {b} = 0 THEN 0 ELSE net_gain / nullif({b}, 0) END AS net_gain_{b}' for b in wallet.BASES)}, " + TRADING_DOUBLES.replace(" ", ", ") + ", unique_coins_traded, transaction_days FROM trading", TRADING_DOUBLES + " " + " ".join(f"net_gain_{b}" for b in wallet.BASES), PERIOD + "," + TRADING, 4))
def flagship_trading_performance(spark: SparkSession, d: str) -> DataFrame:
    """As-of rows, trading features and profit ratios of every wallet for the training period."""
    t = trading(spark, d)
    return rounded(t.select("*", *[expr.ratio("net_gain", b).alias(f"net_gain_{b}") for b in wallet.BASES]), 4)


@query(Q("market", "SELECT coin_id, date, price, volume, market_cap FROM market WHERE date <= DATE '2024-01-20' AND price >= 0 AND volume >= 0"))
def s01_market_scan(spark: SparkSession, d: str) -> DataFrame:
    return v.market(spark, d).where("date <= '2024-01-20' and price >= 0 and volume >= 0").select("coin_id", "date", "price", "volume", "market_cap")


@query(Q("ledger market", f"""SELECT coin_id, wallet_address, date, usd_net_transfers, usd_balance, CASE WHEN usd_inflows > 0 THEN greatest(usd_inflows, 0.01) ELSE usd_inflows END AS usd_inflows, usd_inflows_cumulative, profits_cumulative, is_imputed FROM (
    SELECT * FROM kept WHERE date BETWEEN DATE '2024-01-06' AND DATE '2024-01-20' UNION ALL
    SELECT l.coin_id, l.wallet_address, DATE '2024-01-06', 0.0, l.usd_balance * n.price / o.price, 0.0, l.usd_inflows_cumulative, l.profits_cumulative + (n.price / o.price - 1) * l.usd_balance, true
    FROM (SELECT coin_id, wallet_address, max(date) AS ld FROM kept WHERE date <= DATE '2024-01-06' GROUP BY 1, 2) r JOIN kept l ON l.coin_id = r.coin_id AND l.wallet_address = r.wallet_address AND l.date = r.ld JOIN market n ON n.coin_id = r.coin_id AND n.date = DATE '2024-01-06' JOIN market o ON o.coin_id = r.coin_id AND o.date = r.ld WHERE r.ld < DATE '2024-01-06')""", ROW_DOUBLES,
    """kept AS (SELECT coin_id, wallet_address, date, usd_net_transfers, usd_balance, usd_inflows, usd_inflows_cumulative, profits_cumulative, is_imputed FROM ledger WHERE date <= DATE '2024-01-20' AND (coin_id, wallet_address) IN (SELECT (coin_id, wallet_address) FROM ledger WHERE date <= DATE '2024-01-20' GROUP BY coin_id, wallet_address HAVING max(usd_inflows_cumulative) >= 50))""", 4))
def s02_ledger_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.scan_ledger(v.ledger(spark, d), v.market(spark, d), v.START, v.END, 50.0), 4)


@query(Q("macro market", """SELECT d.date, m.total_value, m.n_events, k.price FROM (SELECT date FROM macro UNION SELECT date FROM market WHERE coin_id = 'click') d LEFT JOIN macro m USING (date) LEFT JOIN (SELECT date, price FROM market WHERE coin_id = 'click') k USING (date)""", "total_value price"))
def s03_macro_scan(spark: SparkSession, d: str) -> DataFrame:
    """Union of date spines with each series joined."""
    m, k = v.macro(spark, d), v.market(spark, d).where("coin_id = 'click'").select("date", "price")
    return rounded(m.select("date").union(k.select("date")).distinct().join(m.select("date", "total_value", "n_events"), "date", "left").join(k, "date", "left"))


@query(Q("meta ledger_large", "SELECT c.coin_id, chain, description FROM (SELECT DISTINCT coin_id FROM ledger_large) c JOIN meta USING (coin_id)"))
def s04_metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    return v.ledger_large(spark, d).select("coin_id").distinct().join(v.meta(spark, d), "coin_id").select("coin_id", "chain", "description")


@query(Q("ledger market", "SELECT wallet_address, coin_id, count(*) AS n FROM ledger WHERE date BETWEEN DATE '2024-01-06' AND DATE '2024-01-20' GROUP BY 1, 2"))
def p01_period_filter(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.period(v.ledger(spark, d), v.START, v.END).groupBy("wallet_address", "coin_id").agg(F.count("*").alias("n"))


@query(Q("series", "SELECT coin_id, min(date) <= DATE '1994-01-01' AND max(date) >= DATE '1998-01-01' AS full, count(*) AS n FROM series GROUP BY 1"))
def p02_coverage_split(spark: SparkSession, d: str) -> DataFrame:
    full, part = cleaning.coverage_split(v.series(spark, d), "1994-01-01", "1998-01-01")
    both = full.withColumn("full", F.lit(True)).unionByName(part.withColumn("full", F.lit(False)))
    return both.groupBy("coin_id", "full").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment, (c_custkey IN (SELECT o_custkey FROM p)) AS large FROM customer""")
def p03_p04_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a large order, and the others."""
    c, p = v.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), v.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(p, "c_custkey", "left_semi").withColumn("large", F.lit(True)).unionByName(c.join(p, "c_custkey", "left_anti").withColumn("large", F.lit(False)))


@query(Q("market", "SELECT 'price' AS \"column\", count(*) FILTER (price IS NULL) AS nulls FROM market UNION ALL SELECT 'market_cap', count(*) FILTER (market_cap IS NULL) FROM market UNION ALL SELECT 'days_imputed', count(*) FILTER (days_imputed IS NULL) FROM market"))
def p07_null_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.null_counts(v.market(spark, d).select("price", "market_cap", "days_imputed"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem), n AS (SELECT count(x) AS n FROM b),
k AS (SELECT CAST(round_even((n - 1) * 0.05, 0) AS BIGINT) AS a, CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) AS z FROM n),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r FROM b), e AS (SELECT max(CASE WHEN r = a THEN x END) AS lo, max(CASE WHEN r = z THEN x END) AS hi FROM o, k)
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, round(least(greatest(x, lo), hi), 2) AS x FROM b, e""")
def p12_winsorize(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    return rounded(winsorize(rows, ["x"], 0.05), 2)


@query(Q("ledger market", """SELECT wallet_address, coin_id, CASE WHEN a IS NULL OR b IS NULL OR (a = 0 AND b = 0) THEN 0 WHEN a = 0 THEN least(b - 1, 5) ELSE least(b / nullif(a, 0) - 1, 5) END AS change,
    CASE WHEN b <= 10 THEN 'small' WHEN b <= 100 THEN 'medium' ELSE 'large' END AS bucket FROM (SELECT wallet_address, coin_id, arg_min(usd_balance, date) AS a, arg_max(usd_balance, date) AS b FROM ledger GROUP BY 1, 2)""", "change"))
def p14_p15_change_bucket(spark: SparkSession, d: str) -> DataFrame:
    g = v.ledger(spark, d).groupBy("wallet_address", "coin_id").agg(F.min_by("usd_balance", "date").alias("a"), F.max_by("usd_balance", "date").alias("b"))
    return rounded(g.select("wallet_address", "coin_id", expr.pct_change("a", "b").alias("change"), expr.bucketize("b", {"small": 10, "medium": 100}, "large").alias("bucket")))


@query(Q("ledger market", """SELECT min(date) = DATE '2024-01-05' AS starts, max(date) = DATE '2024-01-20' AS ends, count(*) FILTER (coin_id IS NULL OR wallet_address IS NULL) AS null_ids, count(*) FILTER (is_imputed AND date NOT IN (DATE '2024-01-05', DATE '2024-01-20')) AS imputed_inside, count(*) FILTER (date = DATE '2024-01-05' AND (usd_net_transfers <> 0 OR usd_inflows <> 0 OR NOT is_imputed)) AS bad_opening FROM period""", "", PERIOD))
def v01_assert_period(spark: SparkSession, d: str) -> DataFrame:
    return checks.period_facts(period(spark, d), v.START, v.END)


@query("""SELECT coalesce(c_custkey, user_id) AS key, CASE WHEN user_id IS NULL THEN 'left' ELSE 'right' END AS side FROM customer FULL JOIN (SELECT DISTINCT user_id FROM events) ON c_custkey = user_id WHERE c_custkey IS NULL OR user_id IS NULL""")
def v02_key_difference(spark: SparkSession, d: str) -> DataFrame:
    return checks.key_difference(v.table(spark, d, "customer").select(F.col("c_custkey").alias("key")), v.table(spark, d, "events").select(F.col("user_id").alias("key")), ["key"])


@query(Q("ledger market", """SELECT (SELECT count(*) FROM (SELECT 1 FROM ledger GROUP BY coin_id, wallet_address, date HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM (SELECT DISTINCT coin_id, date FROM ledger) l WHERE NOT EXISTS (SELECT 1 FROM market m WHERE m.coin_id = l.coin_id AND m.date = l.date AND m.market_cap IS NOT NULL)) AS unpriced,
    (SELECT count(DISTINCT CASE WHEN usd_net_transfers > 20 THEN wallet_address END) / count(DISTINCT wallet_address) FROM ledger) AS covered""", "covered"))
def v04_feature_input(spark: SparkSession, d: str) -> DataFrame:
    led = v.ledger(spark, d)
    return rounded(checks.feature_input(led, v.market(spark, d).where("market_cap is not null"), led.where("usd_net_transfers > 20")))


@query(Q("market", """SELECT coin_id, count(*) AS nulls FROM market m WHERE market_cap IS NULL AND date > (SELECT min(date) FROM market x WHERE x.coin_id = m.coin_id AND market_cap IS NOT NULL) AND date < (SELECT max(date) FROM market x WHERE x.coin_id = m.coin_id AND market_cap IS NOT NULL) GROUP BY 1"""))
def v05_interior_nulls(spark: SparkSession, d: str) -> DataFrame:
    return checks.interior_nulls(v.market(spark, d), "market_cap")


@query(Q("series", "SELECT * FROM (SELECT coin_id, max(date) AS last, CAST(date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS BIGINT) AS missing FROM series GROUP BY 1) WHERE missing > 0 OR last <> DATE '1998-08-02'"))
def v06_calendar_gaps(spark: SparkSession, d: str) -> DataFrame:
    return checks.calendar_gaps(v.series(spark, d), "1998-08-02")


@query(Q("market", """SELECT arg_max(n, date) AS latest, min(n) AS least, arg_max(n, date) - min(n) AS increase, CAST(arg_max(n, date) - min(n) AS DOUBLE) / nullif(min(n), 0) AS increase_share FROM (SELECT date, count(days_imputed) AS n FROM market GROUP BY 1) WHERE date >= (SELECT max(date) FROM market) - 10""", "increase_share"))
def v07_price_staleness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.staleness(v.market(spark, d), 10))


@query(Q("ledger_large", """SELECT arg_max(n, date) AS latest, max(n) AS most, CAST(max(n) - arg_max(n, date) AS DOUBLE) / nullif(max(n), 0) AS drop_share FROM (SELECT date, count(DISTINCT coin_id) AS n FROM ledger_large GROUP BY 1) WHERE date >= (SELECT max(date) FROM ledger_large) - 30""", "drop_share"))
def v08_transfer_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.coverage(v.ledger_large(spark, d), 30))


@query(Q("macro", "SELECT max(gap) AS longest, count(*) FILTER (gap > 6) AS too_long FROM (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM macro)"))
def v09_macro_gaps(spark: SparkSession, d: str) -> DataFrame:
    return checks.series_gaps(v.macro(spark, d))


@query(Q("ledger market", """SELECT (SELECT round(sum(abs(usd_net_transfers)), 2) FROM ledger WHERE date BETWEEN DATE '2024-01-07' AND DATE '2024-01-20') AS windows, (SELECT round(sum(abs(usd_net_transfers)), 2) FROM ledger WHERE date BETWEEN DATE '2024-01-07' AND DATE '2024-01-20') AS whole""", "windows whole"))
def v13_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Transfers of the windows add up to those of the whole period."""
    led = v.ledger(spark, d)
    return rounded(checks.conservation(cleaning.split_windows(led, ["2024-01-07", "2024-01-12", "2024-01-16"], v.END), cleaning.period(led, "2024-01-07", v.END)))


@query(Q("market", """SELECT coin_id, date, price, volume, market_cap FROM market WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' AND coin_id IN (SELECT coin_id FROM market GROUP BY 1 HAVING coalesce(max(days_imputed), 0) <= 4 AND avg(volume) >= 100)""", "price volume"))
def t01_clean_market(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.clean_market(v.market(spark, d), 4, 100.0, "2024-01-01", "2024-01-30"))


@query(Q("series", """SELECT g.coin_id, g.date, last_value(price IGNORE NULLS) OVER w AS price, last_value(volume IGNORE NULLS) OVER w AS volume FROM g LEFT JOIN series s ON s.coin_id = g.coin_id AND s.date = g.date WINDOW w AS (PARTITION BY g.coin_id ORDER BY g.date ROWS UNBOUNDED PRECEDING)""", "price volume",
    "g AS (SELECT coin_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM series GROUP BY coin_id)"))
def t02_densify(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.densify(v.series(spark, d), ["coin_id"]))


T03 = """k AS (SELECT *, count(market_cap) OVER p / count(*) OVER p AS cover, max(market_cap) OVER p AS most, market_cap / price AS r FROM market WINDOW p AS (PARTITION BY coin_id)),
f AS (SELECT *, coalesce(first_value(r IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(r IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS fr FROM k),
i AS (SELECT *, CASE WHEN cover >= 0.5 AND cover < 1 THEN coalesce(market_cap, CAST(round_even(price * fr, 0) AS BIGINT)) ELSE market_cap END AS c FROM f),
imp AS (SELECT coin_id, date, price, volume, market_cap, days_imputed, CASE WHEN c <= most * 1.5 THEN c END AS market_cap_imputed FROM i)"""


@query(Q("market", "SELECT coin_id, date, market_cap, market_cap_imputed FROM imp", "", T03))
def t03_impute_market_cap(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.impute_market_cap(v.market(spark, d), 0.5, 1.5).select("coin_id", "date", "market_cap", "market_cap_imputed")


@query(Q("market", """SELECT coin_id, date, coalesce(first_value(market_cap IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(market_cap IGNORE NULLS) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING), 7.0) AS filled FROM market""", "filled"))
def t04_force_fill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.force_fill(v.market(spark, d), "market_cap", "filled", 7.0).select("coin_id", "date", F.col("filled").cast("double").alias("filled")))


@query(Q("ledger market", """SELECT wallet_address, sum(v) AS total_inflows FROM (SELECT coin_id, wallet_address, arg_max(usd_inflows_cumulative, date) AS v FROM ledger GROUP BY 1, 2) GROUP BY 1 HAVING sum(v) >= 700""", "total_inflows"))
def t06_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.clean_ledger(v.ledger(spark, d), 700.0)[1])


@query(Q("ledger market", "SELECT * FROM made", ROW_DOUBLES, PERIOD))
def t07_asof_imputation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.impute_rows(v.ledger(spark, d), v.market(spark, d), [v.OPEN, v.END]))


@query(Q("ledger market", f"SELECT coin_id, wallet_address, date, round(usd_net_transfers, 2) + 0.0 AS usd_net_transfers, usd_balance, round(usd_inflows, 2) + 0.0 AS usd_inflows, usd_inflows_cumulative, profits_cumulative, is_imputed FROM period WHERE NOT (usd_balance = 0 AND usd_net_transfers = 0) AND wallet_address NOT IN (SELECT wallet_address FROM (SELECT coin_id, wallet_address, arg_max(usd_inflows_cumulative, date) AS v FROM period GROUP BY 1, 2) GROUP BY 1 HAVING sum(v) >= 700)", ROW_DOUBLES, PERIOD))
def t10_format_ledger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.format_ledger(v.ledger(spark, d), v.market(spark, d), v.OPEN, v.START, v.END, 700.0))


@query(Q("ledger market", """SELECT w AS window_id, coin_id, wallet_address, date, CASE WHEN date = a THEN 0.0 ELSE usd_net_transfers END AS usd_net_transfers, usd_balance, (date = a OR is_imputed) AS is_imputed FROM ledger JOIN win ON date BETWEEN a AND b""", "usd_net_transfers usd_balance",
    "win(w, a, b) AS (VALUES (1, DATE '2024-01-05', DATE '2024-01-10'), (2, DATE '2024-01-10', DATE '2024-01-15'), (3, DATE '2024-01-15', DATE '2024-01-20'))"))
def t11_split_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.split_windows(v.ledger(spark, d), ["2024-01-06", "2024-01-11", "2024-01-16"], v.END)
    return rounded(rows.select("window_id", "coin_id", "wallet_address", "date", "usd_net_transfers", "usd_balance", "is_imputed"))


@query(Q("ledger market", "SELECT * FROM both_ b WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND EXISTS (SELECT 1 FROM both_ x WHERE x.coin_id = b.coin_id AND x.wallet_address = b.wallet_address AND x.date = DATE '2024-01-20' AND x.usd_inflows_cumulative >= 100)", ROW_DOUBLES, PERIOD))
def t12_epoch_slice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.epoch_slice(v.ledger(spark, d), v.market(spark, d), v.OPEN, v.END, 100.0))


LIMITS = {"min_investment": 20, "max_investment": 400, "min_coins": 2, "max_coins": 5, "min_volume": 50, "max_volume": 1000, "max_gain": 500}


@query(Q("ledger market", "SELECT wallet_address, max_investment, unique_coins_traded FROM trading WHERE max_investment >= 20 AND max_investment < 400 AND unique_coins_traded BETWEEN 2 AND 5 AND total_volume BETWEEN 50 AND 1000 AND abs(net_gain) < 500", "max_investment", PERIOD + "," + TRADING, 4))
def t14_wallet_cohort(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.wallet_cohort(trading(spark, d), LIMITS).select("wallet_address", "max_investment", "unique_coins_traded"), 4)


@query(Q("ledger market", "SELECT coin_id, wallet_address, date, put AS flows_cumulative, bal - put AS net_gain_cumulative FROM cum", "flows_cumulative net_gain_cumulative", PERIOD + "," + TRADING, 4))
def f01_f02_cumulative(spark: SparkSession, d: str) -> DataFrame:
    rows = wallet.cumulative(wallet.boundary_flows(period(spark, d), v.START, v.END))
    return rounded(rows.select("coin_id", "wallet_address", "date", "flows_cumulative", "net_gain_cumulative"), 4)


@query(Q("ledger market", f"SELECT wallet_address, {TRADING_DOUBLES.replace(' ', ', ')}, unique_coins_traded, transaction_days FROM trading", TRADING_DOUBLES, PERIOD + "," + TRADING, 4))
def f05_trading(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trading(spark, d), 4)


def flows(spark: SparkSession, d: str) -> DataFrame:
    """The period's ledger with opening balances as buys and closing ones as sales."""
    return wallet.boundary_flows(period(spark, d), v.START, v.END)


@query(Q("ledger market", "SELECT coin_id, wallet_address, date, c AS cost_basis FROM cost", "cost_basis", PERIOD + "," + TRADING + "," + COST, 4))
def f06_cost_basis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.cost_basis(flows(spark, d)).select("coin_id", "wallet_address", "date", "cost_basis"), 4)


TWB = COST + """, tb AS (SELECT wallet_address, sum(twb) AS twb, sum(active) AS active FROM (SELECT wallet_address, coin_id, sum(c * dd) / (sum(dd) + 1e-10) AS twb, coalesce(sum(c * dd) FILTER (c > 20) / nullif(sum(dd) FILTER (c > 20), 0), 0) AS active
    FROM (SELECT *, CAST(coalesce(date_diff('day', date, lead(date) OVER (PARTITION BY coin_id, wallet_address ORDER BY date)), 0) AS DOUBLE) AS dd FROM cost) GROUP BY 1, 2) GROUP BY 1)"""


@query(Q("ledger market", "SELECT wallet_address, twb AS time_weighted_balance, active AS active_time_weighted_balance, CASE WHEN twb > 0 THEN total_volume / twb ELSE 0 END AS volume_vs_twb_ratio FROM tb JOIN trading USING (wallet_address)", "time_weighted_balance active_time_weighted_balance volume_vs_twb_ratio", PERIOD + "," + TRADING + "," + TWB, 4))
def f07_time_weighted_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.trading(period(spark, d), v.START, v.END, balances=True).select("wallet_address", "time_weighted_balance", "active_time_weighted_balance", "volume_vs_twb_ratio"), 4)


def _winsor(column: str, table: str, name: str, q: float = 0.01) -> str:
    """Common tables that end in ``name``(lo, hi): the nearest-rank limits of a column."""
    return f"""{name}_k AS (SELECT CAST(round_even((count({column}) - 1) * {q}, 0) AS BIGINT) AS lo, CAST(round_even((count({column}) - 1) * {1 - q}, 0) AS BIGINT) AS hi FROM {table}),
{name}_o AS (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS r FROM {table} WHERE {column} IS NOT NULL), {name} AS (SELECT max(CASE WHEN r = lo THEN x END) AS lo, max(CASE WHEN r = hi THEN x END) AS hi FROM {name}_o, {name}_k)"""


F08 = """big AS (SELECT *, lag(bal) OVER w AS pb, lag(date) OVER w AS pd FROM adj WHERE bal >= 20 OR abs(usd_net_transfers) >= 20 WINDOW w AS (PARTITION BY coin_id, wallet_address ORDER BY date)),
pr AS (SELECT coin_id, wallet_address, sum((coalesce((bal - usd_net_transfers) / nullif(pb, 0), 1) - 1) * coalesce(date_diff('day', pd, date), 0)) AS s, CAST(sum(coalesce(date_diff('day', pd, date), 0)) AS DOUBLE) AS days_held FROM big GROUP BY 1, 2),
tw AS (SELECT coin_id, wallet_address, days_held, s / nullif(days_held, 0) AS t, 365 / nullif(days_held, 0) AS e FROM pr),
an AS (SELECT *, CASE WHEN t < -1 AND e <> floor(e) THEN NULL ELSE least(pow(1 + t, e) - 1, 10) END AS a FROM tw),
""" + _winsor("t", "an", "lt") + "," + _winsor("a", "an", "la") + """,
twr AS (SELECT coin_id, wallet_address, days_held, CASE WHEN t IS NOT NULL THEN least(greatest(t, lt.lo), lt.hi) END AS time_weighted_return, CASE WHEN a IS NOT NULL THEN least(greatest(a, la.lo), la.hi) END AS annual_twr FROM an, lt, la)"""


@query(Q("ledger market", "SELECT * FROM twr", "days_held time_weighted_return annual_twr", PERIOD + "," + TRADING + "," + F08, 5))
def f08_time_weighted_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.time_weighted_returns(flows(spark, d)).select("coin_id", "wallet_address", "days_held", "time_weighted_return", "annual_twr"), 5)


STATS = [(c, s, f) for c in ("time_weighted_return", "annual_twr", "days_held") for s, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("median", "median"), ("std", "stddev_samp"))]


@query(Q("ledger market", "SELECT wallet_address, " + ", ".join(f'{f}({c}) AS "{c}/{s}"' for c, s, f in STATS) + " FROM twr GROUP BY 1", " ".join(f"{c}/{s}" for c, s, _ in STATS), PERIOD + "," + TRADING + "," + F08, 5))
def f09_return_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.return_stats(wallet.time_weighted_returns(flows(spark, d))), 5)


@query(Q("ledger market", "SELECT t.*, twb AS time_weighted_balance, active AS active_time_weighted_balance, CASE WHEN twb > 0 THEN total_volume / twb ELSE 0 END AS volume_vs_twb_ratio, " + ", ".join(f'coalesce("{c}/{s}", 0) AS "{c}/{s}"' for c, s, _ in STATS) + " FROM trading t JOIN tb USING (wallet_address) LEFT JOIN (SELECT wallet_address, " + ", ".join(f'{f}({c}) AS "{c}/{s}"' for c, s, f in STATS) + " FROM twr GROUP BY 1) USING (wallet_address)",
    TRADING_DOUBLES + " time_weighted_balance active_time_weighted_balance volume_vs_twb_ratio " + " ".join(f"{c}/{s}" for c, s, _ in STATS), PERIOD + "," + TRADING + "," + TWB + "," + F08, 4))
def f05_trading_with_options(spark: SparkSession, d: str) -> DataFrame:
    """All trading features with time-weighted returns and balances."""
    return rounded(wallet.trading(period(spark, d), v.START, v.END, returns=True, balances=True), 4)


def _perform(table: str, name: str) -> str:
    """Common tables that end in ``name``: base, winsorized and rank of gains by investment (_m) and by inflows (_i)."""
    base = f"{name}_b AS (SELECT wallet_address, " + ", ".join(f"round(CASE WHEN {b} = 0 THEN 0 ELSE net_gain / nullif({b}, 0) END, 9) + 0.0 AS {x}" for b, x in (("max_investment", "m"), ("crypto_inflows", "i"))) + f" FROM {table})"
    cols = ", ".join(f"{x} AS base_{x}, least(greatest({x}, {name}_{x}.lo), {name}_{x}.hi) AS winsorized_{x}, (rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count(*) OVER () AS rank_{x}" for x in "mi")
    return f"{base}, {_winsor('m', name + '_b', name + '_m')}, {_winsor('i', name + '_b', name + '_i')}, {name} AS (SELECT wallet_address, {cols} FROM {name}_b, {name}_m, {name}_i)"


PERFORMANCE = [(f"net_gain/{b}/{f}", f"{f}_{x}") for b, x in (("max_investment", "m"), ("crypto_inflows", "i")) for f in ("base", "winsorized", "rank")]


@query(Q("ledger market", "SELECT wallet_address, " + ", ".join(f'{c} AS "{n}"' for n, c in PERFORMANCE) + " FROM pf", " ".join(n for n, _ in PERFORMANCE), PERIOD + "," + TRADING + "," + _perform("trading", "pf"), 5))
def f11_performance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.performance(trading(spark, d), bases=["max_investment", "crypto_inflows"]), 5)


F20 = """tr AS (SELECT * FROM ledger WHERE abs(usd_net_transfers) >= 5 AND date <= DATE '2024-01-20' AND NOT is_imputed),
fb AS (SELECT coin_id, wallet_address, min(date) FILTER (usd_net_transfers > 0) AS first_buy, min(date) FILTER (usd_net_transfers < 0) AS sale, count(*) FILTER (usd_net_transfers > 0) AS n_buys, count(*) FILTER (usd_net_transfers < 0) AS n_sells FROM tr GROUP BY 1, 2),
rb AS (SELECT coin_id, wallet_address, rank() OVER (PARTITION BY coin_id ORDER BY first_buy) AS buyer_rank FROM fb WHERE first_buy IS NOT NULL),
rs AS (SELECT coin_id, wallet_address, rank() OVER (PARTITION BY coin_id ORDER BY sale) AS seller_rank FROM fb WHERE sale IS NOT NULL),
sq AS (SELECT coin_id, wallet_address, first_buy, n_buys, n_sells, CASE WHEN sale > first_buy THEN sale END AS first_sell, buyer_rank, seller_rank,
    date_diff('day', min(first_buy) OVER (PARTITION BY coin_id), DATE '2024-01-20') AS coin_age_days, date_diff('day', min(first_buy) OVER (PARTITION BY wallet_address), DATE '2024-01-20') AS wallet_age_days FROM fb LEFT JOIN rb USING (coin_id, wallet_address) LEFT JOIN rs USING (coin_id, wallet_address))"""


@query(Q("ledger market", "SELECT * FROM sq", "", F20))
def f20_transfer_sequence(spark: SparkSession, d: str) -> DataFrame:
    return wallet.transfer_sequence(v.ledger(spark, d), v.END, 5.0)


F21 = ["buyer_rank", "hold_days", "coin_age_days", "total_buyers", "later_buyers", "earlybird_ratio"]


@query(Q("ledger market", "SELECT wallet_address, " + ", ".join(f"avg({c}) AS {c}_mean, median({c}) AS {c}_median" for c in F21) + """, min(buyer_rank) AS buyer_rank_min, min(coin_age_days) AS coin_age_days_min, max(wallet_age_days) AS wallet_age_days
    FROM period JOIN (SELECT *, total_buyers - buyer_rank AS later_buyers, least(total_buyers / buyer_rank, 20.0) AS earlybird_ratio, date_diff('day', first_buy, coalesce(first_sell, DATE '2024-01-20')) AS hold_days FROM (SELECT *, max(buyer_rank) OVER (PARTITION BY coin_id) AS total_buyers FROM sq) WHERE first_buy <= DATE '2024-01-20') USING (coin_id, wallet_address) GROUP BY 1""",
    " ".join(f"{c}_{s}" for c in F21 for s in ("mean", "median")), F20 + "," + PERIOD))
def f21_transfer_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.transfer_features(period(spark, d), wallet.transfer_sequence(v.ledger(spark, d), v.END, 5.0), v.END))


@query(Q("ledger market", """SELECT wallet_address, sum(f * f) AS hhi, max(f) AS largest_fraction, max(b) AS largest_usd, max(t) AS total_usd_balance, count(*) AS n_coins, stddev_samp(f) AS fraction_std, min(f) AS smallest_fraction, median(f) AS median_fraction FROM (SELECT *, b / t AS f FROM (SELECT *, sum(b) OVER (PARTITION BY wallet_address) AS t FROM (SELECT coin_id, wallet_address, arg_max(usd_balance, date) AS b FROM ledger GROUP BY 1, 2)) WHERE t > 10) GROUP BY 1""", "hhi largest_fraction largest_usd total_usd_balance fraction_std smallest_fraction median_fraction"))
def f25_balance_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.balance_distribution(v.ledger(spark, d), 10.0))


@query(Q("ledger market", """SELECT v.wallet_address, vw AS "volume_wtd/market_cap_imputed", ew AS "ending_wtd/market_cap_imputed", hm AS "held_mean/market_cap_imputed", hd AS "held_median/market_cap_imputed", hi AS "held_min/market_cap_imputed", hx AS "held_max/market_cap_imputed", hs AS "held_std/market_cap_imputed"
    FROM (SELECT wallet_address, sum(c * abs(t)) / nullif(sum(abs(t)), 0) AS vw FROM j WHERE c IS NOT NULL GROUP BY 1) v JOIN (SELECT wallet_address, sum(c * b) / nullif(sum(b), 0) AS ew FROM l WHERE c IS NOT NULL GROUP BY 1) e USING (wallet_address) JOIN (SELECT wallet_address, avg(c) AS hm, median(c) AS hd, min(c) AS hi, max(c) AS hx, stddev_samp(c) AS hs FROM l WHERE b > 0 GROUP BY 1) h USING (wallet_address)""", " ".join(f"{x}/market_cap_imputed" for x in "volume_wtd ending_wtd held_mean held_median held_std".split()),
    T03 + ", j AS (SELECT wallet_address, coin_id, date, usd_net_transfers AS t, usd_balance AS b, market_cap_imputed AS c FROM ledger JOIN imp USING (coin_id, date)), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY coin_id, wallet_address ORDER BY date DESC) = 1)", 3))
def f30_market_cap_features(spark: SparkSession, d: str) -> DataFrame:
    caps = cleaning.impute_market_cap(v.market(spark, d), 0.5, 1.5)
    return rounded(wallet.market_cap_features(v.ledger(spark, d), caps, "market_cap_imputed"), 3)


@query(Q("market", "SELECT coin_id, date, lead(price, 2) OVER w AS price_lead_2, lag(price, 3) OVER w AS price_lag_3, (lead(price, 2) OVER w - price) / nullif(price, 0) AS price_lead_2_change, (price - lag(price, 3) OVER w) / nullif(price, 0) AS price_lag_3_change FROM market WINDOW w AS (PARTITION BY coin_id ORDER BY date)", "price_lead_2 price_lag_3 price_lead_2_change price_lag_3_change"))
def f35_f36_offsets(spark: SparkSession, d: str) -> DataFrame:
    spec = {"price": [2, -3]}
    out = wallet.relative_changes(wallet.offsets(v.market(spark, d).select("coin_id", "date", "price"), spec), spec, keep_base=False)
    return rounded(out)


@query(Q("ledger market", """SELECT w.wallet_address, coalesce(sum(coalesce(c, 0) * abs(t)) FILTER (t > 0) / nullif(sum(abs(t)) FILTER (t > 0), 0), 0) AS "price_lead_2_change/buy_weighted", coalesce(sum(coalesce(c, 0) * abs(t)) FILTER (t < 0) / nullif(sum(abs(t)) FILTER (t < 0), 0), 0) AS "price_lead_2_change/sell_weighted" FROM (SELECT DISTINCT wallet_address FROM ledger) w LEFT JOIN (SELECT wallet_address, usd_net_transfers AS t, c FROM ledger LEFT JOIN ch USING (coin_id, date) WHERE abs(usd_net_transfers) >= 5) x ON x.wallet_address = w.wallet_address GROUP BY 1""", "price_lead_2_change/buy_weighted price_lead_2_change/sell_weighted",
    "ch AS (SELECT coin_id, date, (lead(price, 2) OVER (PARTITION BY coin_id ORDER BY date) - price) / nullif(price, 0) AS c FROM market)"))
def f37_timing(spark: SparkSession, d: str) -> DataFrame:
    spec = {"price": [2]}
    ch = wallet.relative_changes(wallet.offsets(v.market(spark, d), spec), spec)
    return rounded(wallet.timing(v.ledger(spark, d), ch, ["price_lead_2_change"], 5.0))


F40 = """tt AS (SELECT coin_id, wallet_address, date, least(date, coalesce(lag(date) OVER (PARTITION BY coin_id, wallet_address ORDER BY date), DATE '2024-01-05')) AS open_date FROM period),
rg AS (SELECT tt.coin_id, tt.wallet_address, tt.date, any_value(open_date) AS open_date, min(m.price) AS min_price, max(m.price) AS max_price FROM tt JOIN market m ON m.coin_id = tt.coin_id AND m.date BETWEEN tt.open_date AND tt.date GROUP BY 1, 2, 3)"""


@query(Q("ledger market", "SELECT * FROM rg", "min_price max_price", PERIOD + "," + F40))
def f40_price_ranges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.price_ranges(period(spark, d), v.market(spark, d), v.START))


def _scenario(kind: str) -> str:
    """Common tables that end in trading_<kind>: the period's ledger in a scenario, and its trading features."""
    high, low = ("max_price", "min_price") if kind == "ideal" else ("min_price", "max_price")
    rows = f"""period_{kind} AS (SELECT p.coin_id, p.wallet_address, p.date, p.is_imputed, CASE WHEN usd_net_transfers < 0 THEN usd_net_transfers / m.price * {high} ELSE usd_net_transfers / m.price * {low} END AS usd_net_transfers,
    CASE WHEN date = DATE '2024-01-20' THEN usd_balance / m.price * {high} ELSE usd_balance END AS usd_balance FROM period p JOIN market m USING (coin_id, date) JOIN rg USING (coin_id, wallet_address, date))"""
    return rows + "," + re.sub(r"\b(adj|cum|pairs_|gain|act|trading|period)\b", rf"\1_{kind}", TRADING)


@query(Q("ledger market", "SELECT * FROM period_ideal", "usd_net_transfers usd_balance", PERIOD + "," + F40 + "," + _scenario("ideal"), 4))
def f41_ideal_ledger(spark: SparkSession, d: str) -> DataFrame:
    p, m = period(spark, d), v.market(spark, d)
    return rounded(wallet.scenario(p, wallet.price_ranges(p, m, v.START), m, v.END, "ideal").select("coin_id", "wallet_address", "date", "is_imputed", "usd_net_transfers", "usd_balance"), 4)


def _relative(kind: str) -> str:
    """Common tables that end in rel_<kind>: trading and performance against a scenario, without its sign."""
    cols = [(n, a, b, s) for n, (a, b, s) in wallet.RELATIVE.items()]
    money = ", ".join(f'abs(t.{a} - s.{a}) AS "{n}"' for n, a, _, _ in cols)
    part = ", ".join(f'round(CASE WHEN t.{b} >= 20 THEN abs(t.{a} - s.{a}) / t.{b} ELSE 0 END, 9) + 0.0 AS s{i}' for i, (_, a, b, _) in enumerate(cols))
    x = f"x_{kind}"
    limits = ", ".join(_winsor(f"s{i}", x, f"{x}_l{i}") for i in range(4))
    cut_ = ", ".join(f"least(greatest(s{i}, {x}_l{i}.lo), {x}_l{i}.hi) AS w{i}" for i in range(4))
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"
    shares = ", ".join(f'w{i} AS "{s}", {rank(f"w{i}")} AS "{s}{"_rank" if s.endswith("/pct") else "/pct_rank"}"' for i, (_, _, _, s) in enumerate(cols))
    perform = ", ".join(f'b.{f}_{y} - o.{f}_{y} AS "{n}/{f}"' for n, y in (("relative_net_gain_max_inv", "m"), ("relative_net_gain_inflows", "i")) for f in ("base", "winsorized", "rank"))
    return f"""{x} AS (SELECT wallet_address, {money}, {part} FROM trading t JOIN trading_{kind} s USING (wallet_address)), {limits},
{x}_w AS (SELECT *, round((w0 + 1) * (w1 + 1) - 1, 9) + 0.0 AS both_ FROM (SELECT {x}.*, {cut_} FROM {x}, {", ".join(f"{x}_l{i}" for i in range(4))})), {_winsor("both_", x + "_w", x + "_lb")},
{x}_c AS (SELECT {x}_w.* REPLACE (least(greatest(both_, lo), hi) AS both_) FROM {x}_w, {x}_lb), {_perform(f"trading_{kind}", f"pf_{kind}")},
rel_{kind} AS (SELECT wallet_address, {", ".join(f'"{n}"' for n, *_ in cols)}, {shares}, both_ AS "relative_combined/pct", {rank("both_")} AS "relative_combined/pct_rank", {perform} FROM {x}_c JOIN pf b USING (wallet_address) JOIN pf_{kind} o USING (wallet_address))"""


RELATIVE = [*wallet.RELATIVE, *[x for _, _, s in wallet.RELATIVE.values() for x in (s, s + ("_rank" if s.endswith("/pct") else "/pct_rank"))], "relative_combined/pct", "relative_combined/pct_rank", *[f"{n}/{f}" for n in ("relative_net_gain_max_inv", "relative_net_gain_inflows") for f in ("base", "winsorized", "rank")]]


@query(Q("ledger market", "SELECT i.wallet_address, " + ", ".join(f'-i."{c}" AS "ideal/{c}", w."{c}" AS "worst/{c}"' for c in RELATIVE) + ", " + ", ".join(f"""CASE WHEN abs(w."{c}" + i."{c}") < 1e-10 THEN 0 ELSE i."{c}" / nullif(w."{c}" + i."{c}", 0) END AS "net_perf/{c}\"""" for c in wallet.NET) + " FROM rel_ideal i JOIN rel_worst w USING (wallet_address)",
    " ".join(f"{k}/{c}" for k in ("ideal", "worst") for c in RELATIVE) + " " + " ".join(f"net_perf/{c}" for c in wallet.NET), ",".join([PERIOD, TRADING, F40, _perform("trading", "pf"), _scenario("ideal"), _scenario("worst"), _relative("ideal"), _relative("worst")]), 4))
def f42_f45_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Trading and performance of every wallet against the ideal and the worst scenario, and where it lies between them."""
    return rounded(wallet.scenario_features(period(spark, d), v.market(spark, d), v.START, v.END), 4)


@query(Q("market", """SELECT coin_id, date, price, ath, date_diff('day', max(CASE WHEN price = ath THEN date END) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING), date) AS days_since_ath, price / nullif(ath, 0) AS pct_of_ath FROM (SELECT coin_id, date, price, max(price) OVER (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS ath FROM market)""", "price ath pct_of_ath"))
def f60_all_time_high(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wallet.all_time_high(v.market(spark, d)))


F61 = """pv AS (SELECT *, coalesce(lag(usd_balance) OVER w, 0) AS pb, coalesce(lag(profits_cumulative) OVER w, 0) AS pp, coalesce(max(usd_balance) OVER (PARTITION BY coin_id, wallet_address ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mb FROM ledger WINDOW w AS (PARTITION BY coin_id, wallet_address ORDER BY date)),
st AS (SELECT coin_id, date, CAST(sum((usd_balance > 5)::INT - (pb > 5)::INT) AS BIGINT) AS h, CAST(sum((usd_balance > 5 AND profits_cumulative > 5)::INT - (pb > 5 AND pp > 5)::INT) AS BIGINT) AS p, count(*) FILTER (usd_balance > 5 AND mb <= 5) AS n FROM pv GROUP BY 1, 2),
ho AS (SELECT coin_id, date, CAST(sum(h) OVER w AS BIGINT) AS holders, CAST(sum(p) OVER w AS BIGINT) AS holders_in_profit, CAST(sum(n) OVER w AS BIGINT) AS lifetime_holders FROM st WINDOW w AS (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query(Q("ledger market", "SELECT * FROM ho", "", F61))
def f61_f63_holders(spark: SparkSession, d: str) -> DataFrame:
    return wallet.holders(v.ledger(spark, d), 5.0)


@query(Q("ledger market", """SELECT coin_id, date, coalesce(last_value(holders IGNORE NULLS) OVER w, 0) AS holders, coalesce(last_value(lifetime_holders IGNORE NULLS) OVER w, 0) AS lifetime_holders, CAST(coalesce(last_value(holders_in_profit IGNORE NULLS) OVER w, 0) AS DOUBLE) / nullif(last_value(holders IGNORE NULLS) OVER w, 0) AS pct_in_profit, date_diff('day', min(date) OVER (PARTITION BY coin_id), date) AS days_since_launch FROM market LEFT JOIN ho USING (coin_id, date) WINDOW w AS (PARTITION BY coin_id ORDER BY date ROWS UNBOUNDED PRECEDING)""", "pct_in_profit", F61))
def f64_coin_trends(spark: SparkSession, d: str) -> DataFrame:
    t = wallet.coin_trends(v.ledger(spark, d), v.market(spark, d), 5.0)
    return rounded(t.select("coin_id", "date", "holders", "lifetime_holders", F.when(F.col("holders") != 0, F.col("pct_in_profit")).alias("pct_in_profit"), "days_since_launch"))


@query(Q("ledger market", """SELECT wallet_address, coalesce(max(v) FILTER (w = 3), 0) AS "volume|w1", coalesce(max(v) FILTER (w = 2), 0) AS "volume|w2", coalesce(max(v) FILTER (w = 1), 0) AS "volume|w3" FROM (SELECT w, wallet_address, sum(CASE WHEN date = a THEN 0 ELSE abs(usd_net_transfers) END) AS v FROM ledger JOIN win ON date BETWEEN a AND b GROUP BY 1, 2) GROUP BY 1""", "volume|w1 volume|w2 volume|w3",
    "win(w, a, b) AS (VALUES (1, DATE '2024-01-05', DATE '2024-01-10'), (2, DATE '2024-01-10', DATE '2024-01-15'), (3, DATE '2024-01-15', DATE '2024-01-20'))"))
def f71_windows_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.split_windows(v.ledger(spark, d), ["2024-01-06", "2024-01-11", "2024-01-16"], v.END)
    long = rows.groupBy("window_id", "wallet_address").agg(F.sum(F.abs("usd_net_transfers")).alias("volume"))
    return rounded(wallet.windows_wide(long, ["volume"], [1, 2, 3]))


@query(Q("ledger market", """SELECT c.wallet_address, coalesce(t.total_volume, 0) AS "trading|total_volume", b.hhi AS "balance|hhi" FROM (SELECT DISTINCT wallet_address FROM ledger) c LEFT JOIN trading t USING (wallet_address) LEFT JOIN (SELECT wallet_address, sum(f * f) AS hhi FROM (SELECT wallet_address, b / sum(b) OVER (PARTITION BY wallet_address) AS f FROM (SELECT coin_id, wallet_address, arg_max(usd_balance, date) AS b FROM period GROUP BY 1, 2) WHERE b > 0) GROUP BY 1) b USING (wallet_address)""", "trading|total_volume balance|hhi", PERIOD + "," + TRADING, 5))
def f70_all_features(spark: SparkSession, d: str) -> DataFrame:
    p = tables.bucketed(period(spark, d), ["coin_id", "wallet_address"], ["date"])
    out = wallet.features(p, v.START, v.END, v.ledger(spark, d).select("wallet_address").distinct(), {"trading": wallet.trading(p, v.START, v.END), "balance": wallet.balance_distribution(p)}, ["balance"])
    return rounded(out.select("wallet_address", F.col("`trading|total_volume`"), F.col("`balance|hhi`")), 5)


@query("""SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER (), 6) AS r FROM orders""")
def w08_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    """Average-tie percent rank over a whole table, without a single-partition window."""
    return rounded(pct_rank(v.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "r").select("o_orderkey", "r"))

"""Small worked examples and invariants.

Fixed values: inputs and expected numbers of the worked examples are those of FIXTURES.md, section 2, which must be met.
"""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowledger.functions import expr, order
from flowledger.functions.order import pct_rank, winsorize
from flowledger.operators import checks, cleaning, coin, evaluate, flatten, indicators, invest, models, targets, wallet
from flowledger.plans import views as v
from flowledger.plans.q_ledger import period
from flowledger.sources import tables

SF = "/root/testdata/sf0.01"


def day(n, month=1):
    return dt.date(2024, month, n)


def series(spark, values, name="price", coin_id="a"):
    return spark.createDataFrame([(coin_id, day(i + 1), x) for i, x in enumerate(values)], f"coin_id string, date date, {name} double")


def column(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize("values,cutoff,want", [
    ([1, 2, 3, 3, 4, 4, 5, 5, 20, 100], 0.1, [2, 2, 3, 3, 4, 4, 5, 5, 20, 20]),
    ([1, None, 3, 3, 4, None, 5, 5, 20, 100], 0.125, [3, None, 3, 3, 4, None, 5, 5, 20, 20]),
    ([1, 2, 3, 4, 5], 0.0, [1, 2, 3, 4, 5]),
    ([1, 2, 3, 4, 5], 0.5, [3, 3, 3, 3, 3]),
])
def test_winsorize(spark, values, cutoff, want):
    df = series(spark, [None if x is None else float(x) for x in values])
    assert column(winsorize(df, ["price"], cutoff), "price") == want


def test_pct_rank(spark):
    df = series(spark, [3.0, 1.0, 3.0, None, 2.0])
    assert column(pct_rank(df, "price", "r"), "r") == [0.875, 0.25, 0.875, None, 0.5]
    assert column(pct_rank(df, "price", "r", ["coin_id"]), "r") == [0.875, 0.25, 0.875, None, 0.5]


def test_indicators(spark):
    two = series(spark, [100.0, 110.0, 105.0]).unionByName(series(spark, [200.0, 220.0, 210.0], coin_id="b"))
    spec = {"price": {"sma": {"window": [2]}, "rsi": {"window": [2]}, "bollinger_upper": {"window": [2], "num_std": 2}, "bollinger_lower": {"window": [2], "num_std": 2}}}
    a = indicators.generate(two, spec).where("coin_id = 'a'")
    assert column(a, "price_sma_2") == [None, 105.0, 107.5]
    assert [x and round(x, 4) for x in column(a, "price_rsi_2")] == [None, 1.0, 0.6667]
    assert column(a, "price_bollinger_upper_2") == [None, 115.0, 112.5] and column(a, "price_bollinger_lower_2") == [None, 95.0, 102.5]
    e = indicators.ema_table(two, "price", 2, "e").where("coin_id = 'a'")
    assert [x and round(x, 3) for x in column(e, "e")] == [None, 106.667, 105.556]
    w = indicators.over()
    assert column(indicators.generate(two, {"price": {"ema": {"window": [2]}}}).where("coin_id = 'a'"), "price_ema_2") == column(e, "e")
    holes = indicators.ema_table(series(spark, [None, 4.0, None, 8.0]), "price", 1, "e")
    assert column(holes, "e") == [None, 4.0, 4.0, 8.0]
    long = series(spark, [10.0, 12.0, 15.0, 14.0, 13.0, 16.0, 17.0])
    got = column(indicators.generate(long, {"price": {"rsi": {"window": [3]}}}), "price_rsi_3")
    assert [x and round(x, 4) for x in got] == [None, None, 1.0, 0.8333, 0.6, 0.6, 0.8]
    both = spark.createDataFrame([("a", day(i + 1), float(p), 100.0 + 50 * i) for i, p in enumerate([10, 12, 15, 14, 13, 16, 17, 18, 19, 20])], "coin_id string, date date, price double, volume double")
    m = column(indicators.mfi(both, "price", "volume", 3, "m"), "m")
    assert m[0] == 0.5 and m[2] == 100.0 and None not in m
    # inflow 12 * 150 + 15 * 200 + 0, outflow 14 * 250: the index, not the ratio
    assert m[3] == pytest.approx(100 - 100 / (1 + (12 * 150 + 15 * 200) / (14 * 250)))
    with pytest.raises(ValueError):
        indicators.bollinger("price", 3, 2, "middle", w)
    with pytest.raises(ValueError):
        indicators.generate(two, {"nothing": {}})


def test_asof_rows(spark):
    cols = "coin_id string, wallet_address long, date date, usd_net_transfers double, usd_balance double, usd_inflows double, usd_inflows_cumulative double, profits_cumulative double, is_imputed boolean"
    led = spark.createDataFrame([("btc", 1, day(1), 900.0, 1000.0, 900.0, 900.0, 100.0, False), ("btc", 2, day(5), 5.0, 5.0, 5.0, 5.0, 0.0, False)], cols)
    prices = spark.createDataFrame([("btc", day(1), 9000.0), ("btc", day(4), 9500.0), ("btc", day(5), 9600.0)], "coin_id string, date date, price double")
    r = cleaning.impute_rows(led, prices, [day(4)]).collect()
    assert len(r) == 1 and r[0]["wallet_address"] == 1 and r[0]["usd_net_transfers"] == 0 and r[0]["usd_inflows_cumulative"] == 900
    assert round(r[0]["profits_cumulative"], 4) == 155.5556 and round(r[0]["usd_balance"], 4) == 1055.5556
    assert cleaning.impute_rows(led, prices, ["2023-12-01"]).count() == 0


def test_periods_join_up(spark):
    """The closing balance of one period is the opening balance of the next, and flows add up."""
    led, prices = v.ledger(spark, SF), v.market(spark, SF)
    both = cleaning.impute_rows(led, prices, ["2024-01-10"]).unionByName(led.where("date = '2024-01-10'"))
    rows = cleaning.split_windows(led.where("date <> '2024-01-10'").unionByName(both), ["2024-01-06", "2024-01-11"], "2024-01-20")
    a = rows.where("window_id = 1 and date = '2024-01-10'").select("coin_id", "wallet_address", "usd_balance")
    b = rows.where("window_id = 2 and date = '2024-01-10'").select("coin_id", "wallet_address", "usd_balance")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0
    opening = period(spark, SF).where("date = '2024-01-05'")
    assert opening.where("not is_imputed or usd_net_transfers <> 0 or usd_inflows <> 0").count() == 0


def test_merging_keeps_totals(spark):
    """Merging wallets leaves flows and volume as they are."""
    p = period(spark, SF)
    total = lambda df: df.agg(*[F.round(F.sum(c), 2) for c in ("total_volume", "net_cash_flow", "cash_buys", "cash_sells", "crypto_inflows", "crypto_outflows")]).first()
    w = wallet.trading(p, v.START, v.END)
    assert total(w) == total(wallet.trading(p.withColumn("wallet_address", F.col("wallet_address") % 10), v.START, v.END))
    assert w.where("abs(net_crypto_flows - (crypto_inflows - crypto_outflows)) > 0.01 or total_volume < abs(net_cash_flow) - 0.01").count() == 0


def test_twb_and_gain(spark):
    cols = "coin_id string, wallet_address long, date date, usd_net_transfers double, usd_balance double, is_imputed boolean"
    rows = [("btc", 1, day(31), 0.0, 100.0, True), ("btc", 1, day(10, 2), 50.0, 160.0, False), ("btc", 1, day(1, 3), -160.0, 0.0, False), ("btc", 1, day(10, 3), 0.0, 0.0, True)]
    led = spark.createDataFrame(rows, cols)
    t = wallet.trading(led, day(1, 2), day(10, 3)).first()
    assert (t["crypto_inflows"], t["crypto_outflows"], t["net_gain"], t["max_investment"], t["total_volume"]) == (150.0, 160.0, 10.0, 150.0, 210.0)
    b = wallet.trading(led, day(1, 2), day(10, 3), balances=True).first()  # cost: 100, 150 from February 10, 0 from March 1
    assert round(b["time_weighted_balance"], 4) == round((100 * 10 + 150 * 20) / 39, 4) and b["active_time_weighted_balance"] == pytest.approx((100 * 10 + 150 * 20) / 30)


#: Rows of the edge-case ledger of FIXTURES.md, first table, which must equal the given ones.
EDGE = [
    ("btc", "w01", "2024-01-01", 100, 100, False), ("btc", "w01", "2024-05-01", 120, 50, False), ("btc", "w01", "2024-10-01", 180, 0, True),
    ("eth", "w01", "2024-01-01", 200, 200, False), ("eth", "w01", "2024-05-01", 300, 50, False), ("eth", "w01", "2024-10-01", 280, 0, True),
    ("eth", "w03", "2024-01-01", 50, 50, False), ("eth", "w03", "2024-03-01", 0, -50, False), ("eth", "w03", "2024-08-01", 40, 40, False), ("eth", "w03", "2024-10-01", 42, 0, True),
    ("eth", "w04a", "2023-12-31", 30, 0, True), ("eth", "w04a", "2024-10-01", 90, 50, False),
    ("sol", "w08", "2023-12-31", 500, 0, True), ("sol", "w08", "2024-02-01", 10400, 10000, False), ("sol", "w08", "2024-02-02", 400, -10000, False), ("sol", "w08", "2024-10-01", 750, 0, True),
]


def edge(spark):
    rows = [(c, w, dt.date.fromisoformat(d), float(b), float(t), i, float(max(t, 0) if not i else 0)) for c, w, d, b, t, i in EDGE]
    return spark.createDataFrame(rows, "coin_id string, wallet_address string, date date, usd_balance double, usd_net_transfers double, is_imputed boolean, usd_inflows double")


def test_edge_case_wallets(spark):
    t = {r["wallet_address"]: r for r in wallet.trading(edge(spark), "2024-01-01", "2024-10-01", returns=True, balances=True).collect()}
    r = t["w01"]
    assert (r["crypto_inflows"], r["crypto_outflows"], r["net_crypto_flows"], r["net_gain"], r["total_volume"], r["average_transaction"]) == (400, 460, -60, 60, 400, 100)
    assert r["time_weighted_balance"] == pytest.approx(356.20, rel=1e-2) and r["volume_vs_twb_ratio"] == pytest.approx(400 / 356.20, rel=1e-2)
    r = t["w04a"]  # a true row on the closing day: bought for 50, then all 90 sold, of which 40 are more than it bought
    assert (r["crypto_inflows"], r["crypto_outflows"], r["net_gain"], r["total_volume"]) == (30, 40, 10, 50)
    assert (r["cash_buys"], r["cash_sells"], r["net_cash_flow"]) == (0, 40, -40)
    # cost: 500 until February 1, 10,500 for one day, then what is left of it, 400 of 10,400
    left = 10500 * (1 - 10000 / 10400)
    assert t["w08"]["time_weighted_balance"] == pytest.approx((500 * 32 + 10500 + left * 242) / 275)
    assert t["w03"]["time_weighted_balance"] == pytest.approx((50 * 60 + 40 * 61) / 274)
    pairs = {r["wallet_address"]: r for r in wallet.time_weighted_returns(wallet.boundary_flows(edge(spark), "2024-01-01", "2024-10-01"), cutoff=0).where("coin_id = 'eth'").collect()}
    assert pairs["w04a"]["time_weighted_return"] == pytest.approx((0 - 50) / 30 - 1) and pairs["w04a"]["annual_twr"] is None
    assert pairs["w01"]["time_weighted_return"] == pytest.approx(250 / 200 - 1)


def test_transfer_sequence(spark):
    rows = [("a", w, day(d), float(t), False) for w, d, t in [(1, 3, 10), (1, 2, -10), (1, 9, -10), (2, 3, 10), (2, 5, -10), (3, 8, 10), (4, 1, -10), (5, 1, 1)]]
    led = spark.createDataFrame(rows, "coin_id string, wallet_address long, date date, usd_net_transfers double, is_imputed boolean")
    s = {r["wallet_address"]: r for r in wallet.transfer_sequence(led, day(20), 5.0).collect()}
    assert set(s) == {1, 2, 3, 4}  # 5 only moved a trifle
    assert s[1]["first_sell"] is None and s[2]["first_sell"] == day(5) and s[4]["first_buy"] is None and s[4]["buyer_rank"] is None
    assert [s[w]["buyer_rank"] for w in (1, 2, 3)] == [1, 1, 3] and [s[w]["seller_rank"] for w in (4, 1, 2, 3)] == [1, 2, 3, None]
    assert {r["coin_age_days"] for r in s.values()} == {17} and [s[w]["wallet_age_days"] for w in (1, 3, 4)] == [17, 12, None]
    f = {r["wallet_address"]: r for r in wallet.transfer_features(led, wallet.transfer_sequence(led, day(20), 5.0), day(20)).collect()}
    assert set(f) == {1, 2, 3} and f[1]["hold_days_mean"] == 17 and f[2]["hold_days_mean"] == 2 and f[3]["later_buyers_mean"] == 0 and f[1]["earlybird_ratio_median"] == 3


def test_cohort_returns_by_the_last_row(spark):
    rows = [(1, "a", 1, 100.0, 40.0), (1, "a", 2, 0.0, 60.0), (2, "a", 1, 100.0, 40.0), (2, "a", 2, 100.0, 30.0), (3, "a", 1, 100.0, 50.0), (3, "a", 2, 0.0, 0.0)]
    led = spark.createDataFrame([(w, c, day(d), i, p) for w, c, d, i, p in rows], "wallet_address long, coin_id string, date date, usd_inflows double, profits_cumulative double")
    got = {r["wallet_address"]: (r["total_inflows"], r["winning_coins"]) for r in coin.classify_cohort(led, 50, 500, 0, 0.35, 1).collect()}
    assert got == {1: (100.0, 1), 2: (200.0, 0), 3: (100.0, 1)}  # beyond any limit; 0.3; the last return there is


def test_feature_selection(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 2), 5.0, None if i % 3 else float(-i)) for i in range(60)], "a double, b double, c double, d double, e double")
    cols = list("abcde")
    assert targets.low_variance(df, cols, 0.5) == [] and targets.low_variance(df, cols, 0.5, scaled=False) == ["c", "d"] and targets.low_variance(df, cols, 0.5, ["c"], False) == ["d"]
    assert targets.low_variance(df, ["a"], 1.1) == ["a"]  # scaled variances are about 1
    assert targets.correlated(df, cols, 0.9) == ["b", "e"] and targets.correlated(df, cols, 0.9, ["e"]) == ["b"]
    r = targets.correlations(df, cols)
    assert r[0, 4] == pytest.approx(-1) and np.isnan(r[3]).all()
    wide = df.select(*[(F.col("a") * k + F.col("c") * (k % 7)).alias(f"x{k}") for k in range(1, 151)])
    want = np.corrcoef(np.array(wide.collect()).T)
    assert np.abs(targets.correlations(wide, wide.columns) - want).max() < 1e-9


def test_order_statistics_narrow_down(spark, monkeypatch):
    """With few rows allowed at the end, ranks are narrowed by estimates and counts and stay exact."""
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, None, rng.expovariate(0.01)]) for _ in range(5000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double")
    known = sorted(x for x in values if x is not None)
    monkeypatch.setattr(order, "FEW", 20)
    ranks = [0, 1, 100, 1234, len(known) // 2, len(known) - 2, len(known) - 1]
    assert order.at_ranks(df, {"x": ranks}, {"x": len(known)})["x"] == [known[k] for k in ranks]
    assert order.quantiles(df, ["x"], [0.1, 0.5, 0.999])["x"] == pytest.approx(np.quantile(known, [0.1, 0.5, 0.999]).tolist())
    run = order.running(df, "x", ["i"], {"s": "x", "n": F.lit(1)}, "k", descending=False).orderBy("k").collect()
    assert [r["x"] for r in run] == known and [r["n"] for r in run] == list(range(1, len(known) + 1)) and run[-1]["s"] == pytest.approx(sum(known))


def test_flatten_and_policy(spark):
    s = series(spark, [float(i) for i in range(1, 13)])
    spec = {"price": {"aggregations": ["first", "last"], "rolling": {"duration": 5, "lookbacks": 3, "aggregations": ["sum"], "comparisons": ["change"]}}}
    r = flatten.flatten(s, spec).first()
    assert (r["price_first"], r["price_last"], r["price_sum_5d_period_1"], r["price_sum_5d_period_2"], r["price_sum_5d_period_3"], r["price_change_5d_period_1"]) == (1.0, 12.0, 50.0, 25.0, None, 4.0)
    assert flatten.names(spec) == [c for c in flatten.flatten(s, spec).columns if c != "coin_id"]
    a = spark.createDataFrame([("w", 1, 10), ("w", 2, 20), ("w", 3, 30)], "time_window string, coin_id int, m1 int")
    b = spark.createDataFrame([("w", 2, 50), ("w", 3, 60)], "time_window string, coin_id int, m2 int")
    fill = flatten.join_by_policy({"a": (a, "fill_zeros"), "b": (b, "fill_zeros")}).orderBy("coin_id").collect()
    assert [r["m2"] for r in fill] == [0, 50, 60]
    assert flatten.join_by_policy({"a": (a, "fill_zeros"), "b": (b, "drop_records")}).count() == 2
    assert flatten.join_log(a, b, "x").first().asDict() == {"step": "x", "rows_before": 3, "rows_after": 2}
    with pytest.raises(ValueError):
        flatten.flatten(s, {"nothing": {}})


def test_expressions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(expr.pct_change(F.lit(0.0), F.lit(0.0))) == 0 and val(expr.pct_change(F.lit(0.0), F.lit(3.0))) == 2 and val(expr.pct_change(F.lit(1.0), F.lit(99.0))) == 5
    assert val(expr.ratio(F.lit(1.0), F.lit(0.0))) == 0 and val(expr.try_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert val(expr.clip(F.lit(7.0), 0.0, 5.0)) == 5 and val(expr.finite(F.lit(float("nan")))) is None
    assert val(expr.bucketize(F.lit(3), {"a": 1, "b": 3}, "c")) == "b"
    with pytest.raises(ValueError):
        expr.bucketize(F.lit(3), {"a": 1}, None)


def test_profit_curve(spark):
    p = [0.55, 0.07, 0.14, 0.02, 0.07, 0.64, 0.04, 0.00, 0.02, 0.39]
    r = [0.46, -0.1, -0.09, -0.09, -0.01, 0.57, -0.1, -0.01, -0.02, 2.62]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(p, r, strict=True))], "coin_id long, p double, r double")
    got = [round(x["profitability"], 3) for x in evaluate.running_profit(df, "p", "r", ["coin_id"]).orderBy("k").limit(2).collect()]
    assert got == [0.218, 0.323]
    assert round(evaluate.profit_auc(df, "p", "r", ["coin_id"], 0.2).first()[0], 5) == round((0.57 / 2.62 + 1.03 / 3.19) / 2, 5)


def test_tails():
    assert abs(evaluate.chi_square_p(3.841459) - 0.05) < 1e-6 and abs(evaluate.t_tail(2.228139, 10) - 0.05) < 1e-6 and abs(evaluate.t_tail(0.5, 3) - 0.6514) < 1e-3


def test_errors_and_checks(spark):
    led = v.ledger(spark, SF)
    with pytest.raises(ValueError):
        checks.require(led, "rows")
    with pytest.raises(ValueError):
        wallet.offsets(led, {"usd_balance": [0]})
    with pytest.raises(ValueError):
        tables.require_unique(led, ["coin_id"])
    with pytest.raises(ValueError):
        models.matching(["a", "b"], ["z*"])
    assert models.matching(["a|x", "a|y", "b"], ["a|*"], ["*y"]) == ["a|x"]
    assert coin.collisions(coin.hybrid_map(led)).count() == 0 and coin.unmapped(led, coin.hybrid_map(led)).count() == 0
    with pytest.raises(Exception, match="no id"):
        coin.hybridize(led, coin.hybrid_map(led.where("coin_id = 'click'"))).collect()
    assert checks.column_difference(led, led.drop("usd_balance"))["missing"] == ["usd_balance"]
    off = {r["column"]: r for r in checks.offences(led, ["usd_balance"]).collect()}
    assert off["usd_balance"]["negatives"] == 0 and all(r["nulls"] == 0 for r in off.values())
    e = targets.epochs(spark, {"start_date": "2024-01-06", "end_date": "2024-01-15"}, {"modeling": [0, 30], "validation": [10]})
    assert targets.overlap(e).count() == 1 and [r[0] for r in targets.offset_superset(spark, [0, 5], [0, 5]).collect()] == [0, 5, 10]
    assert [str(r["end_date"]) for r in targets.periods(spark, "2024-01-21", 15, 5).collect()] == ["2024-01-20", "2024-01-25", "2024-01-30", "2024-02-04"]
    one = targets.one_epoch(targets.in_epochs(led, e).select("wallet_address", "epoch_start_date").distinct())
    assert one.count() == one.select("wallet_address").distinct().count()


def test_trained_pipeline_is_reused(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7), float(i % 2)) for i in range(60)], "x double, y double, target double")
    drop = models.select_features(df, ["x", "y"], 0.0, 0.99)
    calls = []

    def fit():
        calls.append(1)
        return models.build("rf_classifier", ["x", "y"], drop=drop, numTrees=3).fit(df)

    a = models.saved(f"{tmp_path}/m", fit)
    b = models.saved(f"{tmp_path}/m", fit)
    assert len(calls) == 1 and models.score(a, df).exceptAll(models.score(b, df)).count() == 0


def test_plans(spark):
    """No cross product and no Python in core paths; filters and columns reach the scan."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    p = plan(wallet.trading(period(spark, SF), v.START, v.END))
    assert "CartesianProduct" not in p and "Python" not in p and "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p and "props" not in p
    q = plan(v.table(spark, SF, "orders").where("o_orderkey = 7").select("o_totalprice"))
    assert "EqualTo(o_orderkey,7)" in q and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in q


def test_export(spark, tmp_path):
    df = spark.range(2500).withColumnRenamed("id", "k")
    tables.export_splits({"x_train": df}, str(tmp_path), "240101", ["k"])
    assert spark.read.parquet(f"{tmp_path}/x_train_240101_dev").count() == 1000
    with pytest.raises(ValueError):
        tables.export_splits({"x": df.where("k < 0")}, str(tmp_path), "240101", ["k"])
    with pytest.raises(ValueError):
        tables.append_scores(df.withColumn("epoch", F.col("k")), str(tmp_path), str(tmp_path), {})
    assert invest.lifetime(spark.createDataFrame([(0.5, "a", 2, 0.1), (0.5, "b", 0, None)], "threshold double, epoch string, n long, mean_return double").withColumn("mean_return_all", F.lit(0.2))).first()["lifetime_return"] == pytest.approx(0.1)


def test_no_line_through_equal_means(spark):
    """Each asset has the same scores in another order: no slope, however the sums are rounded."""
    rows = [(c, s / 1000, ((s * 7 + i) % 200) / 100 - 1) for i, c in enumerate("abcde") for s in random.Random(c).sample(range(1000), 1000)]
    coins, fit = evaluate.coin_fit(spark.createDataFrame(rows, "coin_id string, score double, actual_return double").repartition(7), 0.2, 10)
    assert {r["mean_score"] for r in coins.collect()} == {0.5995}
    assert tuple(fit.first()) == (None, None, None)
    big = spark.createDataFrame([(1e12,), (2e12,), (None,)], "x double").agg(expr.exact_mean("x"), expr.exact_sum("x")).first()
    assert tuple(big) == (1.5e12, 3e12)

"""Order statistics, ranks, running sums and quantiles by group against plain Python, and the shape of their plans."""

import math
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowledger.functions import order
from flowledger.operators import coin, evaluate, flatten, invest, models, targets, wallet
from flowledger.sources import tables


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(order, "FEW", 20)


def plan(df):
    return df._jdf.queryExecution().toString()


def numbers(spark, n, seed=1):
    """Rows of which a third are one value of one group, with nulls in key and value."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, round(rng.gauss(0, 3), 2), float(rng.randint(0, 4))])) for i in range(n)] + [(n + i, "hot", 7.0) for i in range(n // 2)]
    return spark.createDataFrame(rng.sample(rows, len(rows)), "id long, g string, v double").repartition(5), rows


def quantile(values, q):
    s = sorted(values)
    at = (len(s) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return s[lo] if lo == hi else (hi - at) * s[lo] + (at - lo) * s[hi]


def test_group_quantiles(spark):
    df, rows = numbers(spark, 400)
    got = {r["g"]: r["v"] for r in order.group_quantiles(df, ["g"], ["v"], [0.0, 0.1, 0.5, 0.93, 1.0]).collect()}
    for g in {r[1] for r in rows}:
        want = [quantile([v for _, k, v in rows if k == g and v is not None], q) for q in (0.0, 0.1, 0.5, 0.93, 1.0)]
        assert got[g] == pytest.approx(want, abs=1e-12), g
    assert "percentile" not in plan(order.group_quantiles(df, ["g"], ["v"], [0.5])).replace("percentile_approx", "")


def test_group_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), ("b", 5.0, None)], "g string, v double, w double")
    got = {r["g"]: (r["v"], r["w"]) for r in order.group_quantiles(df, ["g"], ["v", "w"], [0.5]).collect()}
    assert got == {"a": (None, [2.0]), "b": ([5.0], None)}
    assert order.group_quantiles(df.where("false"), ["g"], ["v"], [0.5]).count() == 0
    g = order.with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], {"v": "m"}, [0.5])
    assert sorted(map(tuple, g.collect())) == [("a", 2, None), ("b", 1, 5.0)]


def test_ranges_do_not_grow_the_plan(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    sizes = []
    for ranges in (8, 1024):
        monkeypatch.setattr(order, "RANGES", ranges)
        found = order.located(df, {"x": "p"})
        sizes.append(len(plan(found)))
        rows = sorted((r["x"], r["p"]) for r in found.collect())
        assert [p for _, p in rows] == sorted(p for _, p in rows) and ranges / 2 < len({p for _, p in rows}) <= ranges
    assert abs(sizes[0] - sizes[1]) < 500
    odd = order.located(spark.createDataFrame([(None,), (2.0,), (2.0,)], "`a.b` double"), {"a.b": "p"})
    assert sorted(r["p"] for r in odd.collect()) == [-1, 1, 1]


def test_running_and_places_with_ties(spark):
    df, rows = numbers(spark, 300)
    got = order.running(df.withColumn("one", F.lit(1)), "v", ["id"], {"s": "v", "c": "one"}, "k").collect()
    want = sorted([(r[2], r[0]) for r in rows if r[2] is not None], key=lambda x: (-x[0], x[1]))
    total = 0.0
    for k, (r, (v, i)) in enumerate(zip(sorted(got, key=lambda r: r["k"]), want, strict=True), 1):
        total += v
        assert (r["k"], r["id"], r["c"]) == (k, i, k) and r["s"] == pytest.approx(total, abs=1e-8)
    placed = {r["id"]: r["k"] for r in order.numbered(df, [F.asc_nulls_last("v"), "id"], "k").collect()}
    assert [i for i, _ in sorted(placed.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))]


def test_running_in_groups(spark):
    df, rows = numbers(spark, 200)
    counted = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in order.running_in(counted, ["g"], "v", {"n": "to"}).collect():
        assert r["to"] == sum(1 for _, g, v in rows if g == r["g"] and v is not None and v <= r["v"])


@pytest.mark.parametrize("largest", [True, False])
def test_highest(spark, largest):
    df, rows = numbers(spark, 100)
    known = sorted([r for r in rows if r[2] is not None], key=lambda r: (-r[2] if largest else r[2], r[0]))
    for n in (0, 1, 30, 60, len(known), 10**6):
        got = order.highest(df, "v", n, ["id"], largest)
        assert {r["id"] for r in got.collect()} == {r[0] for r in known[:n]}, n
        assert "TakeOrdered" not in plan(got)
    assert order.highest(df.where("false"), "v", 5, ["id"]).count() == 0


def test_shares_are_not_one_task(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7 - 3.0).alias("coin_return"))
    split = targets.share_split(df, "k", 0.2, "out")
    assert "TakeOrdered" not in plan(split) and split.where("out").count() == 200
    filled = targets.fill_up(df.withColumn("coin_id", F.col("k")), "coin_return", F.col("coin_return") >= 3, 0.3, "m", True)
    assert "TakeOrdered" not in plan(filled) and filled.where("m = 1").count() == 300


def test_pct_ranks(spark, monkeypatch):
    monkeypatch.setattr(order, "FREQUENT", 4)
    df, rows = numbers(spark, 200)
    df = df.withColumn("w", -F.col("v") * 2)
    got = {r["id"]: r for r in order.pct_ranks(df, {"v": "rv", "w": "rw"}).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    up, down = pdf["v"].rank(pct=True), (-pdf["v"]).rank(pct=True)
    for i, a, b in zip(pdf["id"], up, down, strict=True):
        assert (got[i]["rv"], got[i]["rw"]) == ((None, None) if pd.isna(a) else (pytest.approx(a), pytest.approx(b)))


def test_free(spark):
    df = order.settled(spark.range(3))
    assert order.settled(df) is df
    order.free(df)
    assert not df.storageLevel.useMemory


def test_price_ranges(spark):
    rng, d0 = random.Random(3), date(2024, 1, 1)
    prices = [(c, d0 + timedelta(k), rng.uniform(1, 9)) for c in "ab" for k in range(90) if rng.random() < 0.8]
    ledger = [(c, w, d0 + timedelta(k)) for c in "abz" for w in range(4) for k in sorted(rng.sample(range(5, 95), 6))]
    got = wallet.price_ranges(spark.createDataFrame(ledger, "coin_id string, wallet_address long, date date"), spark.createDataFrame(prices, "coin_id string, date date, price double"), "2024-01-04")
    want = {}
    for i, (c, w, d) in enumerate(ledger):
        before = ledger[i - 1][2] if i and ledger[i - 1][:2] == (c, w) else date(2024, 1, 3)
        own = [p for k, x, p in prices if k == c and before <= x <= d]
        if own:
            want[c, w, d] = (before, min(own), max(own))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.select("coin_id", "wallet_address", "date", "open_date", "min_price", "max_price").collect()} == want


def test_one_exchange_on_pairs(spark):
    rows = [(c, w, date(2024, 1, k), 10.0 * k, 5.0 * k, k % 5 == 0) for c in "ab" for w in range(5) for k in range(5, 21)]
    ledger = tables.bucketed(spark.createDataFrame(rows, "coin_id string, wallet_address long, date date, usd_balance double, usd_net_transfers double, is_imputed boolean"), ["coin_id", "wallet_address"], ["date"])
    both = wallet.trading(ledger, "2024-01-06", "2024-01-20", balances=False).join(wallet.balance_distribution(ledger), "wallet_address").join(wallet.return_stats(wallet.time_weighted_returns(ledger, cutoff=0)), "wallet_address")
    both.collect()
    executed = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(coin_id" not in executed
    assert ledger.count() == len(rows)


def test_ids_of_pairs(spark):
    pairs = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1), ("a", 9)], "coin_id string, wallet_address long")
    first = coin.hybrid_map(pairs)
    assert sorted(map(tuple, first.collect())) == [("a", 1, 1), ("a", 9, 2), ("b", 2, 3)]
    assert sorted(map(tuple, coin.hybrid_map(pairs.repartition(7)).collect())) == sorted(map(tuple, first.collect()))
    grown = coin.extended_map(first, pairs.unionByName(spark.createDataFrame([("a", 0)], pairs.schema)))
    assert sorted(map(tuple, grown.collect())) == [("a", 0, 4), ("a", 1, 1), ("a", 9, 2), ("b", 2, 3)]
    with pytest.raises(ValueError, match="two pairs"):
        coin.hybridize(pairs, first.withColumn("hybrid_id", F.lit(1)))


def test_growing_data_sets_write_new_days_only(spark, tmp_path):
    asked = []

    def build(a, b):
        asked.append((a, b))
        return spark.createDataFrame([(date(2024, 1, k), k) for k in range(1, 30) if k != 7], "date date, x int")

    path = f"file://{tmp_path}/set"
    assert tables.grown(spark, path, build, "2024-01-05", "2024-01-10").count() == 5
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "set/data").rglob("*.parquet")}
    assert sorted(r["x"] for r in tables.grown(spark, path, build, "2024-01-03", "2024-01-12").collect()) == [3, 4, 5, 6, 8, 9, 10, 11, 12]
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "set/data").rglob("*.parquet")}
    assert {p: now[p] for p in files} == files and len(now) == len(files) + 4
    tables.grown(spark, path, build, "2024-01-03", "2024-01-12")
    assert asked == [("2024-01-05", "2024-01-10"), ("2024-01-03", "2024-01-04"), ("2024-01-11", "2024-01-12")]


def test_group_metrics_and_significance(spark):
    rng = random.Random(8)
    rows = [(k, rng.randint(0, 1), rng.randint(0, 20) / 20) for k in (1, 2, None) for _ in range(120)] + [(3, 1, 0.4)] * 60 + [(4, 0, 0.1), (4, 1, 0.2)]
    got = {r["k"]: r for r in evaluate.group_metrics(spark.createDataFrame(rows, "k int, actual int, score double"), "k").collect()}
    for k in (1, 2, None):
        pos, neg = ([s for g, y, s in rows if g == k and y == c] for c in (1, 0))
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert got[k]["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
        assert got[k]["accuracy"] == pytest.approx(sum((s >= 0.5) == (y == 1) for g, y, s in rows if g == k) / 120)
    assert got[3]["roc_auc"] is None and got[3]["log_loss"] == pytest.approx(-math.log(0.4)) and got[3]["recall"] == 0
    assert got[4]["n"] == 2 and got[4]["log_loss"] is None
    # tables of the distributions: 5 % and 1 % points
    chi = evaluate.significant(spark.createDataFrame([(3.841459,), (6.634897,), (None,)], "chi2 double")).collect()
    assert [r["p_value"] and round(r["p_value"], 6) for r in chi] == [0.05, 0.01, None]
    assert chi[1]["significant"] and chi[2]["significant"] is None
    t = evaluate.significant(spark.createDataFrame([(2.228139, 10), (-2.845340, 20), (None, 5), (1.0, 0)], "t double, freedom int")).collect()
    assert [r["p_value"] and round(r["p_value"], 5) for r in t] == [0.05, 0.01, None, None]


def test_series_with_holes_are_refused(spark):
    ok = [("a", date(2024, 1, k)) for k in range(1, 6)] + [("b", date(2024, 1, k)) for k in range(3, 6)]
    make = lambda rows: spark.createDataFrame(rows, "coin_id string, date date")
    assert flatten.checked(make(ok)).count() == 8
    for bad in (ok[:2] + ok[3:], [*ok, ok[0]], ok[:-1]):
        with pytest.raises(ValueError, match="missing or doubled"):
            flatten.checked(make(bad), "2024-01-05")


def test_window_dataset_policies(spark):
    key = "time_window string, coin_id string, x int"
    a, b = spark.createDataFrame([("w1", "a", 1), ("w1", "b", 2), ("w2", "a", 3)], key), spark.createDataFrame([("w1", "a", 5), ("w2", "c", 6)], key)
    m = spark.createDataFrame([("w1", 9)], "time_window string, y int")
    rows, log = flatten.window_dataset({"one": (a, "fill_zeros"), "two": (b, "drop_records"), "macro": (m, "extend_coin_ids")})
    assert sorted(map(tuple, rows.select("time_window", "coin_id", "one|x", "two|x", "macro|y").collect())) == [("w1", "a", 1, 5, 9), ("w2", "c", 0, 6, None)]
    assert sorted(map(tuple, log.collect())) == [(0, "one", "fill_zeros", 3, 4, 4), (1, "two", "drop_records", 2, 4, 2), (2, "macro", "extend_coin_ids", 2, 2, 2)]
    with pytest.raises(ValueError, match="twice"):
        flatten.window_dataset({"one": (a.union(a), "fill_zeros")})


def test_search_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    rows = spark.range(240).select(F.col("id"), (F.col("id") % 2).cast("string").alias("date"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 10).cast("double").alias("good"), (F.col("id") % 7).cast("double").alias("noise"))
    rows = rows.withColumn("target", (F.col("good") > 4).cast("double"))
    space = {"maxDepth": [1, 2], "drop_patterns": [["good"], ["noise"]]}
    run = lambda n: models.date_search(rows, space, n, "rf_classifier", ["good", "noise"], models.MetricEvaluator("auc"), f"file://{tmp_path}/s")
    first = run(1)
    assert first.count() == 4
    fits = []
    real = models.score
    monkeypatch.setattr(models, "score", lambda *a, **k: fits.append(1) or real(*a, **k))
    found = run(3).collect()
    assert len(fits) == 4 and len(found) == 8
    best = {(r["date"], r["combination"]): r["score"] for r in found}
    for r in found:
        if "good" in r["params"].split("drop_patterns")[-1]:
            assert r["score"] < 0.8
        elif "noise" in r["params"]:
            assert r["score"] > 0.99
    deltas = invest.search_deltas(run(3)).collect()
    assert len(deltas) == 6 and all(r["delta"] == pytest.approx(r["score"] - best[r["date"], 0]) for r in deltas)
    with pytest.raises(ValueError, match="another search"):
        models.date_search(rows, {"maxDepth": [3]}, 1, "rf_classifier", ["good", "noise"], models.MetricEvaluator("auc"), f"file://{tmp_path}/s")


def test_correlated_columns_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(targets, "BLOCKS", 2)
    rng = random.Random(9)
    n = 2 * targets.SIDE + 3
    rows = []
    for _ in range(60):
        r = [rng.gauss(0, 1) for _ in range(n)]
        r[200], r[n - 1], r[5] = -r[3] * 2 + 1, r[130] + 0.01 * r[131], None if rng.random() < 0.2 else r[4] * 3
        rows.append(tuple(r))
    names = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    links = {(r["a"], r["b"]): r["r"] for r in targets.correlation_links(df, names, 0.9).collect()}
    assert set(links) == {(3, 200), (130, n - 1), (4, 5)} and links[3, 200] == pytest.approx(-1) and links[4, 5] == pytest.approx(1)
    assert targets.correlated(df, names, 0.9, ["x200"]) == ["x5", f"x{n - 1}"]

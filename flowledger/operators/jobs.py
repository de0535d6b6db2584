"""Jobs that chain operators: cohorts by window, data sets of many epochs, models with their splits, investment cycles.

Windows and epochs go along as a key, so each job is one pass over the ledger and the market; only fitted models, of which
there is one for each score or cycle, are made one after another.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.functions.order import pct_rank, settled, winsorize, winsorize_by
from flowledger.operators import cleaning, coin, evaluate, flatten, indicators, models, targets
from flowledger.sources import tables

PAIR = ["coin_id", "wallet_address"]
WINDOW = ["time_window", "coin_id"]


def _before(day: str, days: int) -> str:
    return str(date.fromisoformat(day) - timedelta(days))


# cohorts and indicators by window


def window_rows(ledger: DataFrame, prices: DataFrame, starts: Sequence[str], days: int, lookback: int) -> DataFrame:
    """The ledger of each window's ``lookback`` days before its start, with as-of rows on the first of them, the day before
    its last ``days`` days, and its last day; ``time_window`` is the start."""
    dates = sorted({(w, _before(w, k)) for w in starts for k in (lookback, days + 1, 1) if k <= lookback})
    made = cleaning.impute_rows(ledger, prices, sorted({d for _, d in dates}))
    at = ledger.sparkSession.createDataFrame(dates, "w string, d string").select(F.to_date("w").alias("time_window"), F.to_date("d").alias("date"))
    return flatten.in_windows(ledger, starts, lookback).unionByName(made.join(F.broadcast(at), "date"), allowMissingColumns=True)


def window_cohorts(ledger: DataFrame, prices: DataFrame, starts: Sequence[str], days: int, lookback: int, rules: Mapping[str, float], spec: Mapping[str, Mapping], indicator_spec: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(time_window, coin_id): features of what each window's own cohort did: as-of rows, cohort by its limits (``rules``:
    min_inflows, max_inflows, profit_win, return_win, min_wins), daily activity, indicators, flattening."""
    rows = window_rows(ledger, prices, starts, days, lookback)
    cohort = coin.classify_cohort(rows, **rules, keys=["time_window"]).where("in_cohort").select("time_window", "wallet_address")
    members = rows.join(cohort, ["time_window", "wallet_address"], "left_semi")
    daily = coin.activity(members, F.date_sub("time_window", 1), ["time_window"])
    if indicator_spec:
        daily = indicators.generate(daily.withColumn("_key", F.concat_ws("|", "time_window", "coin_id")), indicator_spec, "_key").drop("_key")
    return flatten.flatten(daily, spec, WINDOW)


def epoch_indicators(df: DataFrame, spec: Mapping[str, Mapping], epochs: DataFrame, key: str = "coin_id") -> DataFrame:
    """Rows of each epoch with indicators over all history up to them; a date-only series has one constant ``key``."""
    return targets.in_epochs(indicators.generate(df, spec, key), epochs)


def coin_trend_features(trends: DataFrame, spec: Mapping[str, Mapping], end: str) -> DataFrame:
    """Per asset: trend columns flattened up to ``end``; last values go by the column's own name. Assets whose rows all lie
    later have none, and an asset lost on the way would be an error of the spec."""
    rows = trends.where(F.col("date") <= F.lit(end).cast("date"))
    flat = flatten.flatten(rows, spec)
    return flat.toDF(*[c.removesuffix("_last") for c in flat.columns])


def join_features(a: DataFrame, b: DataFrame, key: str = "coin_id") -> DataFrame:
    """Inner join of two feature sets; a warning tells how many keys of either side have no partner."""
    lone = {n: x.select(key).distinct().join(y.select(key), key, "left_anti").count() for n, x, y in (("left", a, b), ("right", b, a))}
    if any(lone.values()):
        warnings.warn(f"keys without a partner: {lone['left']} of the left set, {lone['right']} of the right", stacklevel=2)
    return a.join(b, key)


# epochs


def coin_epochs(ledger: DataFrame, scores: DataFrame, market: DataFrame, starts: Sequence[str], days: int, hold: int, spec: Mapping[str, Mapping], cutoff: float = 0.01, training_only: bool = False) -> DataFrame:
    """(time_window, coin_id): features of every epoch, and unless ``training_only`` its targets.

    Features: balances at the epoch's start of the pairs that traded in the ``days`` days before, their holders, the mean
    score of these by balance, and the flattened market series. Targets: the return over the next ``hold`` days, the same
    winsorized within the epoch, and its percent rank there. An epoch beyond the data is an error.
    """
    last = market.agg(F.max("date")).first()[0]
    if late := [s for s in starts if date.fromisoformat(s) + timedelta(-1 if training_only else hold - 1) > last]:
        raise ValueError(f"epochs beyond the data, which end on {last}: {late}")
    pairs = flatten.in_windows(ledger, starts, days).groupBy("time_window", *PAIR).agg(F.max_by("usd_balance", "date").alias("b"))
    held = pairs.where("b > 0").join(scores, PAIR)
    by_coin = held.groupBy(*WINDOW).agg(F.sum("b").alias("balance"), F.count("*").alias("holders"), expr.weighted_mean("score", "b").alias("score_by_balance"))
    series = flatten.flatten(flatten.in_windows(market, starts, days), spec, WINDOW)
    out = flatten.join_by_policy({"wallets": (by_coin, "fill_zeros"), "market": (series, "drop_records")})
    if training_only:
        return out
    r = targets.window_targets(market, list(starts), hold - 1).where("coin_return is not null")
    r = pct_rank(winsorize_by(r, "coin_return", cutoff, ["time_window"], "coin_return_winsorized"), "coin_return", "coin_return_pctile", ["time_window"])
    return out.join(r, WINDOW)


def window_datasets(ledger: DataFrame, market: DataFrame, macro: DataFrame, cohort: DataFrame, starts: Sequence[str], days: int, series_spec: Mapping[str, Mapping], macro_spec: Mapping[str, Mapping], policies: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(data set, join log) of all time windows: market series and the cohort's activity by (window, asset), the macro series
    by window, each flattened over the ``days`` days before the window's start and joined by its policy.

    ``cohort`` names wallets by window (time_window, wallet_address). One range join for all windows a set, no loop over
    them. Defaults: assets without a market series go, inactive ones have 0, the macro row goes to all assets of a window.
    """
    by = {"market": "drop_records", "cohort": "fill_zeros", "macro": "extend_coin_ids"} | dict(policies or {})
    series = flatten.flatten(flatten.in_windows(market, starts, days), series_spec, WINDOW)
    wide = flatten.flatten(flatten.in_windows(macro, starts, days), macro_spec, ["time_window"])
    rows = flatten.in_windows(ledger, starts, days).join(cohort, ["time_window", "wallet_address"], "left_semi")
    t = F.col("usd_net_transfers")
    active = rows.groupBy(*WINDOW).agg(F.sum(F.abs(t)).alias("volume"), F.sum(expr.positive(t)).alias("bought"), F.countDistinct("wallet_address").alias("wallets"))
    return flatten.window_dataset({"market": (series, by["market"]), "cohort": (active, by["cohort"]), "macro": (wide, by["macro"])})


def validation_returns(scores: DataFrame, inflows: DataFrame, market: DataFrame, starts: Sequence[str], days: int, min_inflows: float = 0.0, cutoff: float = 0.0) -> DataFrame:
    """Scored pairs of each epoch (``epoch_start_date``) with inflows above ``min_inflows``, and their asset's return from
    the start to ``days`` days later, winsorized over all epochs' assets."""
    r = targets.window_targets(market, list(starts), days).where("coin_return is not null").select("coin_id", F.col("time_window").alias("epoch_start_date"), "coin_return")
    r = winsorize(r, ["coin_return"], cutoff) if cutoff else r
    enough = inflows.where(F.col("inflows") > min_inflows).select("epoch_start_date", *PAIR)
    return scores.join(enough, ["epoch_start_date", *PAIR]).join(r, ["epoch_start_date", "coin_id"])


# models


def model_job(data: DataFrame, columns: Sequence[str], target: Column, kind: str, key: str, stratum: str = "time_window", shares: Mapping[str, float] | None = None, validation: DataFrame | None = None,
              threshold: float | str = "f1", variance: float | None = None, correlation: float | None = None, seed: int = 42, **params) -> dict[str, Any]:
    """One model from features to metrics, for wallets or assets alike.

    The target is made of the data's columns; rows are split by hash within each ``stratum`` into train, eval (stops boosting
    early) and test; weak columns are dropped by what train shows; the threshold is a number or, for classifiers, the best
    F-beta on eval. Gives the fitted ``model``, ``threshold``, ``columns``, and ``metrics``: a row for the test rows and one
    for ``validation``, data of later epochs with the same columns.
    """
    rows = settled(targets.stratified_split(data.withColumn("target", target.cast("double")), key, stratum, shares or {"test": 0.2, "eval": 0.1}, "train", seed))
    train = rows.where("split = 'train'")
    drop = models.select_features(train, list(columns), -1.0 if variance is None else variance, 2.0 if correlation is None else correlation) if variance is not None or correlation is not None else None
    fit = rows.where("split <> 'test'").withColumn("_eval", F.col("split") == "eval") if kind.startswith("gbt") else train
    model = models.build(kind, columns, validation="_eval" if kind.startswith("gbt") else None, drop=drop, seed=seed, **params).fit(fit)
    classes = kind.endswith("classifier")
    cut = models.threshold(models.score(model, rows.where("split = 'eval'")).withColumn("actual", F.col("target").cast("int")), threshold) if classes else None
    parts = {"test": rows.where("split = 'test'")} | ({"validation": validation.withColumn("target", target.cast("double"))} if validation is not None else {})
    metrics = None
    for name, part in parts.items():
        scored = settled(models.score(model, part).select("score", F.col("target").cast("int" if classes else "double").alias("actual")))
        m = evaluate.classification(scored, cut).crossJoin(evaluate.roc_auc(scored)) if classes else evaluate.regression(scored, "actual", "score")
        m = m.select(F.lit(name).alias("data"), "*")
        metrics = m if metrics is None else metrics.unionByName(m)
    dropped = set(drop.getOrDefault(drop.columns)) if drop else set()
    return {"model": model, "threshold": cut, "columns": [c for c in columns if c not in dropped], "metrics": metrics}


def train_scores(definitions: Mapping[str, Mapping], data: DataFrame, columns: Sequence[str], key: str, folder: str | None = None, rebuild: bool = False, **common) -> dict[str, tuple[PipelineModel, float]]:
    """A model and threshold for each named score: arguments of ``model_job`` that differ from ``common``. With a folder,
    models and thresholds are saved there and read again unless ``rebuild``."""
    spark, out = data.sparkSession, {}
    for name, own in definitions.items():
        path = f"{folder}/{name}" if folder else None
        if path and not rebuild and tables.exists(spark, f"{path}/threshold"):  # written last
            out[name] = (PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/threshold").first()["threshold"])
            continue
        done = model_job(data, columns, key=key, **{**common, **own})
        out[name] = (done["model"], done["threshold"])
        if path:
            done["model"].write().overwrite().save(f"{path}/model")
            spark.createDataFrame([(done["threshold"],)], "threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/threshold")
    return out


def investment_cycles(epochs: DataFrame, columns: Sequence[str], target: Column, kind: str, cycles: Sequence[str], hold: int, seed: int = 42, **params) -> DataFrame:
    """(time_window, coin_id, score, coin_return): for each cycle a model of the epochs whose returns were known by then, its
    scores of the assets on that day, and what they returned. ``epochs`` is as ``coin_epochs`` gives it; a cycle without
    past epochs, or a scored asset without a return, is an error."""
    out, epochs = None, settled(epochs)
    for buy in cycles:
        known = epochs.where(F.date_add("time_window", hold - 1) < F.lit(buy).cast("date")).withColumn("target", target.cast("double"))
        now = epochs.where(F.col("time_window") == F.lit(buy).cast("date"))
        if known.isEmpty():
            raise ValueError(f"no epoch was over on {buy}")
        scored = models.score(models.build(kind, columns, seed=seed, **params).fit(known), now).select(*WINDOW, "score", "coin_return")
        if lost := scored.where("coin_return is null").count():
            raise ValueError(f"{lost} scored assets of {buy} have no return")
        out = scored if out is None else out.unionByName(scored)
    return out


def cycle_report(scored: DataFrame, thresholds: Sequence[float], cutoff: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Returns by cycle and threshold, and compounded over all cycles."""
    from flowledger.operators import invest

    by_cycle = invest.cycles(scored.withColumnRenamed("time_window", "epoch"), thresholds, cutoff)
    return by_cycle, invest.lifetime(by_cycle)


def k_fold(data: DataFrame, columns: Sequence[str], kind: str, key: str, folds: int, evaluator: models.Evaluator, seed: int = 42, **params) -> DataFrame:
    """(fold, score): each fold, by a hash of the key, scored by a model of the others."""
    rows = settled(data.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds))))
    out = []
    for i in range(folds):
        model = models.build(kind, columns, seed=seed, **params).fit(rows.where(F.col("_fold") != i))
        out.append((i, float(evaluator.evaluate(models.score(model, rows.where(F.col("_fold") == i))))))
    return data.sparkSession.createDataFrame(out, "fold int, score double")

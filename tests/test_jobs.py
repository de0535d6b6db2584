"""Jobs: errors, warnings and properties that don't hang on a model's random numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowledger.operators import jobs, models, targets
from flowledger.plans import q_jobs
from flowledger.plans import views as v
from flowledger.sources import tables

SF = "/root/testdata/sf0.01"
COLUMNS = ["balance", "holders", "score_by_balance", "price_mean", "price_last"]


def test_lone_keys_are_told(spark):
    a, b = spark.range(5).withColumnRenamed("id", "coin_id"), spark.range(2, 9).withColumnRenamed("id", "coin_id").withColumn("x", F.lit(1))
    with pytest.warns(UserWarning, match="2 of the left set, 4 of the right"):
        assert jobs.join_features(a, b).count() == 3


def test_epochs_beyond_the_data(spark):
    led, s, m = v.ledger(spark, SF), v.scores(spark, SF), v.market(spark, SF)
    last = m.agg(F.max("date")).first()[0]
    late = [str(last - dt.timedelta(2)), str(last)]
    with pytest.raises(ValueError, match="beyond the data"):
        jobs.coin_epochs(led, s, m, late, 5, 5, q_jobs.SPEC)
    only = jobs.coin_epochs(led, s, m, late, 5, 5, q_jobs.SPEC, training_only=True)
    assert "coin_return" not in only.columns and only.select("time_window").distinct().count() == 2


def test_cycles_learn_from_the_past(spark, monkeypatch):
    """A model sees no epoch whose returns weren't known on the buying day."""
    starts = [f"2024-01-{k:02}" for k in range(8, 24)]
    e = jobs.coin_epochs(v.ledger(spark, SF), v.scores(spark, SF), v.market(spark, SF), starts, 7, 3, q_jobs.SPEC).persist()
    seen = []
    build = models.build

    class Spy:
        def __init__(self, made):
            self.made = made

        def fit(self, df):
            seen.append(df.agg(F.max("time_window")).first()[0])
            return self.made.fit(df)

    monkeypatch.setattr(models, "build", lambda *a, **k: Spy(build(*a, **k)))
    out = jobs.investment_cycles(e, COLUMNS, F.col("coin_return") > 0, "rf_classifier", ["2024-01-18", "2024-01-21"], 3, numTrees=3)
    assert seen == [dt.date(2024, 1, 15), dt.date(2024, 1, 18)]
    assert {str(r[0]) for r in out.select("time_window").distinct().collect()} == {"2024-01-18", "2024-01-21"} and out.where("score is null or coin_return is null").count() == 0
    with pytest.raises(ValueError, match="no epoch was over"):
        jobs.investment_cycles(e, COLUMNS, F.col("coin_return") > 0, "rf_classifier", ["2024-01-09"], 3)
    by_cycle, life = jobs.cycle_report(out, [0.5])
    assert by_cycle.count() == 2 and life.first()["coins"] == out.where("score >= 0.5").count()


def test_scores_are_read_again(spark):
    m = q_jobs.window_matrix(spark, SF).persist()
    folder = tables.scratch(spark, "test-scores")
    args = {"data": m, "columns": q_jobs.FEATURES, "key": "wallet_address", "folder": folder}
    one = {"up": {"target": targets.select_target("later", 0.01), "kind": "rf_classifier", "numTrees": 3}}
    a = jobs.train_scores(one, **args)
    b = jobs.train_scores({"up": {"target": F.lit(1), "kind": "none"}}, **args)  # not used: the saved one is
    assert a["up"][1] == b["up"][1]
    x, y = (models.score(t["up"][0], m).agg(F.sum("score")).first()[0] for t in (a, b))
    assert x == pytest.approx(y)


def test_model_job_parts(spark):
    m = q_jobs.window_matrix(spark, SF)
    done = jobs.model_job(m, q_jobs.FEATURES, targets.select_target("later", 0.01), "rf_classifier", "wallet_address", validation=m, variance=0.5, correlation=0.2, numTrees=3)
    rows = {r["data"]: r for r in done["metrics"].collect()}
    assert set(rows) == {"test", "validation"} and 0 < done["threshold"] < 1 and len(done["columns"]) < len(q_jobs.FEATURES)
    n = {k: r["tp"] + r["fp"] + r["tn"] + r["fn"] for k, r in rows.items()}
    assert n["validation"] == m.count() and 0.1 * n["validation"] < n["test"] < 0.3 * n["validation"]
    folds = jobs.k_fold(m.withColumn("target", (F.col("later") > 0).cast("double")), q_jobs.FEATURES, "rf_classifier", "wallet_address", 3, models.MetricEvaluator("auc"), numTrees=3)
    assert folds.count() == 3 and all(0 <= r["score"] <= 1 for r in folds.collect())
    with pytest.raises(ValueError):
        models.MetricEvaluator("accuracy")


def test_splits_of_a_large_stratum(spark):
    """Every stratum is split by exact numbers, whatever its size, and keys beyond 32 bits are taken."""
    df = spark.range(3000).select(F.abs(F.xxhash64("id")).alias("k"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("s"))
    got = {(r["s"], r["split"]): r["count"] for r in targets.stratified_split(df, "k", "s", {"test": 0.2, "eval": 0.1}, "train").groupBy("s", "split").count().collect()}
    assert got == {("small", "test"): 60, ("small", "eval"): 30, ("small", "train"): 210, ("large", "test"): 540, ("large", "eval"): 270, ("large", "train"): 1890}

"""Clusters, forests, searches and their reports against numbers worked out without them."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from flowledger.operators import jobs, models


def blobs(spark, n=30, seed=1):
    rng = random.Random(seed)
    centres = [(0, 0, 5), (40, 3, 5), (0, 60, 6)]
    rows = [(c * n + i, c, *[x + rng.gauss(0, 0.5) for x in centres[c]]) for c in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, truth int, a double, b double, c double"), rows


def test_distances_are_those_to_the_means_of_the_clusters(spark):
    df, rows = blobs(spark)
    out = models.cluster_distances(df, ["a", "b", "c"], 3, [3], labels=True).orderBy("id").collect()
    x = np.array([r[2:] for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)  # a full rotation keeps distances
    label = np.array([r["k3/label"] for r in out])
    assert len({(a, b) for a, b in zip(label, [r[1] for r in rows], strict=True)}) == 3
    for k in range(3):
        want = np.linalg.norm(z - z[label == k].mean(0), axis=1)
        assert np.allclose([r[f"k3/distance_to_cluster_{k}"] for r in out], want, atol=1e-9)


def test_input_is_computed_once(spark):
    """However many fits and values of k there are, each row of the input is made once."""
    df, rows = blobs(spark)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    models.cluster_distances(df.coalesce(1).mapInPandas(count, df.schema), ["a", "b", "c"], 3, [2, 3, 4], labels=True).collect()
    assert made.value == len(rows)
    made.value = 0
    models.cluster_sweep(df.coalesce(1).mapInPandas(count, df.schema), ["a", "b", "c"], [2, 3]).collect()
    assert made.value == len(rows)


def test_sweep_finds_the_elbow(spark):
    df, rows = blobs(spark)
    x = np.array([r[2:] for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = {r["k"]: r for r in models.cluster_sweep(df, ["a", "b", "c"], [2, 3, 4, 5], share=1.0).collect()}
    parts = [z[np.array([r[1] for r in rows]) == k] for k in range(3)]
    assert got[3]["components"] == 3 and got[3]["inertia"] == pytest.approx(sum(((p - p.mean(0)) ** 2).sum() for p in parts))
    assert got[3]["elbow"] and got[3]["silhouette"] == max(r["silhouette"] for r in got.values())
    assert got[2]["inertia"] > got[3]["inertia"] > got[5]["inertia"]


def test_scores_are_the_votes_of_the_trees(spark):
    df, _ = blobs(spark)
    rows = df.withColumn("target", (F.col("truth") == 2).cast("double"))
    model = models.build("rf_classifier", ["a", "b", "c"], numTrees=7, maxDepth=3).fit(rows)
    scored = models.score(model, rows).collect()
    x = {r["id"]: np.array([r["a"], r["b"], r["c"]]) for r in scored}
    trees = model.stages[-1].trees
    for r in scored[::11]:
        votes = [t.predictProbability(DenseVector(x[r["id"]]))[1] for t in trees]
        assert r["score"] == pytest.approx(sum(votes) / len(votes))
    sure = models.dispersion(model, rows, ["a", "b", "c"]).collect()
    for r in sure[::11]:
        p = [t.predict(DenseVector(x[r["id"]])) for t in trees]
        mean = sum(p) / len(p)
        want = 1 - math.sqrt(sum((q - mean) ** 2 for q in p) / len(p)) / mean if mean else None
        assert r["confidence"] == (None if want is None else pytest.approx(want))


def test_three_classes_add_up(spark):
    df, _ = blobs(spark)
    rows = df.withColumn("target", F.col("truth").cast("double"))
    model = models.build("rf_classifier", ["a", "b", "c"], numTrees=5, featureSubsetStrategy="all").fit(rows)
    one, two = models.score(model, rows, [2]), models.score(model, rows, [1, 2])
    both = one.select("id", "truth", F.col("score").alias("x")).join(two.select("id", F.col("score").alias("y")), "id").collect()
    assert all(r["y"] >= r["x"] - 1e-12 for r in both)
    odd = [r for r in both if (r["x"] > 0.5) != (r["truth"] == 2) or (r["y"] > 0.5) != (r["truth"] > 0)]
    assert len(odd) <= 2, odd  # splits are at quantiles of a sample


def test_search_report_is_the_mean_over_combinations(spark):
    rows = [(i, p, val, s) for i, (p, val, s) in enumerate([("d", "1", 0.5), ("d", "2", 0.7), ("d", "1", 0.9), ("t", "5", 0.5)])]
    got = models.search_report(spark.createDataFrame(rows, "combination int, param string, value string, score double")).collect()
    assert {(r["value"], round(r["mean_score"], 9), r["combinations"]) for r in got} == {("1", 0.7, 2), ("2", 0.7, 1)}


def test_search_scores_what_it_fits(spark):
    """Each combination's score is that of the same fit made by hand."""
    df, _ = blobs(spark)
    rows = df.withColumn("target", (F.col("a") + F.col("b") > 30).cast("double"))
    train, test = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    found = models.random_search(train, test, {"maxDepth": [1, 2], "numTrees": [1, 3]}, 3, "rf_classifier", ["a", "b"], models.MetricEvaluator("neg_log_loss"))
    for _, own in itertools.groupby(sorted(map(tuple, found.collect())), key=lambda r: r[0]):
        own = list(own)
        params = {p: int(x) for _, p, x, _ in own}
        model = models.build("rf_classifier", ["a", "b"], seed=42, **params).fit(train)
        q = [(min(max(r["score"], 1e-15), 1 - 1e-15), r["target"]) for r in models.score(model, test).collect()]
        want = sum(math.log(p if y else 1 - p) for p, y in q) / len(q)
        assert own[0][3] == pytest.approx(want)


def test_folds_hold_every_row_once(spark, monkeypatch):
    """Every row is scored once, by a model that hasn't seen it."""
    df, _ = blobs(spark)
    rows = df.withColumn("target", (F.col("truth") == 2).cast("double"))
    seen = []

    class Spy:
        def __init__(self, pipeline):
            self.pipeline = pipeline

        def fit(self, part):
            self.ids = {r["id"] for r in part.select("id").collect()}
            return self, self.pipeline.fit(part)

    build, score = models.build, models.score
    monkeypatch.setattr(models, "build", lambda *a, **k: Spy(build(*a, **k)))
    monkeypatch.setattr(models, "score", lambda m, part: seen.append((m[0].ids, {r["id"] for r in part.select("id").collect()})) or score(m[1], part))
    got = jobs.k_fold(rows, ["a", "b", "c"], "rf_classifier", "id", 3, models.MetricEvaluator("auc"), numTrees=3, featureSubsetStrategy="all").collect()
    assert [r["fold"] for r in got] == [0, 1, 2] and all(r["score"] == pytest.approx(1) for r in got), got
    assert all(not (a & b) and len(a | b) == 90 for a, b in seen)
    assert Counter(i for _, b in seen for i in b) == Counter(range(90))


def test_stored_scores_need_a_whole_write(spark, tmp_path):
    """A threshold whose write broke off doesn't count as saved."""
    df, _ = blobs(spark)
    data = df.withColumn("late", (F.col("truth") == 2).cast("double")).withColumn("time_window", F.lit("w"))
    (tmp_path / "late/threshold").mkdir(parents=True)
    (tmp_path / "late/threshold/part-0.json").write_text('{"threshold": 0.99}')
    asked = []
    real = jobs.model_job

    def job(*a, **k):
        asked.append(1)
        return {"model": models.build("rf_classifier", ["a", "b"], label="late", numTrees=2).fit(data), "threshold": 0.25}

    jobs.model_job = job
    try:
        first = jobs.train_scores({"late": {}}, data, ["a", "b"], "id", f"file://{tmp_path}")
        second = jobs.train_scores({"late": {}}, data, ["a", "b"], "id", f"file://{tmp_path}")
    finally:
        jobs.model_job = real
    assert len(asked) == 1 and first["late"][1] == second["late"][1] == 0.25

"""Models on Spark ML: clustering features, tree models with thresholds, scorers, searches. Results depend on seeds."""

from __future__ import annotations

import fnmatch
import json
import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, Evaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.functions.order import free, quantiles, settled, winsorize
from flowledger.operators import evaluate, targets


def matching(columns: Sequence[str], patterns: Sequence[str], protected: Sequence[str] = ()) -> list[str]:
    """Columns that match a glob and no protected one; a pattern without a match is an error."""
    if idle := [p for p in patterns if not fnmatch.filter(columns, p)]:
        raise ValueError(f"patterns that match nothing: {idle}")
    keep = {c for p in protected for c in fnmatch.filter(columns, p)}
    return [c for c in columns if c not in keep and any(fnmatch.fnmatch(c, p) for p in patterns)]


class DropColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage that holds a learned list of columns to drop, so that scoring drops the same ones."""

    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault(self.columns))


def select_features(df: DataFrame, columns: Sequence[str], variance: float, correlation: float, protected: Sequence[str] = ()) -> DropColumns:
    low = targets.low_variance(df, columns, variance, protected)
    rest = [c for c in columns if c not in low]
    return DropColumns(columns=[*low, *targets.correlated(df, rest, correlation, protected)])


# clusters


def cluster_distances(df: DataFrame, columns: Sequence[str], components: int, ks: Sequence[int], seed: int = 42, labels: bool = False) -> DataFrame:
    """Distances to the centres of k clusters, kN/distance_to_cluster_i, in a space of standardised principal components."""
    filled = settled(df.na.fill(0, list(columns)))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True), PCA(k=components, inputCol="_z", outputCol="_p")]
    space = settled(Pipeline(stages=stages).fit(filled).transform(filled).drop("_v", "_z"))
    points = space.select("_p")
    for k in ks:
        centres = KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="_k").fit(points).clusterCenters()
        x = vector_to_array("_p")
        dist = [F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) for c in centres]
        space = space.withColumns({f"k{k}/distance_to_cluster_{i}": d for i, d in enumerate(dist)})
        if labels:
            space = space.withColumn(f"k{k}/label", nearest_cluster(k))
    return space.drop("_p")


def nearest_cluster(k: int) -> Column:
    a = F.array(*[F.col(f"`k{k}/distance_to_cluster_{i}`") for i in range(k)])
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def cluster_sweep(df: DataFrame, columns: Sequence[str], ks: Sequence[int], share: float = 0.8, sample: int = 10_000, seed: int = 42) -> DataFrame:
    """(k, components, inertia, silhouette, elbow): silhouette on a bounded sample; the elbow is farthest from the chord."""
    filled = settled(df.na.fill(0, list(columns)))
    pre = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True), PCA(k=len(columns), inputCol="_z", outputCol="_p")]).fit(filled)
    run, comps = 0.0, len(columns)
    for i, v in enumerate(pre.stages[2].explainedVariance.toArray()):
        run += v
        if run >= share:
            comps = i + 1
            break
    turned = pre.transform(filled)
    space = settled(PCA(k=comps, inputCol="_z", outputCol="_q").fit(turned).transform(turned).drop("_v", "_z", "_p"))
    some = space.orderBy(F.xxhash64(*columns)).limit(sample)
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=seed, featuresCol="_q", predictionCol="_k").fit(space)
        rows.append((k, comps, float(m.summary.trainingCost), float(ClusteringEvaluator(featuresCol="_q", predictionCol="_k").evaluate(m.transform(some)))))
    (k0, _, c0, _), (k1, _, c1, _) = rows[0], rows[-1]
    away = [abs((c1 - c0) * (k - k0) - (k1 - k0) * (c - c0)) for k, _, c, _ in rows]
    return df.sparkSession.createDataFrame([(*r, a == max(away)) for r, a in zip(rows, away, strict=True)], "k int, components int, inertia double, silhouette double, elbow boolean")


# models

KINDS = {"rf_classifier": RandomForestClassifier, "rf_regressor": RandomForestRegressor, "gbt_classifier": GBTClassifier, "gbt_regressor": GBTRegressor}


def build(kind: str, columns: Sequence[str], label: str = "target", weight: str | None = None, validation: str | None = None, drop: DropColumns | None = None, seed: int = 42, **params) -> Pipeline:
    """Pipeline of drops, assembling and a tree model. ``validation`` marks rows that stop boosting early."""
    if kind not in KINDS:
        raise ValueError(f"no such model: {kind}")
    dropped = set(drop.getOrDefault(drop.columns)) if drop else set()
    args = {"featuresCol": "_x", "labelCol": label, "seed": seed, **params}
    if weight:
        args["weightCol"] = weight
    if validation and kind.startswith("gbt"):
        args["validationIndicatorCol"] = validation
    assemble = VectorAssembler(inputCols=[c for c in columns if c not in dropped], outputCol="_x", handleInvalid="keep")
    return Pipeline(stages=[*([drop] if drop else []), assemble, KINDS[kind](**args)])


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Weights that give every class the same sum."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    w = None
    for k, c in n.items():
        x = F.col(label) == k
        w = F.when(x, sum(n.values()) / (len(n) * c)) if w is None else w.when(x, sum(n.values()) / (len(n) * c))
    return df.withColumn("weight", w)


def score(model: PipelineModel, df: DataFrame, classes: Sequence[int] = (1,), out: str = "score") -> DataFrame:
    """The predicted value, or the probability of the given classes together (class 2 of three, say)."""
    p = model.transform(df)
    if "probability" in p.columns:
        a = vector_to_array("probability")
        total = F.lit(0.0)
        for k in classes:
            total = total + a[k]
        p = p.withColumn(out, total)
    else:
        p = p.withColumn(out, F.col("prediction"))
    return p.drop("_x", "rawPrediction", "probability", "prediction")


def threshold(df: DataFrame, how: float | str, y: str = "actual", p: str = "score") -> float:
    """A number as it is, or "f<beta>": the threshold with the best F-beta on ``df``."""
    if isinstance(how, str):
        return float(evaluate.f_beta(df, [float(how[1:])], y, p).first()["threshold"])
    return float(how)


def dispersion(model: PipelineModel, df: DataFrame, columns: Sequence[str], out: str = "confidence") -> DataFrame:
    """1 - deviation over mean of the trees' own predictions of a forest."""
    forest = model.stages[-1]
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep").transform(df)
    for i, tree in enumerate(forest.trees):
        rows = tree.setPredictionCol(f"_t{i}").transform(rows).drop("rawPrediction", "probability")
    a = F.array(*[f"_t{i}" for i in range(len(forest.trees))])
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    var = F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) / F.size(a) - mean * mean
    return rows.withColumn(out, 1 - F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), F.abs(mean))).drop("_x", *[f"_t{i}" for i in range(len(forest.trees))])


class ReturnEvaluator(Evaluator):
    """Mean winsorized return of the top share by score, or of all scored above a threshold."""

    def __init__(self, ret: str = "actual_return", p: str = "score", share: float | None = 0.01, above: float | None = None, cutoff: float = 0.005):
        super().__init__()
        self.ret, self.p, self.share, self.above, self.cutoff = ret, p, share, above, cutoff

    def _evaluate(self, df: DataFrame) -> float:
        rows = winsorize(df.withColumn("_w", F.col(self.ret)), ["_w"], self.cutoff)
        cut = self.above if self.above is not None else quantiles(rows, [self.p], [1 - self.share]).get(self.p, [None])[0]
        got = rows.where(F.col(self.p) >= cut).agg(F.avg("_w")).first()[0]
        return float(got) if got is not None else float("-inf")

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


class MetricEvaluator(Evaluator):
    """A score to be maximised: ``neg_log_loss``, ``auc`` (of actual 0 or 1; of three classes, 2 counts as 1), ``neg_rmse``, ``r2``."""

    def __init__(self, metric: str, y: str = "target", p: str = "score"):
        super().__init__()
        if metric not in ("neg_log_loss", "auc", "neg_rmse", "r2"):
            raise ValueError(f"no such metric: {metric}")
        self.metric, self.y, self.p = metric, y, p

    def _evaluate(self, df: DataFrame) -> float:
        if self.metric in ("neg_rmse", "r2"):
            r = evaluate.regression(df, self.y, self.p).first()
            return float(-r["rmse"] if self.metric == "neg_rmse" else r["r2"])
        top = df.agg(F.max(self.y)).first()[0]
        rows = df.withColumn("_actual", (F.col(self.y) == (2 if top == 2 else 1)).cast("int"))
        if self.metric == "auc":
            area = evaluate.roc_auc(rows, "_actual", self.p).first()["roc_auc"]
            return 0.5 if area is None else float(area)  # one class alone tells nothing
        return -float(evaluate.classification(rows, 0.5, "_actual", self.p).first()["log_loss"])

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def random_search(train: DataFrame, test: DataFrame, space: Mapping[str, Sequence], n: int, kind: str, columns: Sequence[str], evaluator: Evaluator, label: str = "target", seed: int = 42, variants: Mapping[str, Column] | None = None) -> DataFrame:
    """(combination, param, value, score) for n sampled combinations; drop_patterns, if in the space, choose columns, and
    target chooses one of the named ``variants`` of the label."""
    rng = random.Random(seed)
    rows, train, test = [], settled(train), settled(test)
    for i in range(n):
        combo = {k: rng.choice(list(v)) for k, v in sorted(space.items())}
        patterns = combo.get("drop_patterns")
        used = [c for c in columns if c not in set(matching(columns, patterns))] if patterns else list(columns)
        params = {k: v for k, v in combo.items() if k not in ("drop_patterns", "target")}
        a, b = (x.withColumn(label, variants[combo["target"]].cast("double")) for x in (train, test)) if "target" in combo else (train, test)
        s = float(evaluator.evaluate(score(build(kind, used, label, seed=seed, **params).fit(a), b)))
        rows += [(i, k, str(v), s) for k, v in combo.items()]
    return train.sparkSession.createDataFrame(rows, "combination int, param string, value string, score double")


_RESULT = "date string, combination int, params string, score double"


def _combinations(space: Mapping[str, Sequence], n: int, seed: int) -> list[dict]:
    """The empty one, which is the baseline, and n different draws, fewer if there aren't so many."""
    rng = random.Random(seed)
    most = math.prod(len(v) for v in space.values())
    drawn: dict[str, dict] = {}
    while len(drawn) < min(n, most):
        combo = {k: rng.choice(list(v)) for k, v in sorted(space.items())}
        drawn.setdefault(json.dumps(combo, sort_keys=True), combo)
    return [{}, *drawn.values()]


def date_search(rows: DataFrame, space: Mapping[str, Sequence], n: int, kind: str, columns: Sequence[str], evaluator: Evaluator, path: str, date: str = "date", split: str = "split", label: str = "target", seed: int = 42, parallel: int = 4) -> DataFrame:
    """(date, combination, params, score): the same n sampled combinations on every date of ``rows``, and combination 0, the
    baseline: default parameters and all columns.

    The features are assembled once for all fits and settled; drop_patterns, if in the space, choose among them. Fits of
    several (date, combination) pairs run side by side. ``rows`` are trained on where ``split`` is train and scored where it
    is test. Every result is written to ``path`` when it is known, and one that is there is not fitted again, so a search
    that broke off, or that gets more dates or combinations, goes on from there. Another space under the same path is an
    error.
    """
    spark = rows.sparkSession
    combos = _combinations(space, n, seed)
    whole = VectorAssembler(inputCols=list(columns), outputCol="_all", handleInvalid="keep").transform(rows)
    whole = settled(whole.select(F.col(date).cast("string").alias("_date"), split, *[c for c in rows.columns if c not in (date, split, *columns)], "_all"))
    found = sorted(r["_date"] for r in whole.select("_date").distinct().collect())  # a row for each date
    known = {(r["date"], r["combination"]): r["params"] for r in spark.read.schema(_RESULT).parquet(f"{path}/*/*").collect()} if there(spark, path) else {}
    told = [json.dumps(c, sort_keys=True) for c in combos]
    if other := [k for k, p in known.items() if k[1] < len(told) and p != told[k[1]]]:
        raise ValueError(f"results of another search: {other[0]}")

    def fit(task: tuple[str, int]) -> None:
        day, i = task
        combo = combos[i]
        patterns = combo.get("drop_patterns")
        used = [k for k, c in enumerate(columns) if c not in set(matching(columns, patterns) if patterns else ())]
        params = {k: v for k, v in combo.items() if k != "drop_patterns"}
        slicer = VectorSlicer(inputCol="_all", outputCol="_x", indices=used)
        own = whole.where(F.col("_date") == day)
        model = Pipeline(stages=[slicer, KINDS[kind](featuresCol="_x", labelCol=label, seed=seed, **params)]).fit(own.where(F.col(split) == "train"))
        got = float(evaluator.evaluate(score(model, own.where(F.col(split) == "test"))))
        spark.createDataFrame([(day, i, told[i], got)], _RESULT).coalesce(1).write.mode("overwrite").parquet(f"{path}/date={day}/combination={i}")

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(fit, [(d, i) for d in found for i in range(len(combos)) if (d, i) not in known]))
    free(whole)
    return spark.read.schema(_RESULT).parquet(*[f"{path}/date={d}/combination={i}" for d in found for i in range(len(combos))])


def search_report(results: DataFrame) -> DataFrame:
    """(param, value): mean score of the values of parameters that vary."""
    vary = results.groupBy("param").agg(F.countDistinct("value").alias("n")).where("n > 1")
    return results.join(vary, "param", "left_semi").groupBy("param", "value").agg(F.avg("score").alias("mean_score"), F.count("*").alias("combinations"))


def there(spark: SparkSession, path: str) -> bool:
    """Whether something has been written at ``path``, wherever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def saved(path: str, fit, rebuild: bool = False) -> PipelineModel:
    """The model at ``path``, fitted and saved unless it is there."""
    if not rebuild and there(SparkSession.active(), path):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


def score_epochs(trained: Mapping[str, tuple[PipelineModel, float]], df: DataFrame) -> DataFrame:
    """Scores of a later epoch by several fixed models: wallet_address, score|name, binary|name."""
    from flowledger.sources.tables import join_scores, wallet_scores

    return join_scores({n: wallet_scores(score(m, df), n, t) for n, (m, t) in trained.items()})

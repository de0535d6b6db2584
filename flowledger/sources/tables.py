"""Sinks and sources: Parquet, CSV, JSON reports, cached data sets, scores with run metadata, exports by split."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import date as dates
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is there, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_sorted(df: DataFrame, path: str, first: Sequence[str] = ()) -> None:
    """Parquet with columns in a stable order; the committer leaves nothing half written."""
    cols = [*first, *sorted(c for c in df.columns if c not in first)]
    df.select(*[F.col(f"`{c}`") for c in cols]).write.mode("overwrite").parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, covers: tuple[str, str] | None = None, date: str = "date") -> DataFrame:
    """The data set at ``path``, built and written if it isn't there, doesn't reach over ``covers``, or ``force`` is set."""
    if not force and exists(spark, path):
        df = spark.read.parquet(path)
        if covers is None:
            return df
        a, b = df.agg(F.min(date).cast("string"), F.max(date).cast("string")).first()
        if a is not None and a <= covers[0] and b >= covers[1]:
            return df
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def grown(spark: SparkSession, path: str, build: Callable[[str, str], DataFrame], start: str, end: str, date: str = "date") -> DataFrame:
    """Rows of the days from ``start`` to ``end`` of a data set that grows: only days that it has never had are built, by
    ``build(first, last)`` for each gap, and appended, a folder for each day.

    A manifest beside the data lists the days that are done, those without a row too. It is written after a gap's data, so
    a run that broke off is done again from there, over what it had left."""
    done, data = f"{path}/manifest", f"{path}/data"
    folder = spark._jvm.org.apache.hadoop.fs.Path(done)
    known = set()
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = {r["day"] for r in spark.read.schema("day string").json(done).collect()}  # a row for each day
    a, b = (dates.fromisoformat(x) for x in (start, end))
    missing = [d for k in range((b - a).days + 1) if str(d := a + timedelta(k)) not in known]
    gaps: list[list[dates]] = []
    for d in missing:
        if gaps and d == gaps[-1][1] + timedelta(1):
            gaps[-1][1] = d
        else:
            gaps.append([d, d])
    for first, last in gaps:
        rows = build(str(first), str(last)).where(F.col(date).between(str(first), str(last)))
        rows.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(data)
        days = [(str(first + timedelta(k)),) for k in range((last - first).days + 1)]
        spark.createDataFrame(days, "day string").coalesce(1).write.mode("append").json(done)
    return spark.read.parquet(data).withColumn(date, F.col(date).cast("date")).where(F.col(date).between(start, end))


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` written once as a table of buckets by ``keys``, each sorted by the keys and ``order``, and read back: what groups,
    windows or joins it by the keys, or by the keys and more (a window, an epoch), needs no exchange of its own.

    A ledger is laid out by pair this way before several families of features are made of it. There are as many buckets as
    shuffle partitions unless said otherwise."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"laid_out_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys, *order).option("path", path or scratch(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a key is there twice: {twice[0]}")
    return df


def write_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    require_unique(df, keys).write.mode("overwrite").option("header", True).csv(path)


def read_csv_union(spark: SparkSession, paths: Sequence[str], schemas: Sequence[str]) -> DataFrame:
    """Data sets with one prefix, columns aligned by name, missing ones NULL."""
    out = None
    for p, s in zip(paths, schemas, strict=True):
        df = spark.read.option("header", True).schema(s).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_model_input(x: DataFrame, y: DataFrame, keys: Sequence[str], path: str) -> None:
    """Features and target, joined, one folder for each split."""
    x.join(y, list(keys)).write.mode("overwrite").partitionBy("split").parquet(path)


def append_scores(scores: DataFrame, scores_path: str, runs_path: str, meta: Mapping[str, str]) -> str:
    """Scores of exactly one epoch, appended with a new run id; the run's metadata go into a table of their own."""
    if scores.select("epoch").distinct().limit(2).count() != 1:
        raise ValueError("scores must be of one epoch")
    run = uuid.uuid4().hex
    spark = scores.sparkSession
    scores.withColumn("run_id", F.lit(run)).write.mode("append").parquet(scores_path)
    spark.createDataFrame([(run, dict(meta))], "run_id string, meta map<string, string>").write.mode("append").parquet(runs_path)
    return run


def read_scores(spark: SparkSession, pattern: str) -> DataFrame:
    """Score files by a glob; a file with more than one epoch is an error."""
    df = spark.read.parquet(pattern).withColumn("_f", F.input_file_name())
    bad = df.groupBy("_f").agg(F.countDistinct("epoch").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"more than one epoch in {bad[0]['_f']}")
    return df.drop("_f")


def join_scores(frames: Mapping[str, DataFrame], key: str = "wallet_address") -> DataFrame:
    """One row per wallet with score|name, binary|name of each score; wallets of any of them."""
    out = None
    for name, df in frames.items():
        own = df.select(key, *[F.col(f"`{c}`").alias(f"{c.split('|')[0]}|{name}") for c in df.columns if c != key])
        out = own if out is None else out.join(own, key, "outer")
    return out


def wallet_scores(df: DataFrame, name: str, threshold: float, score: str = "score") -> DataFrame:
    return df.select("wallet_address", F.col(score).alias(f"score|{name}"), (F.col(score) >= threshold).cast("int").alias(f"binary|{name}"))


def export_splits(sets: Mapping[str, DataFrame], folder: str, date: str, keys: Sequence[str], sample: int = 1000) -> None:
    """Every named set, a small development sample of each in key order, and the numbers of rows as JSON."""
    spark = next(iter(sets.values())).sparkSession
    rows = []
    for name, df in sets.items():
        n = df.count()
        if not n:
            raise ValueError(f"{name} is empty")
        df.write.mode("overwrite").parquet(f"{folder}/{name}_{date}")
        df.orderBy(*keys).limit(sample).write.mode("overwrite").parquet(f"{folder}/{name}_{date}_dev")
        rows.append((name, date, n, len(df.columns)))
    spark.createDataFrame(rows, "name string, date string, rows long, columns int").coalesce(1).write.mode("overwrite").json(f"{folder}/metadata_{date}")


def store_report(spark: SparkSession, path: str, model_id: str, report_json: str) -> None:
    spark.createDataFrame([(model_id, report_json)], "model_id string, report string").write.mode("append").json(path)


def load_report(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    return spark.read.schema("model_id string, report string").json(path).where(F.col("model_id") == model_id)


def replace_view(df: DataFrame, name: str, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """A view of ``df`` cut to an uploaded set of keys; an older one of that name is replaced."""
    df.join(keys.select(*on).distinct(), list(on), "left_semi").createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; without that setting, in local mode, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="flowledger-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

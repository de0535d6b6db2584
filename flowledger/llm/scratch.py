"""Tables between two steps, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, which only local mode allows, a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="flowledger-"))


def lean(spark: SparkSession) -> None:
    """Set the session's Arrow batches to a few MB: ten thousand whole texts, Spark's default, are too many to hold at
    once, on either side, for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(names) -> list:
    """Columns of a table by their names, whatever characters these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is used once."""
    return f"{folder(spark)}/flowledger/{spark.conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in a folder for each value of column ``by`` if named, and read it back.

    This cuts the lineage: what follows is computed from files that survive the loss of an executor, and random or
    Python steps before it run once. The folder of a session can be deleted when its results have been written.
    """
    spark = df.sparkSession
    path = place(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

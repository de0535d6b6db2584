"""Session settings that the operators rely on."""

from pyspark.sql import SparkSession


def session(app: str = "flowledger", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC dates, ANSI arithmetic and adaptive execution.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: the submit command names them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()

"""A series to one row of features, by a spec; and joins of flattened tables by policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions import expr

STATS = {"sum": F.sum, "mean": F.avg, "median": F.median, "std": F.stddev_samp, "max": F.max, "min": F.min}


def aggregation(c: str, kind: str) -> Column:
    """One of sum, mean, median, std, max, min, first or last; the last two by position, so they may be NULL."""
    if kind in ("first", "last"):
        return (F.min_by if kind == "first" else F.max_by)(F.struct(c), "date")[c]
    return STATS[kind](c)


def names(spec: Mapping[str, Mapping]) -> list[str]:
    """Column names that a spec leads to."""
    out = []
    for c, s in spec.items():
        out += [f"{c}_{a}" for a in s.get("aggregations", ())]
        r = s.get("rolling")
        for i in range(1, (r or {}).get("lookbacks", 0) + 1):
            out += [f"{c}_{a}_{r['duration']}d_period_{i}" for a in [*r.get("aggregations", ()), *r.get("comparisons", ())]]
    return out


def flatten(df: DataFrame, spec: Mapping[str, Mapping], keys: Sequence[str] = ("coin_id",)) -> DataFrame:
    """One row per key by a single aggregation.

    spec: {column: {"aggregations": [...], "rolling": {"duration": d, "lookbacks": n, "aggregations": [...],
    "comparisons": ["change", "pct_change"]}}}. Rolling periods are blocks of d rows counted back from the end, 1 the
    newest; one that isn't complete is NULL.
    """
    if not [c for c in spec if c in df.columns]:
        raise ValueError("no column of the spec is there")
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("date"))))
    out = []
    for c, s in spec.items():
        if c not in df.columns:
            continue
        out += [aggregation(c, a).alias(f"{c}_{a}") for a in s.get("aggregations", ())]
        if r := s.get("rolling"):
            for i in range(1, r["lookbacks"] + 1):
                inside = (F.col("_n") > (i - 1) * r["duration"]) & (F.col("_n") <= i * r["duration"])
                whole = F.count_if(inside) == r["duration"]
                v = F.when(inside, F.col(c))
                first, last = F.min_by(v, F.when(inside, F.col("date"))), F.max_by(v, F.when(inside, F.col("date")))
                for a in r.get("aggregations", ()):
                    x = {"first": first, "last": last}.get(a)
                    out.append(F.when(whole, STATS[a](v) if x is None else x).alias(f"{c}_{a}_{r['duration']}d_period_{i}"))
                for a in r.get("comparisons", ()):
                    x = last - first if a == "change" else expr.pct_change(first, last)
                    out.append(F.when(whole, x).alias(f"{c}_{a}_{r['duration']}d_period_{i}"))
    return rows.groupBy(*keys).agg(*out)


def checked(df: DataFrame, end: str | None = None, keys: Sequence[str] = ("coin_id",)) -> DataFrame:
    """``df`` if each key has one row for every day from its first to ``end``, or to the last day of all; a doubled or missing
    day is an error that names the key."""
    last = F.lit(end).cast("date") if end else F.lit(df.agg(F.max("date")).first()[0])
    g = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))
    bad = g.where((F.col("rows") != F.col("days")) | (F.col("last") != last) | (F.col("days") != F.datediff(last, "first") + 1))
    if found := bad.orderBy(*keys).limit(3).collect():
        raise ValueError(f"days missing or doubled: {[tuple(r) for r in found]}")
    return df


def window_dataset(sets: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str] = ("time_window", "coin_id")) -> tuple[DataFrame, DataFrame]:
    """(data set, join log): the feature sets of all time windows aligned by policy, as in ``join_by_policy``, each column
    under its set's name as name|column; and for each set its policy, its rows, the distinct keys it has of those of the
    data set, rows of the data set before it was joined and after, all counted in one pass over the marks that the joins
    leave. A set with a doubled key would multiply rows and is an error."""
    full = [d.select(*keys) for d, p in sets.values() if p not in ("extend_coin_ids", "extend_time_windows")]
    if not full:
        raise ValueError("no set has windows and assets both")
    out = reduce(DataFrame.union, full).distinct()
    alive, log = F.lit(True), []
    for name, (d, policy) in sets.items():
        if policy not in ("retain_nulls", "fill_zeros", "drop_records", "extend_coin_ids", "extend_time_windows"):
            raise ValueError(f"no such policy: {policy}")
        on = {"extend_coin_ids": ["time_window"], "extend_time_windows": ["coin_id"]}.get(policy, list(keys))
        if d.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"a key of {name} is there twice")
        named = d.toDF(*[c if c in on else f"{name}|{c}" for c in d.columns]).withColumn(f"_{name}", F.lit(True))
        out = out.join(named, on, "left")
        if policy == "fill_zeros":
            out = out.na.fill(0, [f"{name}|{c}" for c in d.columns if c not in on])
        there = F.col(f"`_{name}`").isNotNull()
        before, alive = alive, alive & there if policy == "drop_records" else alive
        log.append((name, policy, F.count_if(there), F.count_if(before), F.count_if(alive)))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.lit(p).alias("policy"), F.element_at("_c", 3 * i + 1).alias("matched"), F.element_at("_c", 3 * i + 2).alias("rows_before"), F.element_at("_c", 3 * i + 3).alias("rows_after")) for i, (n, p, *_) in enumerate(log)])).alias("x")
    counts = out.agg(F.array(*[c for _, _, *cs in log for c in cs]).alias("_c")).select(steps).select("x.*")
    return out.where(alive).drop(*[f"_{n}" for n in sets]), counts


def join_by_policy(sets: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str] = ("time_window", "coin_id")) -> DataFrame:
    """All data sets on the distinct keys of the full ones. Policies: retain_nulls, fill_zeros, drop_records, extend_coin_ids
    (a set without assets, for all of a window's), extend_time_windows (a set without windows, for all of an asset's)."""
    full = [d for d, p in sets.values() if p not in ("extend_coin_ids", "extend_time_windows")]
    base = full[0].select(*keys)
    for d in full[1:]:
        base = base.union(d.select(*keys))
    out = base.distinct()
    for d, p in sets.values():
        on = {"extend_coin_ids": ["time_window"], "extend_time_windows": ["coin_id"]}.get(p, list(keys))
        out = out.join(d, on, "inner" if p == "drop_records" else "left")
        if p == "fill_zeros":
            out = out.na.fill(0, [c for c in d.columns if c not in keys])
    return out


def join_log(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    return before.agg(F.lit(name).alias("step"), F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after")))


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str], metrics: Sequence[str] = ()) -> DataFrame:
    """Feature columns as prefix|name; the first _ behind a known metric becomes /."""
    def name(c: str) -> str:
        m = max((m for m in metrics if c.startswith(f"{m}_")), key=len, default=None)
        return f"{prefix}|{m}/{c[len(m) + 1 :]}" if m else f"{prefix}|{c}"

    return df.toDF(*[c if c in keys else name(c) for c in df.columns])


def in_windows(df: DataFrame, starts: Sequence[str], days: int) -> DataFrame:
    """Rows of the ``days`` days before each modeling start, with it as time_window; one range join for all windows."""
    t = df.sparkSession.createDataFrame([(s,) for s in starts], "s string").select(F.to_date("s").alias("time_window"))
    return df.join(F.broadcast(t), F.col("date").between(F.date_sub("time_window", days), F.date_sub("time_window", 1)))


def without_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns of a date-only series, but those with any NULL."""
    n = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return df.select("date", *[c for c in columns if not n[c]])

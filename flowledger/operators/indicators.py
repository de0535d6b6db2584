"""Indicators over a series per key, ordered by date. All windows of a key share one sort."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowledger.functions.order import recurrence


def over(key: str = "coin_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy("date")


def _rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def sma(c: str, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(c).over(_rows(w, n)) == n, F.avg(c).over(_rows(w, n)))


def emas(df: DataFrame, spec: Mapping[str, tuple[str, int]], key: str = "coin_id") -> DataFrame:
    """``df`` with recursive averages, {new column: (column, n)}: weight 2 / (n + 1), NULL for a key's first n - 1 rows and
    before its first value. A missing value leaves the average as it is."""
    w, steps, shown = over(key), {}, {}
    for out, (c, n) in spec.items():
        a, x = 2.0 / (n + 1), F.col(c).cast("double")
        first = F.coalesce(F.first(x, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
        add = F.when(F.row_number().over(w) == 1, first).when(x.isNull(), 0.0).otherwise(x * a)
        steps[out] = (F.when(x.isNull(), 1.0).otherwise(1 - a), add)
        shown[out] = F.when((F.row_number().over(w) >= n) & (F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0), F.col(out))
    return recurrence(df, [key], "date", steps).withColumns(shown)


def ema_table(df: DataFrame, c: str, n: int, out: str, key: str = "coin_id") -> DataFrame:
    return emas(df, {out: (c, n)}, key)


def rsi(c: str, n: int, w: WindowSpec) -> Column:
    """0 to 1; the first change counts as 0, no losses give 1."""
    d = F.col(f"_d_{c}")
    gain, loss = F.avg(F.greatest(d, F.lit(0.0))).over(_rows(w, n)), F.avg(F.greatest(-d, F.lit(0.0))).over(_rows(w, n))
    return F.when(F.count(d).over(_rows(w, n)) == n, F.when(loss == 0, 1.0).otherwise(1 - F.try_divide(F.lit(1.0), 1 + F.try_divide(gain, loss))))


def bollinger(c: str, n: int, k: float, band: str, w: WindowSpec) -> Column:
    if band not in ("upper", "lower"):
        raise ValueError(f"no such band: {band}")
    sign = 1 if band == "upper" else -1
    return F.when(F.count(c).over(_rows(w, n)) == n, F.avg(c).over(_rows(w, n)) + sign * k * F.stddev_pop(c).over(_rows(w, n)))


def with_change(df: DataFrame, c: str, w: WindowSpec) -> DataFrame:
    return df.withColumn(f"_d_{c}", F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))


def mfi(df: DataFrame, price: str, volume: str, n: int, out: str, key: str = "coin_id") -> DataFrame:
    """Money flow index, 100 - 100 / (1 + rolling inflow / outflow): 100 without outflow, carried over 0/0, at first 0.5."""
    w = over(key)
    flow = F.col(price) * F.col(volume)
    d = F.col(price) - F.lag(price).over(w)
    rows = df.withColumn("_p", F.when(d > 0, flow).otherwise(0.0)).withColumn("_n", F.when(d < 0, flow).otherwise(0.0))
    pos, neg = F.sum("_p").over(_rows(w, n)), F.sum("_n").over(_rows(w, n))
    raw = F.when(F.row_number().over(w) >= n, F.when((neg == 0) & (pos > 0), 100.0).otherwise(100 - 100 / (1 + F.try_divide(pos, neg))))
    rows = rows.withColumn("_m", raw)
    return rows.withColumn(out, F.coalesce(F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.5))).drop("_p", "_n", "_m")


def obv(df: DataFrame, primary: str, secondary: str, out: str, key: str = "coin_id") -> DataFrame:
    """Running sum of the secondary with the sign of the primary's change."""
    w = over(key)
    step = F.coalesce(F.signum(F.col(primary) - F.lag(primary).over(w)), F.lit(0.0)) * F.col(secondary)
    return df.withColumn("_s", step).withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def rebase(df: DataFrame, column: str, opening, key: str = "coin_id") -> DataFrame:
    """The column less its value on each key's first row from ``opening`` on."""
    later = F.when(F.col("date") >= F.lit(str(opening)).cast("date"), F.struct("date", column))
    return df.withColumn("_b", F.min(later).over(Window.partitionBy(key))[column]).withColumn(column, F.col(column) - F.col("_b")).drop("_b")


def crossover(a: str, b: str, w: WindowSpec) -> Column:
    """1 where a rises through b, -1 where it falls through, else 0."""
    now, before = F.col(a) - F.col(b), F.lag(F.col(a) - F.col(b)).over(w)
    return F.when((before <= 0) & (now > 0), 1).when((before >= 0) & (now < 0), -1).otherwise(0)


def generate(df: DataFrame, spec: Mapping[str, Mapping[str, Mapping]], key: str = "coin_id") -> DataFrame:
    """Indicators of a spec {column: {"sma" | "ema" | "rsi" | "bollinger_upper" | "bollinger_lower": {"window": [n...], "num_std": k}}},
    named column_indicator_n."""
    missing = [c for c in (*spec, key, "date") if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    w = over(key)
    for c, kinds in spec.items():
        if "rsi" in kinds:
            df = with_change(df, c, w)
    averages = {f"{c}_ema_{n}": (c, n) for c, kinds in spec.items() for n in kinds.get("ema", {}).get("window", [])}
    df = emas(df, averages, key) if averages else df
    new = {}
    for c, kinds in spec.items():
        for kind, args in kinds.items():
            for n in args["window"]:
                name = f"{c}_{kind}_{n}"
                if kind.startswith("bollinger_"):
                    new[name] = bollinger(c, n, args.get("num_std", 2), kind.removeprefix("bollinger_"), w)
                elif kind != "ema":
                    new[name] = {"sma": sma, "rsi": rsi}[kind](c, n, w)
    return df.withColumns(new).drop(*[f"_d_{c}" for c in spec])

"""Exact order statistics, ranks and running sums over a whole table, without one task that sees all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import partial
from weakref import WeakSet

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values into which ``located`` cuts a column: so many at least, one for so many rows, so many at most.
RANGES, ROWS, MOST = 64, 1_000_000, 1 << 17
#: A value that one in so many rows has is joined by broadcast, as there can be no more of them.
FREQUENT = 1000
#: Rows among which an order statistic is looked up at last, and the accuracy of the estimates that lead there.
FEW, ACCURACY = 10_000, 1000


def _nearest(n: int, q: float) -> int:
    """Index of the nearest rank, ties to even."""
    return round((n - 1) * q)


def at_ranks(df: DataFrame, ranks: Mapping[str, Sequence[int]], counts: Mapping[str, int]) -> dict[str, list]:
    """The exact values of columns at ranks from 0; ``counts`` are the columns' numbers of non-null values.

    Each rank is narrowed to a range of values: an estimate gives a narrower range, a count tells whether the rank is in
    it, until the range holds FEW rows or can't be narrowed. Then the range's distinct values, with their numbers, are
    read. All columns and ranks go together, so the jobs grow with the logarithm of the rows.
    """
    state = {(c, k): (None, None, 0, counts[c]) for c, ks in ranks.items() for k in ks}  # lowest, highest, rows below, rows in

    def inside(c: str, low, high) -> Column:
        x = F.col(f"`{c}`")
        return x.isNotNull() if low is None else x.between(low, high)

    open_ = {s for s, (_, _, _, n) in state.items() if n > FEW}
    while open_:
        order = sorted(open_)
        p = {s: (s[1] - state[s][2] + 0.5) / state[s][3] for s in order}
        near = [F.array(F.lit(max(0.0, p[s] - 2 / ACCURACY)), F.lit(min(1.0, p[s] + 2 / ACCURACY))) for s in order]
        ends = df.agg(*[F.percentile_approx(F.when(inside(s[0], *state[s][:2]), F.col(f"`{s[0]}`")), q, ACCURACY).alias(f"e{i}") for i, (s, q) in enumerate(zip(order, near, strict=True))]).first()
        asks = []
        for i, s in enumerate(order):
            x = F.col(f"`{s[0]}`")
            asks += [F.count_if(inside(s[0], *state[s][:2]) & (x < ends[i][0])).alias(f"b{i}"), F.count_if(x.between(*ends[i])).alias(f"n{i}")]
        got = df.agg(*asks).first()
        for i, s in enumerate(order):
            low, high, below, n = state[s]
            b, m = got[2 * i], got[2 * i + 1]
            if b <= s[1] - below < b + m and m < n:
                state[s] = (ends[i][0], ends[i][1], below + b, m)
            else:
                open_.discard(s)  # the estimate is no help: few values hold most rows
            if state[s][0] == state[s][1] is not None or state[s][3] <= FEW:
                open_.discard(s)
    order = sorted(state)
    if not order:
        return {}
    found = F.array(*[F.when(inside(s[0], *state[s][:2]), F.struct(F.lit(i).alias("i"), F.col(f"`{s[0]}`").cast("double").alias("v"))) for i, s in enumerate(order)])
    rows = df.select(F.explode(found).alias("x")).where("x is not null").select("x.*").groupBy("i", "v").count().orderBy("i", "v").collect()
    out: dict = {}
    run = {i: state[s][2] for i, s in enumerate(order)}
    for r in rows:
        c, k = order[r["i"]]
        run[r["i"]] += r["count"]
        if run[r["i"]] > k:
            out.setdefault((c, k), r["v"])
    return {c: [out[c, k] for k in ks] for c, ks in ranks.items()}


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list]:
    """Exact quantiles of each column, interpolated between neighbouring ranks; no entry for a column without a value."""
    own = settled(df.select(*[F.col(f"`{c}`") for c in columns]))
    n = own.agg(*[F.count(f"`{c}`").alias(c) for c in columns]).first()
    at = {c: [(n[c] - 1) * q for q in probabilities] for c in columns if n[c]}
    values = at_ranks(own, {c: sorted({k for x in xs for k in (int(x), min(int(x) + 1, n[c] - 1))}) for c, xs in at.items()}, {c: n[c] for c in at})
    free(own)
    out = {}
    for c, xs in at.items():
        known = dict(zip(sorted({k for x in xs for k in (int(x), min(int(x) + 1, n[c] - 1))}), values[c], strict=True))
        out[c] = [known[int(x)] + (x - int(x)) * (known[min(int(x) + 1, n[c] - 1)] - known[int(x)]) for x in xs]
    return out


def winsorize(df: DataFrame, columns: Sequence[str], cutoff: float, suffix: str = "") -> DataFrame:
    """Clip each column to its values at the nearest ranks of ``cutoff`` and 1 - ``cutoff``; NULL stays NULL. All columns
    go together: counts first, then the exact values at those ranks."""
    df = settled(df)
    n = df.agg(*[F.count(f"`{c}`").alias(c) for c in columns]).first()
    ranks = {c: [_nearest(n[c], cutoff), _nearest(n[c], 1 - cutoff)] for c in columns if n[c]}
    ends = at_ranks(df, {c: sorted(set(ks)) for c, ks in ranks.items()}, {c: n[c] for c in ranks})
    new = {}
    for c in columns:
        x = F.col(f"`{c}`")
        new[c + suffix] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(ends[c][0])), F.lit(ends[c][-1]))) if c in ends else x
    return df.withColumns(new)


def winsorize_by(df: DataFrame, column: str, cutoff: float, keys: Sequence[str], out: str) -> DataFrame:
    """The same inside each group: groups are of the size of one period's assets."""
    w = Window.partitionBy(*keys)
    order = F.row_number().over(w.orderBy(F.col(column).asc_nulls_last())) - 1
    n = F.count(column).over(w)
    low, high = (F.max(F.when(F.col("_k") == F.bround((n - 1) * F.lit(q)).cast("long"), F.col(column))).over(w) for q in (cutoff, 1 - cutoff))
    clipped = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), low), high))
    return df.withColumn("_k", order).withColumn(out, clipped).drop("_k")


def located(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` with the number of the range of values that each column's value falls into, under a new name; -1 for NULL.

    Ranges are cut at approximate quantiles, so that each holds about one in ``ranges`` rows, equal values aside; they
    follow the order of values, and equal values share one. The cuts go to the tasks as one array, in which each value is
    looked up by bisection. Two passes over ``df``, which should be settled."""
    ranges = min(MOST, max(RANGES, df.count() // ROWS))
    values = {f"_v{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for i, c in enumerate(columns)}
    own = df.withColumns(values)
    cuts = own.approxQuantile(list(values), [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    splits = [[-math.inf, *(sorted({x for x in xs if math.isfinite(x)}) or [0.0]), math.inf] for xs in cuts]
    found = Bucketizer(splitsArray=splits, inputCols=list(values), outputCols=[f"_b{i}" for i in range(len(values))], handleInvalid="keep").transform(own)
    numbers = [F.when(F.isnan(f"_v{i}"), -1).otherwise(F.col(f"_b{i}").cast("int")).alias(out) for i, out in enumerate(columns.values())]
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns.values()], *numbers)


def _dealt(df: DataFrame, order: Sequence[Column], part: str) -> DataFrame:
    """``df`` settled in ranges of ``order``, with their numbers: an exchange by ranges, in which rows of one value may
    spread over several as long as ``order`` tells them apart."""
    return settled(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))


def _earlier(totals: DataFrame, sums: Mapping[str, str], part: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over the ranges before each range, under new names; a row for each range."""
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, part, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(out) for c, out in sums.items()])


def numbered(df: DataFrame, order: Sequence[Column | str], number: str) -> DataFrame:
    """``df`` with each row's place from 1 in ``order``, which should leave no ties. Rows are dealt in ranges of the order;
    a place is the rows of the ranges before and those before it in its own."""
    by = [F.asc(c) if isinstance(c, str) else c for c in order]
    own = _dealt(df, by, "_p")
    base = _earlier(own.groupBy("_p").agg(F.count("*").alias("_n")), {"_n": "_before"}, "_p")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*by))
    return own.join(F.broadcast(base), "_p").withColumn(number, place).drop("_p", "_before")  # a row for each partition


def highest(df: DataFrame, column: str, n: int, ties: Sequence[str], largest: bool = True) -> DataFrame:
    """The ``n`` rows with the largest (or smallest) values of a numeric column, ties by ``ties``; NULL is never taken.

    The value of the last row is found by its rank. Rows beyond it are filtered where they are, and only rows with just
    that value are put in order."""
    own = settled(df)
    c = F.col(f"`{column}`")
    known = own.agg(F.count(f"`{column}`")).first()[0]
    if n <= 0 or not known:
        return own.where("false")
    if n >= known:
        return own.where(c.isNotNull())
    edge = F.lit(at_ranks(own, {column: [known - n if largest else n - 1]}, {column: known})[column][0])
    beyond = own.where(c > edge if largest else c < edge)
    tied = numbered(own.where(c == edge), ties, "_k")
    return beyond.unionByName(tied.where(F.col("_k") <= n - beyond.count()).drop("_k"))


def group_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """The keys, and for each column an array of its exact quantiles within the group, interpolated between neighbouring
    ranks; NULL for a group without a value. A group may be the whole table.

    Values are located in ranges over all groups, so no group has more than a range's share of the rows in one range, and
    counted by (group, range). Running counts say which range holds the ranks asked for; only the distinct values of those
    ranges are put in order. All groups and columns go together, in a fixed number of passes.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_x")
    long = settled(df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], each).select(*names, "_x.*"))
    values = located(long, {"_v": "_p"}).where("_p >= 0").groupBy(*names, "_i", "_p", "_v").agg(F.count("*").alias("_n"))
    group, cell = [*names, "_i"], [*names, "_i", "_p"]
    w = Window.partitionBy(*group)
    cells = values.groupBy(*cell).agg(F.sum("_n").alias("_c")).withColumns({
        "_t": F.sum("_c").over(w), "_before": F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    place = [(F.col("_t") - 1) * F.lit(float(q)) for q in probabilities]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    asked = cells.withColumn("_k", F.filter(ranks, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_c")))).where(F.size("_k") > 0)
    asked = asked.select(*[F.col(c).alias(f"{c}_") for c in cell], "_t", "_before", "_k")
    met = values.join(asked, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in cell]).drop(*[f"{c}_" for c in cell])
    to = F.col("_before") + F.sum("_n").over(Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = met.withColumn("_to", to).select(*group, "_t", "_v", F.explode(F.filter("_k", lambda k: (k < F.col("_to")) & (k >= F.col("_to") - F.col("_n")))).alias("_k"))
    got = hit.groupBy(*group, "_t").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))  # two ranks a quantile at most

    def between(x: Column) -> Column:
        low, high = F.floor(x), F.ceil(x)
        a, b = F.col("_m")[low.cast("long")], F.col("_m")[high.cast("long")]
        return F.when(low == high, a).otherwise((high - x) * a + (x - low) * b)

    found = got.select(*group, F.array(*map(between, place)).alias("_q"))
    spread = found.groupBy(*names).agg(*[F.first(F.when(F.col("_i") == i, F.col("_q")), True).alias(c) for i, c in enumerate(columns)])
    return spread.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *[F.col(f"`{c}`") for c in columns])


def with_quantiles(groups: DataFrame, df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], probabilities: Sequence[float]) -> DataFrame:
    """``groups``, a row for each group of ``df``, with the group's exact quantiles under new names: a number for one
    probability, else an array. ``columns``: new name by column."""
    q = group_quantiles(df, keys, list(columns), probabilities)
    q = q.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[(F.col(f"`{c}`")[0] if len(probabilities) == 1 else F.col(f"`{c}`")).alias(out) for c, out in columns.items()])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return groups.join(q, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, column: str, ties: Sequence[str], sums: Mapping[str, str | Column], number: str, descending: bool = True) -> DataFrame:
    """``df`` in the order of ``column``, then ``ties``: ``number`` from 1, and running sums of columns under new names.

    Rows are dealt in ranges of that order; a sum is that of the ranges before plus the one inside the row's own range,
    which is one window for each range. Rows of one value may lie in several ranges. NULL has no place.
    """
    c = F.col(f"`{column}`")
    by = [F.desc(f"`{column}`") if descending else F.asc(f"`{column}`"), *map(F.asc, ties)]
    own = _dealt(df.where(c.isNotNull()).withColumns({f"_s{i}": F.col(x) if isinstance(x, str) else x for i, x in enumerate(sums.values())}), by, "_p")
    totals = own.groupBy("_p").agg(F.count("*").alias("_n"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))])
    base = _earlier(totals, {"_n": "_b"} | {f"_s{i}": f"_b{i}" for i in range(len(sums))}, "_p")
    w = Window.partitionBy("_p").orderBy(*by)
    new = {number: F.col("_b") + F.row_number().over(w)}
    new |= {out: F.col(f"_b{i}") + F.coalesce(F.sum(f"_s{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for i, out in enumerate(sums)}
    return own.join(F.broadcast(base), "_p").withColumns(new).drop("_p", "_b", *[f"_{x}{i}" for x in "sb" for i in range(len(sums))])  # a row for each partition


def running_in(df: DataFrame, keys: Sequence[str], column: str, sums: Mapping[str, str]) -> DataFrame:
    """``df`` with running sums of columns, ascending by ``column`` within each group, under new names. A group may be the
    whole table: rows are dealt in ranges of (keys, column), and each range adds the group's sums of the ranges before."""
    own = _dealt(df, [F.asc(f"`{c}`") for c in (*keys, column)], "_p")
    totals = own.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    base = _earlier(totals, {f"_s{i}": f"_b{i}" for i in range(len(sums))}, "_p", keys)
    base = base.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_p").alias("_p_"), *[f"_b{i}" for i in range(len(sums))])
    w = Window.partitionBy(*keys, "_p").orderBy(f"`{column}`").rowsBetween(Window.unboundedPreceding, 0)
    both = own.join(base, [F.col("_p") == F.col("_p_"), *[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]])
    return both.withColumns({out: F.col(f"_b{i}") + F.sum(c).over(w) for i, (c, out) in enumerate(sums.items())}).drop("_p", "_p_", *[f"_b{i}" for i in range(len(sums))], *[f"{k}_" for k in keys])


def pct_ranks(df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
    """For each column the average-tie rank over the number of non-null values, under a new name; NULL stays NULL.

    The distinct values of all columns are counted together, dealt in ranges of (column, value) and ranked by running
    counts. Each value of a row takes its rank by one join for all columns: frequent values, of which there are few, by
    broadcast, the others by an equi-join, so no value that many rows share is one task's burden. NULLs take no part.
    """
    columns = list(outs)
    own = settled(df.withColumn("_id", F.monotonically_increasing_id()))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_x")
    long = own.select("_id", each).select("_id", "_x.*").where("_v is not null")
    counted = long.groupBy("_i", "_v").agg(F.count("*").alias("_n"))
    values = _dealt(counted, [F.asc("_i"), F.asc("_v")], "_p")
    base = _earlier(values.groupBy("_i", "_p").agg(F.sum("_n").alias("_n")), {"_n": "_b"}, "_p", ["_i"])
    all_ = values.groupBy("_i").agg(F.sum("_n").alias("_t"))  # a row for each column
    up = F.sum("_n").over(Window.partitionBy("_i", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.join(F.broadcast(base), ["_i", "_p"]).join(F.broadcast(all_), "_i")
    ranked = settled(ranked.select("_i", "_v", ((F.col("_b") + up - (F.col("_n") - 1) / 2) / F.col("_t")).alias("_r"), (F.col("_n") * FREQUENT >= F.col("_t")).alias("_f")))
    frequent = ranked.where("_f").select("_i", "_v", F.col("_r").alias("_rf"))  # FREQUENT rows a column at most
    split = long.join(F.broadcast(frequent), ["_i", "_v"], "left")
    rest = split.where("_rf is null").drop("_rf").join(ranked.where("not _f").drop("_f"), ["_i", "_v"])
    told = split.where("_rf is not null").withColumnRenamed("_rf", "_r").unionByName(rest)
    wide = told.groupBy("_id").agg(*[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(f"_r{i}") for i in range(len(columns))])
    rest_ = [F.col(f"`{x}`") for x in df.columns if x not in outs.values()]
    return own.join(wide, "_id", "left").select(*rest_, *[F.col(f"_r{i}").alias(out) for i, out in enumerate(outs.values())])


def pct_rank(df: DataFrame, column: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average-tie rank over the number of non-null values; NULL stays NULL. With keys, a window per group."""
    if not keys:
        return pct_ranks(df, {column: out})
    w = Window.partitionBy(*keys)
    c, ties = F.col(column), F.count(column).over(Window.partitionBy(*keys, column))
    rank = F.rank().over(w.orderBy(c.asc_nulls_last())) + (ties - 1) / 2
    return df.withColumn(out, F.when(c.isNotNull(), rank / F.count(column).over(w)))


_settled: WeakSet[DataFrame] = WeakSet()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once for several passes: written to the checkpoint folder where the session names one, else kept in
    memory and on disk, from where Spark computes lost parts anew. What is settled already stays as it is; ``free`` lets
    go of it."""
    if df in _settled:
        return df
    out = df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()
    _settled.add(out)
    return out


def free(*dfs: DataFrame) -> None:
    """Let go of settled tables, of all that are known if none is named; results made from them must have been read."""
    for df in dfs or list(_settled):
        df.unpersist()
        _settled.discard(df)


def _fold(keys: list[str], steps: list[tuple[str, str, str]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, held = None, [0.0] * len(steps)
    for pdf in batches:
        if pdf.empty:
            continue
        names = list(zip(*[pdf[k] for k in keys], strict=True))
        for i, (out, keep, add) in enumerate(steps):
            now, x, values = key, held[i], []
            for k, a, b in zip(names, pdf[keep].tolist(), pdf[add].tolist(), strict=True):
                x = b if k != now else x * a + b
                now = k
                values.append(x)
            held[i] = x
            pdf[out] = values
        key = names[-1]
        yield pdf.drop(columns=[c for _, keep, add in steps for c in (keep, add)])


def recurrence(df: DataFrame, keys: Sequence[str], order: str, steps: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Columns x with x = x before x ``keep`` + ``add`` along ``order`` within each key, the first x being its ``add``.

    Rows are dealt by key and sorted, and pass in batches with one number held for each column: linear in the rows, and
    no key's rows are ever held together. Neither column may be NULL.
    """
    names = {out: (f"_keep{i}", f"_add{i}") for i, out in enumerate(steps)}
    rows = df.withColumns({n: c.cast("double") for out, both in steps.items() for n, c in zip(names[out], both, strict=True)})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` double" for out in steps])
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(partial(_fold, list(keys), [(out, *names[out]) for out in steps]), schema)

"""Wallet feature families over a ledger with opening and closing rows. ``keys`` may add columns, such as a window or epoch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions import expr
from flowledger.functions.order import pct_ranks, recurrence, settled, winsorize

PAIR = ["coin_id", "wallet_address"]
TRADING = ["crypto_inflows", "crypto_outflows", "net_crypto_flows", "net_gain", "max_investment"]


def day(d):
    return F.lit(str(d)).cast("date")


# trading


def boundary_flows(df: DataFrame, start, end) -> DataFrame:
    """balance_change: transfers, with the opening balance as a buy and the closing balance as a sale; usd_balance is then 0."""
    opening, closing = F.col("date") == F.date_sub(day(start), 1), F.col("date") == day(end)
    change = F.when(opening, F.col("usd_balance")).when(closing, F.col("usd_net_transfers") - F.col("usd_balance")).otherwise(F.col("usd_net_transfers"))
    return df.withColumns({"balance_change": change, "usd_balance": F.when(closing, 0.0).otherwise(F.col("usd_balance"))})


def cumulative(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running flows of each pair and its net gain: balance less what was put in."""
    w = Window.partitionBy(*keys, *PAIR).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    put = F.sum("balance_change").over(w)
    return df.withColumns({"flows_cumulative": put, "net_gain_cumulative": F.col("usd_balance") - put})


def gain_and_investment(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per wallet: flows, gain as the sum of each asset's last one, and the largest sum put into one asset, 0 at least."""
    by = [*keys, "wallet_address"]
    pair = df.groupBy(*by, "coin_id").agg(F.max_by("net_gain_cumulative", "date").alias("g"), F.max("flows_cumulative").alias("m"), expr.sum0(expr.positive("balance_change")).alias("i"), expr.sum0(expr.negative("balance_change")).alias("o"))
    return pair.groupBy(*by).agg(F.sum("i").alias("crypto_inflows"), F.sum("o").alias("crypto_outflows"), (F.sum("i") - F.sum("o")).alias("net_crypto_flows"), F.sum("g").alias("net_gain"), F.greatest(F.max("m"), F.lit(0.0)).alias("max_investment"))


def observed_activity(flows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per wallet, over rows that aren't imputed: volume by transfers; buys, sales and net flow by balance changes, in which
    an opening balance is a buy and a closing one a sale."""
    t, c = F.col("usd_net_transfers"), F.col("balance_change")
    return flows.where("not is_imputed").groupBy(*keys, "wallet_address").agg(
        F.sum(F.abs(t)).alias("total_volume"), F.avg(F.abs(t)).alias("average_transaction"), F.sum(expr.positive(c)).alias("cash_buys"), F.sum(expr.negative(c)).alias("cash_sells"),
        F.sum(c).alias("net_cash_flow"), F.countDistinct("coin_id").alias("unique_coins_traded"), F.count_if(t != 0).alias("transaction_days"),
    )


def trading(ledger: DataFrame, start, end, keys: Sequence[str] = (), returns: bool = False, balances: bool = False) -> DataFrame:
    """All trading features of a period, a row for each wallet of the ledger, NULL as 0; with statistics of time-weighted
    returns, and time-weighted balances and the volume against them, on demand. All see the closing balance as sold."""
    flows = cumulative(boundary_flows(ledger, start, end), keys)
    both = gain_and_investment(flows, keys).join(observed_activity(flows, keys), [*keys, "wallet_address"], "left")
    if returns:
        both = both.join(return_stats(time_weighted_returns(flows, keys=keys), keys=keys), [*keys, "wallet_address"], "left")
    if balances:
        both = both.join(time_weighted_balance(flows, keys=keys), [*keys, "wallet_address"], "left")
        both = both.withColumn("volume_vs_twb_ratio", F.when(F.col("time_weighted_balance") > 0, F.try_divide("total_volume", "time_weighted_balance")))
    return both.na.fill(0, [c for c in both.columns if c not in (*keys, "wallet_address")])


def cost_basis(flows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``flows`` with the running cost basis of each pair: balance changes above 0 add, a sale takes the share that it sells
    of the balance before it; a sale of more than there is, or from nothing, takes all."""
    t, b = F.col("usd_net_transfers"), F.col("usd_balance")
    sold = F.when(t < 0, F.least(F.greatest(F.coalesce(F.try_divide(-t, b - t), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return recurrence(flows, [*keys, *PAIR], "date", {"cost_basis": (1 - sold, expr.positive("balance_change"))})


def time_weighted_balance(flows: DataFrame, materiality: float = 20.0, keys: Sequence[str] = ()) -> DataFrame:
    """Per wallet: the cost basis weighted by the days until the pair's next row, in total and while it is material, summed
    over assets. The last row of a pair has no days."""
    by = [*keys, *PAIR]
    days = F.coalesce(F.datediff(F.lead("date").over(Window.partitionBy(*by).orderBy("date")), "date"), F.lit(0)).cast("double")
    c = F.col("cost_basis")
    rows = cost_basis(flows, keys).withColumn("_d", days).withColumn("_a", F.when(c > materiality, F.col("_d")).otherwise(0.0))
    pair = rows.groupBy(*by).agg((F.sum(c * F.col("_d")) / (F.sum("_d") + 1e-10)).alias("twb"), F.coalesce(F.try_divide(F.sum(c * F.col("_a")), F.sum("_a")), F.lit(0.0)).alias("active"))
    return pair.groupBy(*keys, "wallet_address").agg(F.sum("twb").alias("time_weighted_balance"), F.sum("active").alias("active_time_weighted_balance"))


def time_weighted_returns(df: DataFrame, materiality: float = 20.0, cap: float = 10.0, cutoff: float = 0.01, keys: Sequence[str] = ()) -> DataFrame:
    """Per pair: time-weighted return, days held and the capped annual return, both returns winsorized. Without days, or
    where a negative return has no such power, there is none (NULL)."""
    rows = df.where((F.col("usd_balance") >= materiality) | (F.abs("usd_net_transfers") >= materiality))
    w = Window.partitionBy(*keys, *PAIR).orderBy("date")
    r = F.coalesce(F.try_divide(F.col("usd_balance") - F.col("usd_net_transfers"), F.lag("usd_balance").over(w)), F.lit(1.0))
    d = F.coalesce(F.datediff("date", F.lag("date").over(w)), F.lit(0)).cast("double")
    pair = rows.withColumn("_r", r).withColumn("_d", d).groupBy(*keys, *PAIR).agg(F.sum((F.col("_r") - 1) * F.col("_d")).alias("s"), F.sum("_d").alias("days_held"))
    pair = pair.withColumn("time_weighted_return", F.try_divide("s", "days_held")).drop("s")
    yearly = F.pow(1 + F.col("time_weighted_return"), F.try_divide(F.lit(365.0), "days_held")) - 1
    pair = pair.withColumn("annual_twr", F.when(~F.isnan(yearly), F.least(yearly, F.lit(cap))))
    return winsorize(pair, ["time_weighted_return", "annual_twr"], cutoff) if cutoff else pair


def return_stats(pairs: DataFrame, columns: Sequence[str] = ("time_weighted_return", "annual_twr", "days_held"), keys: Sequence[str] = ()) -> DataFrame:
    stats = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp}
    return pairs.groupBy(*keys, "wallet_address").agg(*[f(c).alias(f"{c}/{s}") for c in columns for s, f in stats.items()])


# performance

PROFITS = {"net_gain": "net_gain"}
BASES = ("max_investment", "crypto_inflows", "total_volume")


def performance(wallets: DataFrame, profits: Sequence[str] = ("net_gain",), bases: Sequence[str] = BASES, cutoff: float = 0.01) -> DataFrame:
    """Ratios profit/base as they are, winsorized, and as a percent rank over all wallets. Ratios are rounded to nine digits,
    so that ties don't hang on the order in which sums were made."""
    names = [f"{p}/{b}" for p in profits for b in bases]
    rows = wallets.select("wallet_address", *[F.round(expr.ratio(p, b), 9).alias(f"{p}/{b}/base") for p in profits for b in bases])
    rows = settled(rows.withColumns({f"{n}/winsorized": F.col(f"`{n}/base`") for n in names}))
    return pct_ranks(winsorize(rows, [f"{n}/winsorized" for n in names], cutoff), {f"{n}/base": f"{n}/rank" for n in names})


# transfers


def transfer_sequence(ledger: DataFrame, end, minimum: float) -> DataFrame:
    """Per pair with a transfer of ``minimum``: first buy, first sale (if it comes after the first buy), counts, its rank
    among the asset's first buyers and first sellers, and the ages of asset and wallet: days from their first buy to ``end``.

    Ranks go by day: buyers are counted by asset and day, and a running sum over the days is joined back, so no task sees
    all buyers of an asset.
    """
    rows = ledger.where((F.abs("usd_net_transfers") >= minimum) & (F.col("date") <= day(end)) & ~F.col("is_imputed"))
    t = F.col("usd_net_transfers")
    g = rows.groupBy(*PAIR).agg(F.min(F.when(t > 0, F.col("date"))).alias("first_buy"), F.min(F.when(t < 0, F.col("date"))).alias("_sale"), F.count_if(t > 0).alias("n_buys"), F.count_if(t < 0).alias("n_sells"))
    before = Window.partitionBy("coin_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)

    def ranks(column: str, name: str) -> DataFrame:
        daily = g.where(F.col(column).isNotNull()).groupBy("coin_id", F.col(column).alias("_day")).agg(F.count("*").alias("_n"))
        return daily.select("coin_id", F.col("_day").alias(column), (1 + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias(name))

    def ages(key: str) -> DataFrame:
        return g.groupBy(key).agg(F.datediff(day(end), F.min("first_buy")).cast("long").alias(f"{key.split('_')[0]}_age_days"))

    out = g.join(ranks("first_buy", "buyer_rank"), ["coin_id", "first_buy"], "left").join(ranks("_sale", "seller_rank"), ["coin_id", "_sale"], "left").join(ages("coin_id"), "coin_id").join(ages("wallet_address"), "wallet_address")
    return out.select(*PAIR, "first_buy", "n_buys", "n_sells", F.when(F.col("_sale") > F.col("first_buy"), F.col("_sale")).alias("first_sell"), "buyer_rank", "seller_rank", "coin_age_days", "wallet_age_days")


def transfer_features(ledger: DataFrame, sequence: DataFrame, end) -> DataFrame:
    """Per wallet, over the ledger rows of its pairs bought by ``end``: the rank among buyers, buyers in all, later buyers,
    hold times, and the ages of its assets and its own."""
    total = sequence.groupBy("coin_id").agg(F.max("buyer_rank").alias("total_buyers"))
    s = sequence.where(F.col("first_buy") <= day(end)).join(total, "coin_id").withColumns({
        "later_buyers": F.col("total_buyers") - F.col("buyer_rank"), "earlybird_ratio": F.least(F.col("total_buyers") / F.col("buyer_rank"), F.lit(20.0)),
        "hold_days": F.datediff(F.coalesce("first_sell", day(end)), "first_buy"),
    })
    both = ledger.groupBy(*PAIR).agg(F.count("*").alias("n")).join(s, PAIR)
    cols = ["buyer_rank", "hold_days", "coin_age_days", "total_buyers", "later_buyers", "earlybird_ratio"]
    means = [F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n")).alias(f"{c}_mean") for c in cols]
    medians = [F.percentile(c, 0.5, F.col("n")).alias(f"{c}_median") for c in cols]
    return both.groupBy("wallet_address").agg(*means, *medians, F.min("buyer_rank").alias("buyer_rank_min"), F.min("coin_age_days").alias("coin_age_days_min"), F.max("wallet_age_days").alias("wallet_age_days"))


# balances and market caps


def balance_distribution(ledger: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Per wallet with a total above ``minimum``: concentration of the last balances over its assets, empty ones included."""
    last = ledger.groupBy(*PAIR).agg(F.max_by("usd_balance", "date").alias("b"))
    totals = last.groupBy("wallet_address").agg(F.sum("b").alias("t")).where(F.col("t") > minimum)
    rows = last.join(totals, "wallet_address").withColumn("f", F.col("b") / F.col("t"))
    return rows.groupBy("wallet_address").agg(
        F.sum(F.col("f") * F.col("f")).alias("hhi"), F.max("f").alias("largest_fraction"), F.max("b").alias("largest_usd"), F.max("t").alias("total_usd_balance"), F.count("b").alias("n_coins"),
        F.stddev_samp("f").alias("fraction_std"), F.min("f").alias("smallest_fraction"), F.median("f").alias("median_fraction"),
    )


def market_cap_features(ledger: DataFrame, caps: DataFrame, column: str) -> DataFrame:
    """Per wallet: cap weighted by volume, by ending balance, and statistics over the assets held at the end. Ledger rows
    without a market row are an error."""
    c = F.col(column)
    both = ledger.join(caps.select("coin_id", "date", column, F.lit(True).alias("_known")), ["coin_id", "date"], "left")
    if missing := both.where("_known is null").select("coin_id", "date").limit(5).collect():
        raise ValueError(f"no market row for {[tuple(map(str, r)) for r in missing]}")
    on = both.drop("_known")
    volume = on.where(c.isNotNull()).groupBy("wallet_address").agg(F.try_divide(F.sum(c * F.abs("usd_net_transfers")), F.sum(F.abs("usd_net_transfers"))).alias(f"volume_wtd/{column}"))
    last = on.groupBy(*PAIR).agg(F.max_by(F.struct("usd_balance", column), "date").alias("x")).select("wallet_address", "x.*")
    ending = last.where(c.isNotNull()).groupBy("wallet_address").agg(F.try_divide(F.sum(c * F.col("usd_balance")), F.sum("usd_balance")).alias(f"ending_wtd/{column}"))
    held = last.where("usd_balance > 0").groupBy("wallet_address").agg(F.avg(column).alias(f"held_mean/{column}"), F.median(column).alias(f"held_median/{column}"), F.min(column).alias(f"held_min/{column}"), F.max(column).alias(f"held_max/{column}"), F.stddev_samp(column).alias(f"held_std/{column}"))
    return volume.join(ending, "wallet_address").join(held, "wallet_address")


# market timing


def offsets(market: DataFrame, spec: Mapping[str, Sequence[int]]) -> DataFrame:
    """Values some rows later (_lead_n) or earlier (_lag_n), all over one window."""
    if any(n == 0 for ns in spec.values() for n in ns):
        raise ValueError("an offset of 0 is the column itself")
    if missing := [c for c in spec if c not in market.columns]:
        raise ValueError(f"no such columns: {missing}")
    w = Window.partitionBy("coin_id").orderBy("date")
    return market.withColumns({f"{c}_lead_{n}" if n > 0 else f"{c}_lag_{-n}": (F.lead(c, n) if n > 0 else F.lag(c, -n)).over(w) for c, ns in spec.items() for n in ns})


def relative_changes(df: DataFrame, spec: Mapping[str, Sequence[int]], cutoff: float = 0.0, keep_base: bool = True) -> DataFrame:
    """(offset - base) / base, with the sign turned for lags."""
    new = {}
    for c, ns in spec.items():
        for n in ns:
            name = f"{c}_lead_{n}" if n > 0 else f"{c}_lag_{-n}"
            new[f"{name}_change"] = F.try_divide((F.col(name) - F.col(c)) * (1 if n > 0 else -1), F.col(c))
    out = df.withColumns(new)
    out = winsorize(out, list(new), cutoff) if cutoff else out
    return out if keep_base else out.drop(*spec)


def timing(ledger: DataFrame, changes: DataFrame, columns: Sequence[str], minimum: float) -> DataFrame:
    """Per wallet: changes after its buys and sales, weighted by value; weights of rows without a change count. All wallets
    are there, NULL as 0."""
    rows = ledger.where((F.abs("usd_net_transfers") >= minimum) & ~F.col("is_imputed")).join(changes.select("coin_id", "date", *columns), ["coin_id", "date"], "left")
    t = F.col("usd_net_transfers")
    aggs = [F.try_divide(F.sum(F.when(side, F.coalesce(F.col(c), F.lit(0.0)) * F.abs(t))), F.sum(F.when(side, F.abs(t)))).alias(f"{c}/{name}_weighted") for c in columns for name, side in (("buy", t > 0), ("sell", t < 0))]
    return ledger.select("wallet_address").distinct().join(rows.groupBy("wallet_address").agg(*aggs), "wallet_address", "left").na.fill(0, [f"{c}/{side}_weighted" for c in columns for side in ("buy", "sell")])


# scenarios


def extremes(prices: DataFrame, first, last) -> DataFrame:
    """(coin_id, date, levels): for every day from ``first`` to ``last``, the lowest and highest price of the 1, 2, 4 ... days
    from it on, days without a price left out; each level is made of the one below by looking ahead."""
    days = (last - first).days + 1
    calendar = prices.select("coin_id").distinct().select("coin_id", F.explode(F.sequence(day(first), day(last))).alias("date"))
    rows = calendar.join(prices.select("coin_id", "date", "price"), ["coin_id", "date"], "left")
    w = Window.partitionBy("coin_id").orderBy("date")
    rows = rows.withColumns({"_l0": F.col("price"), "_h0": F.col("price")})
    for k in range(1, days.bit_length()):
        ahead = {x: F.lead(f"_{x}{k - 1}", 1 << (k - 1)).over(w) for x in "lh"}
        rows = rows.withColumns({f"_l{k}": F.least(f"_l{k - 1}", ahead["l"]), f"_h{k}": F.greatest(f"_h{k - 1}", ahead["h"])})
    return rows.select("coin_id", "date", F.array(*[F.struct(F.col(f"_l{k}").alias("low"), F.col(f"_h{k}").alias("high")) for k in range(days.bit_length())]).alias("levels"))


def price_ranges(ledger: DataFrame, prices: DataFrame, start) -> DataFrame:
    """Per ledger row: lowest and highest price from the day of the pair's row before, or the day before ``start``, to its
    own day. Opening and closing rows count as rows; one without any price in its range is left out.

    A range of any length is two overlapping runs of a power of two days, so each row meets a table of ``extremes`` twice,
    by equi-joins on (asset, day)."""
    before = F.coalesce(F.lag("date").over(Window.partitionBy(*PAIR).orderBy("date")), F.date_sub(day(start), 1))
    rows = ledger.select(*PAIR, "date", F.least(before, "date").alias("open_date"))
    first, last = ledger.agg(F.least(F.min("date"), F.date_sub(day(start), 1)), F.greatest(F.max("date"), day(start))).first()
    level = F.length(F.bin(F.datediff("date", "open_date") + 1)) - 1
    rows = rows.withColumn("_k", level).withColumn("_back", F.expr("date_sub(date, cast(pow(2, _k) as int) - 1)"))
    table = extremes(prices, first, last)
    for side, on in (("_a", "open_date"), ("_b", "_back")):
        at = table.select("coin_id", F.col("date").alias(on), F.col("levels").alias("_levels"))
        rows = rows.join(at, ["coin_id", on]).withColumn(side, F.col("_levels")[F.col("_k")]).drop("_levels")
    out = rows.select(*PAIR, "date", "open_date", F.least("_a.low", "_b.low").alias("min_price"), F.greatest("_a.high", "_b.high").alias("max_price"))
    return out.where("min_price is not null")


def scenarios(ledger: DataFrame, ranges: DataFrame, prices: DataFrame, end, kinds: Sequence[str] = ("ideal", "worst")) -> DataFrame:
    """The ledger once for each kind, with column ``kind``: as if every sale had been at the best (ideal) or worst price of its
    range, every buy at the opposite, and the balance of the last day were priced like a sale. Tokens stay the same."""
    if unknown := set(kinds) - {"ideal", "worst"}:
        raise ValueError(f"no such scenario: {unknown}")
    both = ledger.join(prices.select("coin_id", "date", "price"), ["coin_id", "date"]).join(ranges.drop("open_date"), [*PAIR, "date"])
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(h).alias("_sale"), F.col(w).alias("_buy")) for k, h, w in (("ideal", "max_price", "min_price"), ("worst", "min_price", "max_price")) if k in kinds]))
    rows = both.withColumn("_x", kind).select(*both.columns, "_x.*")
    tokens = F.col("usd_net_transfers") / F.col("price")
    new = tokens * F.when(F.col("usd_net_transfers") < 0, F.col("_sale")).otherwise(F.col("_buy"))
    balance = F.when(F.col("date") == day(end), F.col("usd_balance") / F.col("price") * F.col("_sale")).otherwise(F.col("usd_balance"))
    return rows.withColumns({"usd_net_transfers": new, "usd_balance": balance, "usd_inflows": expr.positive(new)}).select("kind", *ledger.columns)


def scenario(ledger: DataFrame, ranges: DataFrame, prices: DataFrame, end, kind: str) -> DataFrame:
    """The ledger of one scenario."""
    return scenarios(ledger, ranges, prices, end, [kind]).drop("kind")


#: What of trading is compared with a scenario: name -> (column, column that it is measured by, name of the share).
RELATIVE = {
    "relative_cash_buys": ("cash_buys", "cash_buys", "relative_cash_buys/pct"), "relative_cash_sells": ("cash_sells", "cash_sells", "relative_cash_sells/pct"),
    "relative_gains": ("crypto_outflows", "crypto_outflows", "relative_gains/pct"), "relative_net_gains": ("net_gain", "max_investment", "relative_roi"),
}
NET = ("relative_cash_sells", "relative_cash_buys", "relative_roi", "relative_gains", "relative_net_gains")


#: Ratios that are compared in all their forms, and the names of the differences.
COMPARED = {"net_gain/max_investment": "relative_net_gain_max_inv", "net_gain/crypto_inflows": "relative_net_gain_inflows"}
_FORMS = ("base", "winsorized", "rank")


def scenario_features(ledger: DataFrame, prices: DataFrame, start, end, materiality: float = 20.0, cutoff: float = 0.01) -> DataFrame:
    """Per wallet: trading and performance against the ideal (signs turned: what was missed) and the worst scenario, and
    where between the two the wallet lies, from 0, the worst, to 1.

    Of trading: how far it is from the scenario's, in money, as a winsorized share of a material base (else 0), as the rank
    of that, and buys and sales combined. Of performance: the ratio to the scenario's, for gains by investment and by
    inflows, in all its forms. Shares and ratios are rounded to nine digits, as in ``performance``.

    The ledger and its scenarios are one table with a column for the kind, so trading features are one pass, and all
    columns are winsorized and ranked together, each over the wallets that its scenarios know.
    """
    ledger = settled(ledger)
    rows = ledger.select(F.lit("actual").alias("kind"), "*").unionByName(scenarios(ledger, price_ranges(ledger, prices, start), prices, end))
    kinds, others = ("actual", "ideal", "worst"), ("ideal", "worst")
    used = sorted({c for a, b, _ in RELATIVE.values() for c in (a, b)} | {c for n in COMPARED for c in n.split("/")})
    of = lambda k, c: F.col(f"`{k}|{c}`")
    wide = trading(rows, start, end, ["kind"]).groupBy("wallet_address").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}|{c}") for k in kinds for c in used])
    new = {f"{k}|{n}/base": F.round(expr.ratio(of(k, n.split("/")[0]), of(k, n.split("/")[1])), 9) for k in kinds for n in COMPARED}
    for k in others:
        for n, (c, base, share) in RELATIVE.items():
            far = F.abs(of("actual", c) - of(k, c))
            new[f"{k}|{n}"] = far
            new[f"{k}|{share}"] = F.when(far.isNotNull(), F.round(F.when(of("actual", base) >= materiality, far / of("actual", base)).otherwise(0.0), 9))
    shares = [f"{k}|{share}" for k in others for _, _, share in RELATIVE.values()]
    known = F.col("`actual|net_gain`").isNotNull() & of("ideal", "net_gain").isNotNull() & of("worst", "net_gain").isNotNull()
    rows = wide.withColumns(new).withColumns({f"{k}|{n}/winsorized": of(k, f"{n}/base") for k in kinds for n in COMPARED})
    rows = winsorize(rows.withColumn("_known", known), [*[f"{k}|{n}/winsorized" for k in kinds for n in COMPARED], *shares], cutoff)
    combined = {f"{k}|relative_combined/pct": F.round((of(k, "relative_cash_buys/pct") + 1) * (of(k, "relative_cash_sells/pct") + 1) - 1, 9) for k in others}
    rows = winsorize(rows.withColumns(combined), list(combined), cutoff)
    ranks = {c: c + "_rank" if c.endswith("/pct") else c + "/pct_rank" for c in (*shares, *combined)}
    rows = pct_ranks(rows, ranks | {f"{k}|{n}/base": f"{k}|{n}/rank" for k in kinds for n in COMPARED}).where("_known")
    own = [*RELATIVE, *[c.partition("|")[2] for x in ranks.items() for c in x if c.startswith("ideal|")]]
    out: dict[str, Column] = {}
    for k, sign in (("ideal", -1), ("worst", 1)):
        out |= {f"{k}/{c}": of(k, c) * sign for c in own}
        out |= {f"{k}/{short}/{form}": (of("actual", f"{n}/{form}") - of(k, f"{n}/{form}")) * sign for n, short in COMPARED.items() for form in _FORMS}
    rows = rows.select("wallet_address", *[c.alias(n) for n, c in out.items()])
    a, b = (lambda c: F.col(f"`ideal/{c}`")), (lambda c: F.col(f"`worst/{c}`"))
    return rows.withColumns({f"net_perf/{c}": F.when(F.abs(b(c) - a(c)) < 1e-10, 0.0).otherwise(F.try_divide(-a(c), b(c) - a(c))) for c in NET})


# holder trends


def all_time_high(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("coin_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = prices.select("coin_id", "date", "price").withColumn("ath", F.max("price").over(w))
    rows = rows.withColumn("_d", F.last(F.when(F.col("price") == F.col("ath"), F.col("date")), True).over(w))
    return rows.select("coin_id", "date", "price", "ath", F.datediff("date", "_d").cast("long").alias("days_since_ath"), F.try_divide(F.col("price"), F.col("ath")).alias("pct_of_ath"))


def holders(ledger: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Per asset and day with a ledger row: holders, holders in profit, and wallets that ever held, by threshold crossings."""
    w = Window.partitionBy(*PAIR).orderBy("date")
    now, before = F.col("usd_balance") > minimum, F.coalesce(F.lag("usd_balance").over(w), F.lit(0.0)) > minimum
    gain_now = now & (F.col("profits_cumulative") > minimum)
    gain_before = before & (F.coalesce(F.lag("profits_cumulative").over(w), F.lit(0.0)) > minimum)
    first = now & (F.coalesce(F.max("usd_balance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) <= minimum)
    step = lambda a, b: F.when(a & ~b, 1).when(~a & b, -1).otherwise(0)
    rows = ledger.select("coin_id", "date", step(now, before).alias("h"), step(gain_now, gain_before).alias("p"), first.cast("int").alias("n"))
    daily = rows.groupBy("coin_id", "date").agg(*[F.sum(c).alias(c) for c in "hpn"])
    run = Window.partitionBy("coin_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("coin_id", "date", F.sum("h").over(run).alias("holders"), F.sum("p").over(run).alias("holders_in_profit"), F.sum("n").over(run).alias("lifetime_holders"))


def coin_trends(ledger: DataFrame, prices: DataFrame, minimum: float = 0.0) -> DataFrame:
    """The eight trend columns on every market day: holders carried forward, then 0; ratios 0 without a denominator."""
    ath, h = all_time_high(prices), holders(ledger, minimum)
    w = Window.partitionBy("coin_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = ath.join(h, ["coin_id", "date"], "left")
    counts = ["holders", "holders_in_profit", "lifetime_holders"]
    rows = rows.withColumns({c: F.coalesce(F.last(c, True).over(w), F.lit(0)) for c in counts})
    launch = F.min("date").over(Window.partitionBy("coin_id"))
    return rows.withColumns({"pct_in_profit": expr.ratio("holders_in_profit", "holders"), "retention": expr.ratio("holders", "lifetime_holders"), "days_since_launch": F.datediff("date", launch).cast("long")})


# all families, all windows


def features(ledger: DataFrame, start, end, cohort: DataFrame, families: Mapping[str, DataFrame], nulls_kept: Sequence[str] = ()) -> DataFrame:
    """A row for every wallet of the cohort with the columns of all families as family|column; families not in
    ``nulls_kept`` have 0 for wallets they don't know."""
    out = cohort.select("wallet_address")
    for name, df in families.items():
        renamed = df.toDF(*[c if c == "wallet_address" else f"{name}|{c}" for c in df.columns])
        out = out.join(renamed, "wallet_address", "left")
        if name not in nulls_kept:
            out = out.na.fill(0, [c for c in renamed.columns if c != "wallet_address"])
    return out


def windows_wide(long: DataFrame, columns: Sequence[str], windows: Sequence[int], newest_first: bool = True) -> DataFrame:
    """One row per wallet: column|w1 (the newest window), column|w2 ... from rows (window_id, wallet_address, columns)."""
    order = sorted(windows, reverse=newest_first)
    return long.groupBy("wallet_address").agg(*[F.coalesce(F.max(F.when(F.col("window_id") == w, F.col(c))), F.lit(0.0)).alias(f"{c}|w{i + 1}") for i, w in enumerate(order) for c in columns])

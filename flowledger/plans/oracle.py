"""Shape of the registered queries: numbers rounded alike in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.plans.views import _NEEDS, _SQL


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def Q(views: str, final: str, doubles: str = "", ctes: str = "", digits: int = 6) -> str:  # noqa: N802
    """SQL over the named views and further common tables; the columns in ``doubles`` are rounded."""
    order: list[str] = []
    for n in views.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    parts = [_SQL[n] for n in order] + ([ctes] if ctes else []) + [f"q AS ({final})"]
    cols = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in doubles.split())
    return "WITH " + ",\n".join(parts) + f"\nSELECT *{f' REPLACE ({cols})' if cols else ''} FROM q"


#: The ledger of the training period with opening and closing rows, as SQL: needs the views ledger and market.
PERIOD = """
days AS (SELECT DATE '2024-01-05' AS d UNION ALL SELECT DATE '2024-01-20'),
lastrow AS (SELECT l.coin_id, l.wallet_address, d, max(l.date) AS ld FROM ledger l JOIN days ON l.date <= d GROUP BY 1, 2, 3),
made AS (SELECT l.coin_id, l.wallet_address, r.d AS date, 0.0 AS usd_net_transfers, l.usd_balance * (n.price / o.price) AS usd_balance, 0.0 AS usd_inflows, l.usd_inflows_cumulative,
    l.profits_cumulative + (n.price / o.price - 1) * l.usd_balance AS profits_cumulative, true AS is_imputed
    FROM lastrow r JOIN ledger l ON l.coin_id = r.coin_id AND l.wallet_address = r.wallet_address AND l.date = r.ld JOIN market n ON n.coin_id = r.coin_id AND n.date = r.d JOIN market o ON o.coin_id = r.coin_id AND o.date = r.ld WHERE r.ld < r.d),
both_ AS (SELECT coin_id, wallet_address, date, usd_net_transfers, usd_balance, usd_inflows, usd_inflows_cumulative, profits_cumulative, is_imputed FROM ledger UNION ALL SELECT * FROM made),
period AS (SELECT coin_id, wallet_address, date, CASE WHEN date = DATE '2024-01-05' THEN 0.0 ELSE usd_net_transfers END AS usd_net_transfers, round(usd_balance, 2) + 0.0 AS usd_balance, CASE WHEN date = DATE '2024-01-05' THEN 0.0 ELSE usd_inflows END AS usd_inflows,
    round(usd_inflows_cumulative, 2) + 0.0 AS usd_inflows_cumulative, round(profits_cumulative, 2) + 0.0 AS profits_cumulative, (is_imputed OR date = DATE '2024-01-05') AS is_imputed
    FROM both_ WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')"""
#: Trading features over PERIOD.
TRADING = """
adj AS (SELECT *, CASE WHEN date = DATE '2024-01-05' THEN usd_balance WHEN date = DATE '2024-01-20' THEN usd_net_transfers - usd_balance ELSE usd_net_transfers END AS chg, CASE WHEN date = DATE '2024-01-20' THEN 0.0 ELSE usd_balance END AS bal FROM period),
cum AS (SELECT *, sum(chg) OVER (PARTITION BY coin_id, wallet_address ORDER BY date ROWS UNBOUNDED PRECEDING) AS put FROM adj),
pairs_ AS (SELECT wallet_address, coin_id, arg_max(bal - put, date) AS g, max(put) AS m, sum(greatest(chg, 0.0)) AS i, sum(greatest(-chg, 0.0)) AS o FROM cum GROUP BY 1, 2),
gain AS (SELECT wallet_address, sum(i) AS crypto_inflows, sum(o) AS crypto_outflows, sum(i) - sum(o) AS net_crypto_flows, sum(g) AS net_gain, greatest(max(m), 0.0) AS max_investment FROM pairs_ GROUP BY 1),
act AS (SELECT wallet_address, sum(abs(usd_net_transfers)) AS total_volume, avg(abs(usd_net_transfers)) AS average_transaction, sum(greatest(chg, 0.0)) AS cash_buys, sum(greatest(-chg, 0.0)) AS cash_sells, sum(chg) AS net_cash_flow,
    count(DISTINCT coin_id) AS unique_coins_traded, count(*) FILTER (usd_net_transfers <> 0) AS transaction_days FROM adj WHERE NOT is_imputed GROUP BY 1),
trading AS (SELECT wallet_address, crypto_inflows, crypto_outflows, net_crypto_flows, net_gain, max_investment, coalesce(total_volume, 0) AS total_volume, coalesce(average_transaction, 0) AS average_transaction, coalesce(cash_buys, 0) AS cash_buys, coalesce(cash_sells, 0) AS cash_sells, coalesce(net_cash_flow, 0) AS net_cash_flow, coalesce(unique_coins_traded, 0) AS unique_coins_traded, coalesce(transaction_days, 0) AS transaction_days FROM gain LEFT JOIN act USING (wallet_address))"""

#: Running cost basis over TRADING's rows.
COST = """
co AS (SELECT coin_id, wallet_address, date, chg, CASE WHEN usd_net_transfers < 0 THEN least(greatest(coalesce(-usd_net_transfers / nullif(bal - usd_net_transfers, 0), 1.0), 0.0), 1.0) ELSE 0.0 END AS sold, row_number() OVER (PARTITION BY coin_id, wallet_address ORDER BY date) AS k FROM adj),
cost AS (WITH RECURSIVE r AS (SELECT coin_id, wallet_address, date, k, greatest(chg, 0.0) AS c FROM co WHERE k = 1 UNION ALL SELECT s.coin_id, s.wallet_address, s.date, s.k, r.c * (1 - s.sold) + greatest(s.chg, 0.0) FROM r JOIN co s ON s.coin_id = r.coin_id AND s.wallet_address = r.wallet_address AND s.k = r.k + 1) SELECT * FROM r)"""

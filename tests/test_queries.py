"""Every registered query against its SQL in DuckDB on the given tables; model jobs by their properties."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowledger.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows[:50]:
        for c, v in r.asDict().items():
            if c in ("score", "confidence"):
                assert v is None or v <= 1.0 + 1e-9
            if "distance" in c:
                assert v >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_limit_is_not_passed_by_rounding(spark, tmp_path):
    """Inflows of exactly 60.00 are not above 60, though the doubles of many such pairs add up to more."""
    rng = random.Random(1)
    rows = []
    for wallet in range(300):
        cuts = sorted(rng.sample(range(1, 6000), 4))
        rows += [(f"2024-01-0{i + 1} 08:00:00", wallet, "view", (b - a) / 100) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 6000], strict=True))]
    rows += [(f"2024-01-{i + 1:02d} 09:00:00", 1000, "view", 50.0 + i) for i in range(30)]
    events = spark.createDataFrame([(3 * i + 1, *r) for i, r in enumerate(rows)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["x12_validation_returns"](spark, str(tmp_path)).collect()
    assert got and {r["wallet_address"] for r in got} == {1000}

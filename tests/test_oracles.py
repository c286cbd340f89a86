"""Every query of the engine against its SQL on the smallest tables; those without SQL must run."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or df[c].map(lambda v: hasattr(v, "year")).any():
            df[c] = pd.to_datetime(df[c])
        elif pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, D).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).df()
        pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=0, atol=2e-6)


def test_order_flow_of_ticks_at_one_time(spark, con, tmp_path):
    """Copies of the events at the same times, as larger tables have them: a bar may close between ticks of one time."""
    copies = f"SELECT * REPLACE (event_id + 1000000 * i AS event_id) FROM '{D}/events.parquet', range(3) r(i)"
    con.execute(f"COPY (SELECT * EXCLUDE (i) FROM ({copies})) TO '{tmp_path}/events.parquet'")
    got = registry.QUERIES["order_flow_per_bar"](spark, str(tmp_path))
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()  # quadratic in the ticks of a symbol
    want = duckdb.connect().execute(registry.ORACLE_SQL["order_flow_per_bar"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).df()
    pd.testing.assert_frame_equal(normal(got.toPandas()), normal(want), check_dtype=False, rtol=0, atol=2e-6)

"""Queries against their SQL in DuckDB on the driver's tables; set ORACLES=all for every query and
ORACLES_DATA for another folder (some series of sf0.001 are nearly constant, where the last digits differ)."""

import glob
import os

import duckdb
import pytest

from marketloom.plans import registry

DATA = os.environ.get("ORACLES_DATA", "/root/testdata/sf0.001")
FEW = ["s3_j1_j2_r45_market_frame", "r13_flow_radar_weekly", "r30_r31_positioning_z", "a13_r39_participation_momentum", "a20_j10_forward_returns", "v1_integrity", "x01_stream_intraday_bars"]
NAMES = sorted(registry.queries()) if os.environ.get("ORACLES") == "all" else FEW


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
    spark.catalog.clearCache()

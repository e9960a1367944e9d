"""Every registered query with an oracle, at sf0.001, against DuckDB on the same files."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402
from paths import SF_SMALL  # noqa: E402

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLES[name])
    dcols, drows = rel.columns, rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(scols, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert "Predicted_l_returnflag" in df.columns
    assert df.count() > 0

"""The regression queries against their SQL."""

import duckdb
import numpy as np
import pytest

from strand.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    for c in columns:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], atol=2e-5)
        else:
            assert (got[c] == want[c]).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

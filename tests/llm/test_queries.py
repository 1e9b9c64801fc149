import os

import duckdb
import pytest

from parlance.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    assert not got.drop(columns=[c for c in got.columns if got[c].map(type).eq(list).any()]).duplicated().any()
    if name in queries.SQL:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
        want = con.execute(queries.SQL[name]).df()[got.columns.tolist()]
        assert set(got.itertuples(index=False, name=None)) == set(want.itertuples(index=False, name=None))

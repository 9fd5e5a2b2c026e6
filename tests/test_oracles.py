"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quern import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or str(v) in ("nan", "<NA>", "NaT"):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):  # a column with nulls is read as floats by one side
            return f"{round(float(v), 4) + 0.0:.4f}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

"""Every registered query over the reference's operators gives the rows of its SQL."""

import os

import duckdb
import pytest

from glosswork.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(data, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted("|".join(canon(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    wanted = sorted("|".join(canon(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == wanted

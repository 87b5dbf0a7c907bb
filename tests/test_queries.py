"""Every registered draw query against its SQL at the smallest size."""

import duckdb
import pytest

from drawloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _plain(v):
    if v is None or isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=str)


#: Spark ML fits are tested on their own fixtures and take long.
FITS = {"b22_numbers", "e3_popularity", "e18_forecast", "e6_heat"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - FITS))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() == 40

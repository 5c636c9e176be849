"""Every catalogue query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from terrane.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def normal(df: pd.DataFrame) -> list:
    def cell(x):
        if pd.isna(x):
            return None
        return str(x) if isinstance(x, str) or type(x).__name__.startswith("bool") else round(float(x), 3) + 0.0

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert normal(got) == normal(db.sql(catalogue.ORACLES[name]).df())

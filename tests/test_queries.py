"""Every query of the engine's own operators runs, and matches its SQL twin where it has one."""

import duckdb
import pytest

from tallyspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert got == rows(rel.columns, rel.fetchall())

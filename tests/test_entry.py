import duckdb
import pytest

import __spark_entry__ as E
import compare


def test_contract():
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs_and_matches_its_sql(spark, sf, name):
    got = E.queries()[name](spark, sf).toPandas()
    if name in E.oracle_sql():
        con = duckdb.connect()
        from pathlib import Path

        for p in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert compare.normal(got) == compare.normal(con.execute(E.oracle_sql()[name]).fetchdf())

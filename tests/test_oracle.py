"""Every query of the library against its DuckDB oracle (sf0.001), the way the
round checker compares them: same columns, same kinds of types, same row count,
same multiset of rows. The training-data keys are tested in ``tests/llm``."""

import duckdb
import pytest

from scripts.check_oracle import TABLES, rows_of, spark_kind, sql_kind
from tests.conftest import SF001
from vendorscope.plans.registry import oracle_queries, spark_queries

QUERIES = spark_queries()
SQL = oracle_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(SQL))
    assert missing == [], f"queries without an oracle: {missing}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    got, exp = df.toPandas(), con.execute(SQL[name])
    kinds = {d[0]: sql_kind(d[1]) for d in exp.description}
    assert {f.name: spark_kind(f.dataType) for f in df.schema} == kinds
    exp = exp.df()
    assert len(got) == len(exp)
    assert rows_of(got) == rows_of(exp)

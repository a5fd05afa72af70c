"""Queries with an oracle, side by side with DuckDB."""
import duckdb
import pytest

from dwellframe.llm.queries import QUERIES, SQL

from .helpers import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(SQL[name])
    columns = [c[0] for c in rel.description]
    want = sorted(sorted(zip(columns, r, strict=True)) for r in rel.fetchall())
    got = sorted(sorted(r.asDict().items()) for r in QUERIES[name](spark, SF).collect())
    assert want == got

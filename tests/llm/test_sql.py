"""Queries against their SQL twins, on texts with every odd case: nulls, empty and long texts, copies, clashing columns."""

import duckdb
import pytest

from winnowry.llm.catalog import ORACLES, QUERIES

from ..test_entry import value


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    """The odd rows as tables; doc_ids are made distinct, as the contract's queries have one row a doc_id."""
    d = tmp_path_factory.mktemp("tables")
    own = [(k, t, lang, source, n, c) for k, (_, t, lang, source, n, c) in enumerate(rows)]
    spark.createDataFrame(own, docs.schema).write.parquet(f"{d}/documents.parquet")
    long = max((r[1] for r in rows if r[1]), key=len).split()
    items = [(0, " ".join(long[100:150])), (1, None), (None, "x y"), (2, ""), (3, "one two three"), (4, rows[3][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    plain = con.sql(ORACLES[name]).df()
    assert sorted(plain.columns) == columns
    rows = lambda df: sorted(tuple(str(value(x)) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(got.toPandas()) == rows(plain)

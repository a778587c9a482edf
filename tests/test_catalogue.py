"""Every registered query against its SQL on the small tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lectern.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data), sorted(columns)


@pytest.fixture(scope="module")
def con(middle):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{middle}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{middle}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, middle, name):
    df = catalogue.QUERIES[name](spark, middle)
    got = rows(df.columns, df.collect())
    out = con.execute(catalogue.oracles()[name])
    want = rows([d[0] for d in out.description], out.fetchall())
    assert got == want


def test_text_strategy_counts_cut_references_as_its_sql_does(spark, tmp_path):
    import duckdb

    ends = ["&amp", "&quot", "&lt;", "&am", "&", "&amp;amp", "&ampx;", "&amp b", "&gt1"]
    pages = [(100 * i + n, "u", f"<html><body><article><h1>{'x' * n}{end}</h1></article></body></html>") for i, end in enumerate(ends) for n in range(194, 200)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, catalogue.QUERIES["text_strategy"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.execute(catalogue.oracles()["text_strategy"]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

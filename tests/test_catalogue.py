"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexicask.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, sf)
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "tf", "positions"]
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_byte_sizes_on_larger_tables(spark):
    """sf0.001 has no size that lies half-way between two hundredths; document 882 of sf0.01 has one."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    ours = {r.doc_id: r["size"] for r in catalogue.byte_sizes(spark, sf).collect()}
    assert ours == dict(con.execute(catalogue.ORACLE_SQL["byte_sizes"]).fetchall()) and ours[882] == "30.62 KB"

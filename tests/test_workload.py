"""Every query of the HTML workload against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from domloom.workload import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, data, duck, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory):
    """Pages whose titles and headings are cut inside of a reference, as those of the larger pages tables are."""
    duckdb = pytest.importorskip("duckdb")
    d = tmp_path_factory.mktemp("cut")
    page = "<!DOCTYPE html><html lang=\"en\"><head><title>{0}</title></head><body><article><h1>{0}</h1><p>a &amp; b</p></article></body></html>"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    titles = ["a&amp;&amp;&amp", "a&amp;&am", "a&amp;&a", "&quot;a&quot", "&quot;a&quo", "&amp;copy;", "&copy; &copy", "a&amp;"]
    con.executemany("INSERT INTO pages VALUES (?, 'http://a.example/', ?)", [(i, page.format(t)) for i, t in enumerate(titles)])
    con.execute(f"COPY pages TO '{d}/pages.parquet' (FORMAT parquet)")
    return str(d), con


@pytest.mark.parametrize("name", ["page_titles", "visible_text", "text_length_stats", "udf_text"])
def test_references_that_are_cut_off(spark, cut_pages, name):
    d, con = cut_pages
    assert rows(QUERIES[name](spark, d).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())

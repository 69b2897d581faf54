"""Registered queries against DuckDB on the smallest tables, where they are at hand."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidegrain.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(x[names.index(c)]) for c in cols]) for x in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_serving_rows_are_unique(spark):
    df = registry.queries()["j18_serving"](spark, SF)
    assert df.groupBy("product", "uf", "mes").count().filter("count > 1").isEmpty()


def test_search_has_its_fuzzy_level(spark):
    scores = [r.score for r in registry.queries()["h32_fuzzy_search"](spark, SF).collect()]
    assert any(0.4 < x <= 1 for x in scores)


def test_whole_jobs_leave_no_row_out(spark):
    own = lambda name: registry.queries()[name](spark, SF)
    rows = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    for name, of in (("h4_name_key", "documents"), ("h1_decimal_price", "lineitem"), ("f4_null_order", "supplier"), ("f9_status_order", "orders")):
        assert own(name).count() == rows(of), name
    assert own("b15_valid_rows").select("uf", "periodo").distinct().count() > 1
    rank = {"F": 0, "P": 1}
    order = [rank.get(r.o_orderstatus, 2) for r in own("f9_status_order").collect()]
    assert order == sorted(order)

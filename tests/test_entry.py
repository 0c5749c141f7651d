"""The driver's entry points: names match, and a few queries agree with their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["flt_03_first_linked_entity", "agg_01_entity_idf", "srch_01_exact_search", "srch_03_analogous_search", "srch_16_banding", "ev_01_ndcg", "jn_18_page_similarity"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).values.tolist()), key=repr)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and rows(got)

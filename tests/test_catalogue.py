"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sievebase.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(frame: pd.DataFrame) -> list[str]:
    def value(v):
        if not isinstance(v, (list, np.ndarray)) and pd.isna(v):
            return None
        return v.item() if hasattr(v, "item") else v

    return sorted(repr([value(v) for v in row]) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    """And without Python workers or cross products."""
    frame = catalogue.QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    got = frame.toPandas()
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["find_eq"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_comment" not in plan and "o_orderdate" not in plan
    plan = catalogue.QUERIES["find_like_prefix"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,re)" in plan


def test_top_k_keeps_a_heap(spark, sf_dir):
    assert "TakeOrderedAndProject" in catalogue.QUERIES["sort_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

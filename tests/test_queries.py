"""Registered queries against their SQL on the driver's tables, where those are there."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from trackloom.plans import more  # noqa: F401  (registers its queries)
from trackloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in [*TABLES, "embeddings", "labels"]:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(df):
    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return str([value(x) for x in v])
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(value(v) for v in r)) for r in df.itertuples(index=False, name=None)), list(df.columns)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    assert normal(plans.QUERIES[name](spark, DATA).toPandas()) == normal(duck.sql(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_reads_the_corpus_subpackage():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, names in os.walk(os.path.join(root, "trackloom")):
        if f"{os.sep}llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "llm" not in f.read()

"""Every registered query with SQL equals it on the small driver tables, where they are present."""

import os

import pytest

import __spark_entry__ as entry
from folioscope.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_without_training_package():
    """Nothing outside the training-data package imports it."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "folioscope")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "folioscope.llm" not in f.read()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["r4_hybrid_rrf", "g6_mentions", "a8_ordered_concat", "r11_stats", "t4_debounce_sessions", "a14_budget_pack", "r8_outline"])
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = c.sql(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    got = [tuple(show(r[x]) for x in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(show, r))) for r in want)

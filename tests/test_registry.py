"""Registered queries against the same in DuckDB, on the smallest tables if they are there."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tarmac.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = ["dedup_first", "training_stats", "cache_lookup", "upsert_latest", "clean_lines", "hit_counts", "topk_match", "decide_matrix", "decision_stats", "hierarchy_titles", "incremental_anti", "class_cap", "rule_histogram", "sched_ladder"]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = sorted(map(repr, map(tuple, con.sql(f"select {','.join(cols)} from ({registry.oracle_sql()[name]}\n)").fetchall())))
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


@needs_data
def test_flagship(spark):
    """All three verdicts occur once the catalog takes part."""
    got = {r["decision"]: r["n"] for r in entry.entry(spark).collect()}
    assert sum(got.values()) > 0 and set(got) == {"CONFIRM", "CORRECT", "REVIEW"}

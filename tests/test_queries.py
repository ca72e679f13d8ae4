"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Long iterative compositions have their own scenes in test_scenes.py.
LONG = {"k04_label_scans", "k04_panorama_scores", "e11_refine", "e17_plan_doors", "k01_place_scans", "k06_merge_scans"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, key):
    assert compare(spark, duck, sf_dir, QUERIES[key], SQL[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL) - LONG))
def test_runs(spark, sf_dir, key):
    QUERIES[key](spark, sf_dir).collect()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["scan_id", "row", "col", "grey"] and df.count() > 0

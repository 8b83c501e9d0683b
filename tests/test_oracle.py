"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest
from oracle import compare

from quern.plans import queries as R

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", sorted(R.SQL))
def test_query(spark, name):
    assert compare(spark, D, R.Q[name], R.SQL[name]) > 0


@pytest.mark.parametrize("name", ["select_features_gam", "build_paga_louvain", "partition_layout", "sammon", "run_gsea"])
def test_rows_only(spark, name):
    assert R.Q[name](spark, D).count() > 0

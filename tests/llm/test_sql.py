import os

import pytest
from oracle import compare

from quern.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    assert compare(spark, D, registry.Q[name], registry.SQL[name]) > 0

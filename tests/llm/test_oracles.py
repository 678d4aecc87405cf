import pytest
from oracle import compare

from millrace.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_oracle(spark, sf_dir, name):
    compare(registry.QUERIES[name](spark, sf_dir), registry.SQL[name], sf_dir)

import pytest
from oracle import compare

from millrace import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, sf_dir, name):
    compare(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name], sf_dir)


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0

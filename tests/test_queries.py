import os

import pytest

from millrace import registry
from tests.sql import SF, same, views

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert same(spark, con, registry.QUERIES[name], registry.ORACLES.get(name))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(registry.QUERIES) <= set(__spark_entry__.queries())

import os

import pytest

from millrace.llm import registry
from tests.sql import SF, same, views

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    assert same(spark, views(), registry.QUERIES[name], registry.ORACLES.get(name))


def test_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == [*range(1, 14)]

import pytest

from rostrum.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: registry.table(spark, SMALL, name)

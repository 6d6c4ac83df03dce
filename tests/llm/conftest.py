import pytest

from demandlake.llm.common import Workspace


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")

import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from ulasan.llm.common import prepare
    prepare(spark)
    return spark

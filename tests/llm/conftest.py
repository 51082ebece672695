import pytest

from webquarry.llm import registry


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    """Python workers find the package wherever pytest was started."""
    registry.importable(lambda s: None)(spark)

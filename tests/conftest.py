import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tarnflow.session import build_session

    return build_session("tests", 4, **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "3g"})


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

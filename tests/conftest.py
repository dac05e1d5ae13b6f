import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from contactlens.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def rows(spark):
    """Build a DataFrame from tuples with a DDL schema."""
    def make(data, schema):
        return spark.createDataFrame(data, schema)
    return make

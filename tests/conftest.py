import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagelake.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="tests")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of given values."""

    def run(expression, **values):
        names = list(values)
        df = spark.createDataFrame([tuple(values.values())] if names else [(1,)], names or ["x"])
        return df.select(expression.alias("v")).first()["v"]

    return run

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scribegauge.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data")
    return str(path)


@pytest.fixture
def values(spark):
    """values(rows, schema, column, ...): the columns of a literal table, as a list of values or of tuples."""

    def get(rows, schema, *columns):
        found = [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]
        return [r[0] for r in found] if len(columns) == 1 else found

    return get

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from metricloom.functions.values import Table  # noqa: E402
from metricloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Text table from column names and rows; ``rid`` numbers the rows."""

    def make(names, rows, key=False):
        names = names.split()
        data = [tuple("" if v is None else str(v) for v in r) for r in rows]
        schema = ", ".join(f"{n} string" for n in names)
        if key:
            data = [r + (i,) for i, r in enumerate(data, 2)]
            schema += ", rid long"
        df = spark.createDataFrame(data, schema)
        return Table(df, "rid" if key else None)

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()

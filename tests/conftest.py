import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitegrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "sitegrain-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""

    def run(column, **values):
        schema = ", ".join(f"{k} STRING" for k in values) or "x STRING"
        row = tuple(values.values()) or ("x",)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return run

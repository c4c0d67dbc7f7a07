import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lanternpost.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", memory="8g")


@pytest.fixture
def column(spark):
    """Values of one expression over a list of one-column rows."""

    def run(values, expression, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        out = rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in out]

    return run

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from awkward import awkward_rows  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows with columns that clash with names used inside the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), "doc_id long, text string, source string").repartition(5)
    clash = ["start", "length", "hash", "number", "class", "keys", "route", "range", "row", "score", "span", "kept", "n", "label"]
    return df.withColumns({name: F.col("source") for name in clash})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")

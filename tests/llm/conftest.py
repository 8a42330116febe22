import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import awkward  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The awkward documents, with an extra column whose name operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(awkward(), SCHEMA).withColumn("batch", F.lit("x")).withColumn("fingerprint", F.lit(1.5)).withColumn("row", F.lit(0)).withColumn("size", F.lit("s")).withColumn("node", F.lit(None).cast("string")).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

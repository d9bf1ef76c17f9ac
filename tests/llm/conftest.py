import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from corpus import corpus  # noqa: E402


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The corpus with extra columns whose names the operators use themselves."""
    rows = [(d, t, "x", 1, None) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, doc string, tag int, name string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from modlens.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# Started here, as test modules build columns when they are loaded.
SESSION = local_session(8, memory="8g", app="tests")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


def table(spark, texts, **labels):
    """Rows (doc_id, text, labels…) from a list of texts."""
    names = list(labels)
    rows = [(i, t, *[labels[n][i] for n in names]) for i, t in enumerate(texts)]
    schema = ", ".join(["doc_id bigint", "text string", *[f"{n} int" for n in names]])
    return spark.createDataFrame(rows, schema)

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="topicloom-test-")


@pytest.fixture(scope="session")
def planted(spark):
    """Documents over two disjoint term sets."""
    rows = []
    for d in range(60):
        side = "abcdefgh" if d % 2 else "pqrstuvw"
        rows.append((d, " ".join(side[(d * 7 + i * i) % 8] * 2 for i in range(30))))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()

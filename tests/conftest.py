import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallygrove.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", partitions=8, app="tests")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def scored(spark):
    """2,000 scored rows, a third of them sharing one score."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(2000):
        p = 0.25 if i % 3 == 0 else round(rng.random(), 4)
        rows.append((i * 7 % 2000, int(rng.random() < 0.2 + 0.6 * p), p))
    return spark.createDataFrame(rows, "id bigint, label int, p double").repartition(6)

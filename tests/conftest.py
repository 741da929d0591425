import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stratocast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_sf():
    return "/root/testdata/sf0.001"


# Two forecast pairs with hand-derived scores.
PAIRS = [
    (
        1,
        "Partly cloudy with temperatures around 22-25°C. Light winds up to 15 km/h. No rain expected.",
        "Partly cloudy skies with highs near 24°C. Breezy conditions with winds to 18 km/h. Dry conditions.",
        "New York",
    ),
    (
        2,
        "Overcast with showers likely. Temperatures 18-20°C. Winds increasing to 25 km/h.",
        "Cloudy with rain expected. Cool temperatures around 19°C. Windy with gusts to 28 km/h.",
        "London",
    ),
]


@pytest.fixture(scope="session")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id int, generated_forecast string, reference_forecast string, location string")

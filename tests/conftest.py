import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sifter.session import local_session  # noqa: E402

EXAMPLE = [
    # Catalyst, temperature, pressure, catalyst_loading, solvent_ratio, reaction_time, yield, selectivity
    ("Ni", 100, 1.0, 0.05, 0.5, 60, 0.62, 0.88),
    ("Pd", 150, 1.5, 0.1, 0.5, 60, 0.71, 0.85),
    ("Pt", 200, 2.0, 0.1, 1.0, 90, 0.80, 0.82),
    ("Pt", 200, 2.0, 0.1, 1.0, 90, 0.79, 0.83),
    ("Ni", 250, 2.5, 0.15, 1.0, 120, 0.85, 0.78),
    ("V", 250, 2.5, 0.15, 1.0, 120, 0.86, 0.77),
    ("Pt", 300, 3.0, 0.2, 1.5, 120, 0.88, 0.74),
    ("Pt", 150, 1.0, 0.05, 1.0, 90, 0.65, 0.90),
    ("Pd", 200, 1.5, 0.1, 0.5, 120, 0.74, 0.84),
    ("Ni", 250, 2.0, 0.2, 0.5, 60, 0.82, 0.80),
    ("Ni", 300, 2.5, 0.05, 1.0, 60, 0.70, 0.86),
    ("V", 100, 3.0, 0.15, 1.5, 90, 0.58, 0.91),
    ("Ni", 300, 3.0, 0.15, 0.5, 120, 0.85, 0.78),
]
EXAMPLE_SCHEMA = ("Catalyst string, temperature long, pressure double, catalyst_loading double, "
                  "solvent_ratio double, reaction_time long, yield double, selectivity double, row_id long")
FEATURES = ["temperature", "pressure", "catalyst_loading", "solvent_ratio", "reaction_time"]
TARGETS = ["yield", "selectivity"]


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="sifter-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def example(spark):
    rows = [r + (i,) for i, r in enumerate(EXAMPLE)]
    return spark.createDataFrame(rows, EXAMPLE_SCHEMA)


@pytest.fixture(scope="session")
def averaged(example):
    from sifter.operators.replicates import handle_replicates
    return handle_replicates(example, FEATURES, TARGETS, "average").cache()

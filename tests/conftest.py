import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL_SF = "/root/testdata/sf0.001"
CHECK_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetlens.session import get_session
    s = get_session("local[8]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from fleetlens.plans.oracle_check import duckdb_connection
    return duckdb_connection(SMALL_SF)

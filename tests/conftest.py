import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import get_or_create
    s = get_or_create(master="local[*]", shuffle_partitions=8, app_name="tidewater-tests")
    yield s


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)

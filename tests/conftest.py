import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from loomtide.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, spark_ui_enabled="false", spark_driver_memory="4g", spark_sql_adaptive_coalescePartitions_enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    return s

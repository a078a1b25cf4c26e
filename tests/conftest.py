import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from metercast.session import get_session
    s = get_session("local[4]", app="metercast-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="metercast-test-ckpt-"),
                           "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="metercast-test-wh-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    from metercast.sources.catalog import load_catalog
    return load_catalog(spark)

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_spark
    s = get_spark("cohortlens-tests", master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    from cohortlens.sources import Tables
    return Tables(spark, sf_dir)


@pytest.fixture(scope="session")
def frame_of(spark, sf_dir):
    """A registered query's DataFrame by name, made once a session."""
    import __spark_entry__ as E
    made = {}

    def get(name):
        if name not in made:
            made[name] = E.queries()[name](spark, sf_dir)
        return made[name]
    return get

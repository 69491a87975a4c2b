import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import build_session

    session = build_session("local[4]", "plumbline-tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def read(spark):
    from functools import partial

    from plumbline.plans.registry import table

    return partial(table, spark, SF_SMALL)


@pytest.fixture(scope="session", autouse=True)
def package_travels():
    from pyspark import cloudpickle

    import plumbline

    cloudpickle.register_pickle_by_value(plumbline)

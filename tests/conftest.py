import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fuzzrule.session import local_session
    s = local_session(4, 4, memory="8g", app="fuzzrule-tests")
    yield s


@pytest.fixture(scope="session")
def toy(spark):
    from tests.toy import toy_tables
    return toy_tables(spark)


@pytest.fixture(scope="session")
def toy_model(toy):
    from fuzzrule import RuleParams, learn
    return learn(toy[0], RuleParams())

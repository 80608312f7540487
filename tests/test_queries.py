"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

from adit.checks import compare
from adit.checks.oracles import ORACLES
from adit.checks.queries import registered

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, name):
    assert compare.differences(spark, con, name, SF_DIR) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(registered())

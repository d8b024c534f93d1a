"""Every registered query against its SQL at the smallest scale, and the driver contract."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    text, ok = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, text


def test_every_raster_and_request_query_has_sql():
    from inkloom.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert contract.entry(spark).columns == ["plate", "image_id", "pixels", "ink_pixels", "mean_cov", "levels"]

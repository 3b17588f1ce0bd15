"""Queries over scored pairs where no pair has a variance, as when a window holds more events than bins."""

import math

import pytest

from tidewell.operators import binning, testing
from tidewell.plans.basics import a2
from tidewell.plans.catalog import Tables


@pytest.fixture(scope="module")
def tables(spark, data):
    t = Tables(spark, data)
    t.edges = t.edges.where("false")
    return t


def test_no_files_are_no_rows(tables):
    assert a2(tables).collect() == []


def test_no_values_have_no_distribution(tables):
    assert testing.ecdf(tables.edges, 50, value="pval").collect() == []
    assert testing.normal_qq(tables.edges.selectExpr("h AS value"), 0.0, 10.0).collect() == []


def test_shares_of_nothing_are_one_row(tables):
    row, = binning.significant_shares(tables.edges.selectExpr("struct(src_probe, dst_probe) AS probes", "significant")).collect()
    assert row[:4] == (None, None, 0, 0) and math.isnan(row.ratio)

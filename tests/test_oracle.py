"""Every registered query that has SQL against it."""

import os

import pytest

import __spark_entry__ as registered
import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", list(registered.oracle_sql()))
def test_matches_sql(spark, con, name):
    sql = registered.oracle_sql()[name]
    found, _ = compare.difference(spark, con, registered.queries()[name], sql, SF_DIR)
    assert found is None, found


def test_entry_is_the_report(spark):
    report = registered.entry(spark)
    assert report.columns[:2] == ["Tanggal", "TanggalSort"]
    assert report.count() == 4

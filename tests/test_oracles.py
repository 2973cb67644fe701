"""Every registered query beside its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare, database
from sentinela.plans.oracles import ORACLES
from sentinela.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result_as_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None


def test_all_queries_of_the_library_are_checked():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_comparison_notices_differences(spark, con):
    sql = ORACLES["weekly_counts"]
    assert compare(spark, con, SF, QUERIES["weekly_counts"], f"{sql} limit 3")
    assert compare(spark, con, SF, QUERIES["weekly_counts"],
                   f"select site_name, epi_year, epi_week, casos + 1 as casos from ({sql})")
    assert compare(spark, con, SF, QUERIES["weekly_counts"],
                   f"select site_name, epi_year, epi_week, casos::double as casos from ({sql})")

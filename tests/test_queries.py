"""Every registered query next to its SQL."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as contract
from hashmark.catalog import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(spark, con, name, sf_dir) == []


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "team", "season", "week", "offense_form_epa", "offense_form_success", "defense_form_epa", "defense_form_success"
    ]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

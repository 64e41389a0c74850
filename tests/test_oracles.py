"""Every registered query beside its comparison SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import check_oracles

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    return check_oracles.database(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    status, _, note = check_oracles.compare(spark, database, SF, name, entry.queries()[name], ORACLES.get(name))
    assert status in ("ok", "ok-EMPTY", "rows-only"), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "cell_id" and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(entry.queries())

"""Every registered query against its SQL, and the driver contract."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences
from conftest import SF

from veilframe.catalogue.queries import QUERIES


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert differences(entry.queries()[name](spark, SF), entry.oracle_sql()[name], db) == []


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["Name", "ID", "Age", "Postcode", "Gender", "Balance"]
    assert frame.count() > 0

"""Every trade query against its SQL twin, on the smallest tables; those that give text on larger ones too."""

from pathlib import Path

import oracle
import pytest

from bandflow.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert not oracle.difference(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["trade_text", "csv_text", "csv_quoted", "report_json", "norm_spot", "norm_rejects", "asof_spot", "store_analysed"])
def test_query_on_larger_tables(spark, name):
    assert not oracle.difference(catalog.queries()[name](spark, LARGER), oracle.connection(LARGER), catalog.oracle_sql()[name])

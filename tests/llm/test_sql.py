"""The queries that have SQL, against it."""

from pathlib import Path

import oracle
import pytest

from bandflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert not oracle.difference(queries.queries()[name](spark, SF), oracle.connection(SF), queries.ORACLES[name])

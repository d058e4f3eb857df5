from __future__ import annotations

import pytest

from tallyfold.llm import queries
from tests.compare import assert_same, connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.ORACLES[name])

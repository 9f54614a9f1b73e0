from __future__ import annotations

import pytest

from kantar.llm import catalog
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, sf):
    assert differences(spark, catalog.queries()[name], catalog.oracle_sql()[name], f"/root/testdata/{sf}") == []

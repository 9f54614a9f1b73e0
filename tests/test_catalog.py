"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from kantar.plans import catalog
from tests.oracle import differences

WHERE = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLE[name], WHERE) == []


def test_modules_are_imported_without_a_session():
    """The driver reads the list of queries before there is a session."""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, timeout=120)

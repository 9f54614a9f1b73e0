"""Queries against their SQL where the keys of the tables are those of larger ones, so that ids leave the whole numbers of a double."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from kantar.operators import list_log
from kantar.plans import catalog
from kantar.plans.adapters import WIDE
from tests.oracle import differences

WHERE = Path("/root/testdata/sf0.001")
MORE_ORDERS = 800_000
MOST_ORDERS = 9_000_000


def _moved_tables(to, more):
    moved = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    with duckdb.connect() as db:
        for path in WHERE.glob("*.parquet"):
            key = moved.get(path.stem)
            columns = f"* REPLACE ({key} + {more} AS {key})" if key else "*"
            db.execute(f"COPY (SELECT {columns} FROM '{path}') TO '{to / path.name}' (FORMAT parquet)")
    return str(to)


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    return _moved_tables(tmp_path_factory.mktemp("shifted"), MORE_ORDERS)


@pytest.mark.parametrize("name", ["resolve_match", "resolve_match_rejects", "resolve_match_feedback", "price_rejects"])
def test_equals_sql_with_large_keys(spark, shifted, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLE[name], shifted) == []


def test_logs_of_commands_go_on_where_their_ids_would_leave_64_bits(spark, tmp_path):
    """Ten times such a line's id is no long; the fold is the same as with small keys, with ids that differ."""
    far = _moved_tables(tmp_path, MOST_ORDERS)
    for name in ("apply_list_commands", "apply_item_commands", "list_command_rejects"):
        here, there = (catalog.QUERIES[name](spark, where).cache() for where in (str(WHERE), far))
        moved = there.where(f"abs(list_id) >= {MOST_ORDERS}")
        assert (there.count(), moved.count()) == (here.count(), here.count()) and here.count() > 0
        if name == "apply_item_commands":
            assert there.select("item_id").distinct().count() == here.select("item_id").distinct().count()


#: As in tables 360 times sf0.1; such a line's id needs more than 64 bits.
FAR_ORDERS = 54_000_000


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    return _moved_tables(tmp_path_factory.mktemp("far"), FAR_ORDERS)


def _hugeint(sql):
    """The SQL over whole numbers of 128 bits, in which ids fit; nothing else is changed."""
    return sql.replace("((l_orderkey * 1000000", "((CAST(l_orderkey AS HUGEINT) * 1000000").replace("[0]::BIGINT[] AS seen", "[0]::HUGEINT[] AS seen")


@pytest.mark.parametrize("name", [
    "location_options", "location_recommendation", "resolve_match", "resolve_match_feedback", "resolve_match_rejects", "apply_item_commands",
    "retailer_baskets", "apply_list_commands", "basket_recommendation", "list_command_rejects",
])
def test_equals_sql_of_wider_ids_where_ids_leave_64_bits(spark, far, name):
    """The SQL itself ends with an error there; with ids of 128 bits it says what is right."""
    whole = lambda spark, where: (told := catalog.QUERIES[name](spark, where)).select(*[F.col(n).cast("string").alias(n) if t == WIDE else n for n, t in told.dtypes])
    ids = [n for n, t in catalog.QUERIES[name](spark, far).dtypes if t == WIDE]
    sql = f"SELECT * REPLACE ({', '.join(f'{n}::VARCHAR AS {n}' for n in ids)}) FROM ({_hugeint(catalog.ORACLE[name])})" if ids else _hugeint(catalog.ORACLE[name])
    assert differences(spark, whole, sql, far) == []


@pytest.fixture(scope="module")
def list_zero(tmp_path_factory):
    """Tables where order 0 has lines that make a list, twice, and add to it: the new list's number, minus its order's, is the ended list's."""
    to = tmp_path_factory.mktemp("zero")
    told = ", ".join(f"({p}, {n}, {q})" for p, n, q in [(8, 1, 5.0), (20, 2, 5.0), (9, 2, 6.0), (21, 3, 7.0), (45, 2, 1.0)])
    with duckdb.connect() as db:
        for path in WHERE.glob("*.parquet"):
            more = f" UNION ALL SELECT y.* REPLACE (0::BIGINT AS l_orderkey, x.p::BIGINT AS l_partkey, x.n::INT AS l_linenumber, x.q::DOUBLE AS l_quantity) FROM (SELECT * FROM '{path}' LIMIT 1) y, (VALUES {told}) x(p, n, q)"
            db.execute(f"COPY (SELECT * FROM '{path}'{more if path.stem == 'lineitem' else ''}) TO '{to / path.name}' (FORMAT parquet)")
    return str(to)


@pytest.mark.parametrize("name", ["list_command_rejects", "apply_list_commands", "apply_item_commands"])
def test_equals_sql_where_list_zero_is_made_anew(spark, list_zero, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLE[name], list_zero) == []


def test_commands_that_share_a_place_in_the_log_make_one_list(spark):
    row = lambda seq, action, **more: {"seq": seq, "client": "a", "action": action, "list_id": 5, "name": "n"} | more
    log = [row(1, "CREATE"), row(1, "CREATE"), row(2, "CREATE"), row(2, "CREATE"), row(3, "RENAME", client="b")]
    schema = lambda columns: ", ".join(f"{n} {t}" for n, t in columns.items())
    rows = spark.createDataFrame([tuple(r.get(n) for n in list_log.COMMANDS) for r in log], schema(list_log.COMMANDS))
    none = lambda columns: spark.createDataFrame([], schema(columns))
    told = list_log.replay(rows, none(list_log.LISTS), none(list_log.ITEMS), spark.createDataFrame([], "barcode string, canonical_id long"))
    assert [r.list_id for r in told.lists.collect()] == [5]
    assert sorted((r.seq, r.reason) for r in told.rejects.collect()) == [(2, "LIST_EXISTS"), (2, "LIST_EXISTS"), (3, "LIST_NOT_FOUND")]

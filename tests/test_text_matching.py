"""Texts are matched once each, and rows without a key are dealt to all tasks."""

from __future__ import annotations

import datetime as dt
import hashlib
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from kantar.operators import ledger, lists, matching

PRODUCTS = "canonical_id long, name string, brand string, quantity_value decimal(14,4), base_unit string"


@pytest.fixture
def plain(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    had = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in had.items():
        spark.conf.set(k, v)


def _dealt(df, capsys) -> list[str]:
    df.explain()
    return [x.split("hashpartitioning(")[1].split(")")[0] for x in capsys.readouterr().out.splitlines() if "hashpartitioning(" in x]


def test_candidates_are_ranked_once_a_text(plain, capsys):
    """Names alike in similarity share their place in a pool; names behind a whole pool are not looked at."""
    names = ("red cup", "red cap", "Red-Cup", "green cup", "tall glass")
    known = plain.createDataFrame([(n, names[n % 5], f"b{n % 3}", D(n % 4), "g") for n in range(60)], PRODUCTS)
    asked = plain.createDataFrame([(n, ("red cup b1 2 g", "red cu", "Red cup b2", "green  cup", "", None)[n % 6]) for n in range(60)], "query_id long, raw string")
    for pool in (1, 3, 25):
        got = {}
        for r in matching.candidates(asked, known, pool, 4).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.canonical_id, r.score)
        want = {}
        for q, raw in ((r.query_id, r.raw) for r in asked.collect()):
            # Row by row, from the similarity of all names.
            one = plain.createDataFrame([(q, raw)], "query_id long, raw string") if q < 6 else None
            want[q] = _by_hand(one, known, pool, 4) if one else want[q % 6]
        assert got == {q: w for q, w in want.items() if w}
    assert not any(x.startswith("query_id") for x in _dealt(matching.candidates(asked, known), capsys))
    told = {r.query_id: (r.query, r.top_candidate, r.score, r.status) for r in matching.decide_by_text(asked, matching.decide_texts(asked, known)).collect()}
    assert told == {r.query_id: (r.query, r.top_candidate, r.score, r.status) for r in matching.decide(asked, matching.candidates(asked, known)).collect()} and len(told) == 60


def _by_hand(one, known, pool, limit):
    from kantar.functions import similarity as M
    from kantar.functions import text as T

    c = F.col
    query, wanted = T.normalize_name(c("raw")), T.parse_quantity(c("raw"))
    sim = M.similarity(query, T.normalize_name(c("name")))
    rows = one.crossJoin(known).where(sim.cast("double") >= M.TRIGRAM_FLOOR).withColumn("s", M.rounded(sim))
    rows = rows.withColumn("total", M.score(M.name_part(c("s")), M.brand_part(query, c("brand")), M.pack_part(wanted["value"], wanted["unit"], c("quantity_value"), c("base_unit"))))
    pooled = sorted(rows.collect(), key=lambda r: (-r.s, r.name, r.canonical_id))[:pool]
    best = sorted(pooled, key=lambda r: (-r.total, -r.s, r.name, r.canonical_id))[:limit]
    return {k: (r.canonical_id, r.total) for k, r in enumerate(best, 1)}


def test_feedback_without_a_product_is_not_one_key(plain):
    owner = hashlib.sha256(b"ana").hexdigest()
    said = plain.createDataFrame([(n, n + 1, "ana", "CONFIRMED" if n % 4 == 0 else "REJECTED", n if n % 4 == 0 else None, None, dt.datetime(2026, 3, 1)) for n in range(400)],
                                 "said_id long, decision_id long, client string, action string, canonical_id long, note string, at timestamp")
    decisions = plain.createDataFrame([(n + 1, owner) for n in range(400)], "decision_id long, client string")
    products = plain.createDataFrame([(n,) for n in range(0, 200)], "canonical_id long")
    rows = ledger._joined(said.withColumn("owner", F.lit(owner)), decisions, products, "canonical_id", "said_id").cache()
    assert (rows.count(), rows.where("decided").count(), rows.where("exists").count()) == (400, 400, 50)
    bare = rows.where("canonical_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in bare) < 150


def test_items_are_not_multiplied_by_candidates(plain, capsys):
    """A wish is decided once; items, confirmed ones apart, only meet what was decided."""
    known = plain.createDataFrame([(1, "red cup", "Acme", D(5), "g"), (2, "red cup", "Other", D(9), "g"), (3, "red cap", "Acme", D(9), None)], PRODUCTS)
    wishes = [("red cup", "EXACT_PRODUCT", None, None, None, None, None), ("x", "FLEXIBLE_CATEGORY", "red", "Acme", None, D(8), None), ("x", "FLEXIBLE_CATEGORY", "red", "Acme", "g", None, D(8)), ("red cup Acme", "FLEXIBLE_CATEGORY", None, "Other", None, None, None)]
    rows = [(n, name, rule, "CONFIRMED" if n % 10 == 9 else "PENDING", 7, D(1), *rest) for n in range(40) for name, rule, *rest in [wishes[n % 4]]]
    items = plain.createDataFrame(rows, "item_id long, requested_name string, matching_rule string, matching_status string, canonical_id long, score decimal(5,4), category string, required_brand string, required_unit string, min_pack decimal(14,4), max_pack decimal(14,4)")
    told = lists.match_items(items, known)
    got = {r.item_id: (r.matching_status, r.score) for r in told.collect()}
    whole = {k: got[k] for k in range(4)}
    assert len(got) == 40 and got == {n: ("CONFIRMED", D("1.0000")) if n % 10 == 9 else whole[n % 4] for n in range(40)}
    # By name 0.4118; the category with its brand by a part of that, and the brand; a free one by the whole name and the brand.
    assert [s for _, s in whole.values()][0] == D("0.4118") and all(s > D("0.2941") for _, s in list(whole.values())[1:])
    assert not any(x.startswith("item_id") for x in _dealt(told, capsys))


def test_texts_in_sql_are_those_of_a_product(plain, capsys):
    from kantar.plans import catalog

    catalog.QUERIES["prices_in_sql"](plain, "/root/testdata/sf0.001").explain()
    told = capsys.readouterr().out
    assert "regexp_replace" not in told[: told.index("Join")].lower() and "regexp_replace" in told.lower()


def test_price_lists_are_read_once_a_value(spark):
    """Each text is cleaned in a step of its own; odd values come to what the functions of one column say."""
    from kantar.functions import text as T
    from kantar.sources import csv_files

    odd = [None, "", " \u001c", " - ", "n/a", "1.234,50", "1 234,5 ", "12,,3", "x", "31-02-2026", " 01-01-2026\t", "01- 01-2026", "40-01-2026", "0012 "]
    names = list(csv_files.PRICE_COLUMNS)
    raw = spark.createDataFrame([[odd[(k * (j + 1) + j) % len(odd)] for j in range(len(names))] for k in range(60)], ", ".join(f"`{n}` string" for n in names))
    kept = raw.select("*", *[F.col(f"`{n}`").alias(f"was_{v}") for n, v in csv_files.PRICE_COLUMNS.items()])
    told = csv_files.parse_prices(kept, keep=tuple(f"was_{v}" for v in csv_files.PRICE_COLUMNS.values()))[2]
    kinds = {"regular_price": "decimal(12,2)", "discounted_price": "decimal(12,2)", "unit_price": "decimal(14,4)", "vat_rate": "decimal(5,2)"}
    plain = lambda n: T.parse_decimal(F.col(f"was_{n}"), kinds[n]) if n in kinds else T.parse_date(F.col(f"was_{n}")) if n in ("price_date", "discount_start", "discount_end") else T.normalize_barcode(F.col(f"was_{n}")) if n == "barcode" else T.clean_text(F.col(f"was_{n}"))
    same = [F.col(n).eqNullSafe(plain(n)).alias(n) for n in csv_files.PRICE_COLUMNS.values()]
    rows = told.select(*same, "_error").collect()
    assert len(rows) == 60 and all(r[n] for r in rows for n in csv_files.PRICE_COLUMNS.values()) and {"BAD_REGULAR_PRICE", "NO_PRODUCT_NAME", None} <= {r._error for r in rows}
    asked = csv_files.parse_prices(raw)[2]._jdf.queryExecution().optimizedPlan().toString()
    assert asked.count("regexp_replace") < 150, asked.count("regexp_replace")

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from kantar.functions import geo, price, similarity, text
from kantar.functions import sql as in_sql
from kantar.operators import migrations as M
from kantar.operators import read_models as R

c = F.col


def test_known_geodesics(spark):
    deg = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    cases = [
        (deg(-37, 57, 3.72030), deg(144, 25, 29.52440), deg(-37, 39, 10.15610), deg(143, 55, 35.38390), 54_972.271),  # a published pair
        (0.0, 0.0, 90.0, 0.0, 10_001_965.7293), (0.0, 10.0, 0.0, 11.0, 6_378_137 * math.pi / 180), (44.27, 19.88, 44.27, 19.88, 0.0), (-90.0, 0.0, 90.0, 0.0, 2 * 10_001_965.7293), (50.0, -5.0, 50.0, -5.0000001, 0.0072),
    ]
    df = spark.createDataFrame([(k, *map(float, x[:4])) for k, x in enumerate(cases)], "k int, a double, b double, c double, d double")
    got = [r.m for r in df.withColumn("m", geo.spheroid_m(c("a"), c("b"), c("c"), c("d"))).orderBy("k").collect()]
    assert all(abs(g - x[4]) < 0.001 for g, x in zip(got, cases)), got
    odd = spark.createDataFrame([(0.0, 0.0, 0.3, 179.8), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r.m for r in odd.select(geo.spheroid_m(c("a"), c("b"), c("c"), c("d")).alias("m")).collect()] == [None, None]
    near = df.limit(0).sparkSession.createDataFrame([(44.0, 20.0, 44.1, 20.1)], "a double, b double, c double, d double")
    one = near.select(geo.spheroid_m(c("a"), c("b"), c("c"), c("d")).alias("s"), geo.haversine_m(c("a"), c("b"), c("c"), c("d")).alias("g"), geo.kilometres(F.lit(1_234_565.0)).alias("k")).first()
    assert 0 < abs(one.s / one.g - 1) < 0.006 and one.k == Decimal("1234.57")


def test_functions_of_sql_equal_those_of_columns(spark):
    in_sql.register(spark)
    rng = random.Random(3)
    names = ["Mleko 1l", "МЛЕКО 2,8% Ђуђ", "Čokolada 100g×3", "Đak žele", "é ñ ü Ǆ", "", None, "a1b2C3", "Љубав њен Џем", "50 g", "кефир Ѐ"]
    df = spark.createDataFrame([(a, rng.choice(names)) for a in names * 3], "a string, b string")
    df.createOrReplaceTempView("kantar_pairs")
    got = spark.sql("SELECT a, b, kantar_words(a) AS w, kantar_trigrams(a) AS t, kantar_similarity(kantar_words(a), kantar_words(b)) AS s FROM kantar_pairs").collect()
    words = text.normalize_name
    want = df.select("a", "b", words(c("a")).alias("w"), similarity.trigrams(c("a")).alias("t"), similarity.similarity(words(c("a")), words(c("b"))).alias("s")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    days = [None, dt.date(2026, 3, 1), dt.date(2026, 3, 5)]
    rows = [(r, d, a, b, p) for r in (None, Decimal("100.00")) for d in (None, Decimal("80.00")) for a in days for b in days for p in days[1:]]
    df = spark.createDataFrame(rows, "r decimal(12,2), d decimal(12,2), a date, b date, p date")
    df.createOrReplaceTempView("kantar_rows")
    got = spark.sql("SELECT kantar_price_own(r, d, a, b, p) x, kantar_price_as_of(r, d, a, b, p) y, kantar_price_naive(r, d) z, kantar_line_total(r, 1.005) t FROM kantar_rows").collect()
    args = [c(n) for n in "rdabp"]
    want = df.select(price.at_own_date(*args).alias("x"), price.as_of(*args).alias("y"), price.naive(c("r"), c("d")).alias("z"), price.line_total(c("r"), F.lit("1.005").cast("decimal(10,3)")).alias("t")).collect()
    assert got == want and {r.t for r in got} == {None, Decimal("100.50")}
    assert "Python" not in spark.sql("SELECT kantar_words(a) FROM kantar_pairs")._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    stores = [(1, 1, "DEMO-1", True, "Kladovo", None), (2, 1, "S2", True, "Kladovo", None), (3, 2, "DEMO-3", True, "X", " Mini "), (4, 2, "S4", False, "X", "Mini"), (5, 3, "S5", True, "Kladovo", ""), (6, 3, "S6", True, "X", None), (7, 4, None, True, "X", "Mini")]
    items = [(1, "milk", "860", dt.date(2026, 1, 1)), (2, "bread", "999", dt.date(2026, 1, 2)), (3, "salt", None, dt.date(2026, 1, 3))]
    return {
        "stores": spark.createDataFrame(stores, "store_id long, retailer_id long, external_code string, active boolean, city string, format_name string"),
        "retailers": spark.createDataFrame([(1, "EUROPROM"), (2, "OTHER"), (3, "TEKIJANKA"), (4, "FOURTH"), (5, "NO_STORES")], "retailer_id long, retailer_code string"),
        "formats": spark.createDataFrame([(7, 2, "STANDARD", "as it was")], "id long, retailer_id long, code string, name string"),
        "items": spark.createDataFrame(items, "item_id long, name string, barcode string, created_at date"),
        "products": spark.createDataFrame([("860", 70), ("860", 71), (None, 72)], "barcode string, canonical_id long"),
    }


def test_migrations_and_their_repetition(spark):
    tables, version = M.migrate(_tables(spark))
    assert version == 20
    stores = {r.store_id: r for r in tables["stores"].collect()}
    assert {k: r.active for k, r in stores.items()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True, 7: True}
    assert {k: r.format_name for k, r in stores.items()} == {1: None, 2: "Europrom", 3: " Mini ", 4: "Mini", 5: "", 6: None, 7: "Mini"}
    formats = {r.id: (r.retailer_id, r.code, r.name) for r in tables["formats"].collect()}
    assert formats[7] == (2, "STANDARD", "as it was") and min(formats) == 7 and len(formats) == 5 + 3
    legacy = lambda name: "LEGACY-" + __import__("hashlib").md5(name.encode()).hexdigest()[:12].upper()
    assert {k: formats[r.format_id][:2] for k, r in stores.items()} == {
        1: (1, "STANDARD"), 2: (1, legacy("Europrom")), 3: (2, legacy("Mini")), 4: (2, legacy("Mini")), 5: (3, "STANDARD"), 6: (3, "STANDARD"), 7: (4, legacy("Mini"))}
    items = {r.item_id: (r.raw_input, r.matching_rule, r.matching_status, r.canonical_id, str(r.updated_at)) for r in tables["items"].collect()}
    assert items == {1: ("milk", "EXACT_PRODUCT", "CONFIRMED", 70, "2026-01-01"), 2: ("bread", "EXACT_PRODUCT", "PENDING", None, "2026-01-02"), 3: ("salt", "EXACT_PRODUCT", "PENDING", None, "2026-01-03")}
    again, _ = M.migrate(tables)
    for name in tables:
        assert sorted(map(str, again[name].collect())) == sorted(map(str, tables[name].collect())), name
    assert M.migrate(tables, version=20)[1] == 20 and M.migrate(_tables(spark), upto=12)[1] == 12


def test_lists_with_their_items(spark):
    lists = spark.createDataFrame([(1, "one", True), (2, "none", True), (3, "gone", False)], "list_id long, name string, active boolean")
    day = dt.date
    rows = [(12, 1, "b", Decimal(1), "EXACT_PRODUCT", "CONFIRMED", 7, day(2026, 1, 1), "own b"), (11, 1, "a", Decimal(2), "EXACT_PRODUCT", "PENDING", None, day(2026, 1, 2), "own a"), (10, 1, "c", Decimal(1), "EXACT_PRODUCT", "CONFIRMED", 8, day(2026, 1, 1), None), (13, 3, "d", Decimal(1), "EXACT_PRODUCT", "PENDING", None, day(2026, 1, 1), None)]
    items = spark.createDataFrame(rows, "item_id long, list_id long, requested_name string, quantity decimal(10,3), matching_rule string, matching_status string, canonical_id long, created_at date, own_name string")
    products = spark.createDataFrame([(7, "Canon B", None, None, None), (8, None, "Brand", None, None)], "canonical_id long, name string, brand string, quantity_value decimal(14,4), base_unit string")
    got = {r.list_id: [(x.item_id, x.shown_name, x.shown_brand) for x in r["items"]] for r in R.list_with_items(lists, items, products).collect()}
    assert got == {1: [(10, None, "Brand"), (12, "Canon B", None), (11, "own a", None)], 2: []}


def test_details_of_recommendations(spark):
    chosen = spark.createDataFrame([(1, "LOWEST_PRICE", 5, 2, Decimal("9"), Decimal("99"), Decimal("0")), (2, "LOWEST_PRICE", 1, 0, Decimal("0"), Decimal("80"), None)], "list_id long, scenario string, plan int, covered long, basket decimal(18,2), total decimal(18,2), savings decimal(18,2)")
    day = dt.date
    rows = [(1, "LOWEST_PRICE", 3, 20, Decimal("4"), day(2026, 1, 3), "AVAILABLE"), (1, "LOWEST_PRICE", 1, None, None, None, "UNMATCHED"), (1, "LOWEST_PRICE", 2, 30, Decimal("5"), day(2026, 1, 2), "AVAILABLE"), (1, "LOWEST_PRICE", 4, 31, Decimal("1.50"), day(2026, 1, 5), "AVAILABLE"), (2, "LOWEST_PRICE", 9, None, None, None, "NO_VALID_PRICE")]
    results = spark.createDataFrame(rows, "list_id long, scenario string, item_id long, store_id long, line_total decimal(18,2), price_date date, result_status string")
    stores = spark.createDataFrame([(20, "AA"), (30, "ZZ"), (31, "ZZ")], "store_id long, retailer_code string")
    got = {r.list_id: r for r in R.recommendation_details(chosen, results, stores).collect()}
    assert got[1].retailer_codes == ["ZZ", "AA"] and got[1].data_as_of == day(2026, 1, 2) and [x.item_id for x in got[1]["items"]] == [1, 2, 3, 4]
    assert [(r.retailer_code, r.n, r.basket, [x.item_id for x in r["items"]]) for r in got[1].retailers] == [("ZZ", 2, Decimal("6.50"), [2, 4]), ("AA", 1, Decimal("4.00"), [3])]
    assert got[2].retailer_codes == [] and got[2].data_as_of is None and got[2].bought == 0


def test_parameters_of_requests(spark):
    import pytest

    from kantar.operators import plans

    assert plans.Costs().most_stores == 20 and plans.Costs(per_km="0").per_km == "0"
    for wrong in ({"per_km": "-0.01"}, {"per_hour": "NaN"}, {"per_stop": "-1"}, {"km_per_hour": 0.0}, {"km_per_hour": float("inf")}, {"radius_m": -1.0}, {"most_stores": 0}, {"most_stores": 21}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            plans.Costs(**wrong)
    day = dt.date(2026, 3, 1)
    rows = [(1, 44.0, 20.0, day), (2, 90.1, 20.0, day), (3, None, 20.0, day), (4, float("nan"), 20.0, None), (5, -90.0, -180.0, day), (6, 44.0, 180.5, day), (7, 44.0, float("inf"), day), (8, 44.0, 20.0, None), (9, 44.0, 20.0, dt.date(2026, 3, 2))]
    good, rejects = plans.check_requests(spark.createDataFrame(rows, "k int, latitude double, longitude double, as_of date"), F.lit(day))
    assert sorted(r.k for r in good.collect()) == [1, 5]
    assert {r.k: r.reason for r in rejects.collect()} == {2: "LATITUDE", 3: "LATITUDE", 4: "LATITUDE", 6: "LONGITUDE", 7: "LONGITUDE", 8: "DATE_REQUIRED", 9: "DATE_IN_FUTURE"}

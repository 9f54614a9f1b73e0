"""Geocoders' answers, reviews, store lists, strategies with travel, and offers where a store's own price goes first."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from kantar.operators import geocoding, offers, plans
from kantar.operators import stores as S

STATE = (
    "store_id long, address string, city string, geocoding_status string, latitude double, longitude double, candidate_latitude double, candidate_longitude double, "
    "geocoding_query string, geocoding_source string, source_reference string, matched_address string, confidence decimal(5,4), suspicious_reason string, "
    "geocoded_at timestamp, review_note string, reviewed_at timestamp"
)
ANSWER = "answer_id long, store_id long, found_latitude double, found_longitude double, found_confidence decimal(5,4), found_source string, found_reference string, found_address string"
THEN = dt.datetime(2020, 1, 1)


def _now():
    return F.lit("2024-05-06 00:00:00").cast("timestamp")


def _store(spark, **more):
    row = {"store_id": 1, "address": "Karađorđeva 5", "city": "Valjevo", "geocoding_status": "PENDING"} | more
    names = [c.split()[0] for c in STATE.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], STATE)


def test_an_answer_said_again_changes_nothing(spark):
    answer = (1, 1, 44.27, 19.88, D("0.9"), "SURVEY", None, "Karađorđeva 5, Valjevo")
    first, refused = geocoding.submit(_store(spark), spark.createDataFrame([answer], ANSWER), _now())
    [r] = first.collect()
    assert (r.geocoding_status, r.latitude, r.candidate_latitude, r.cached, refused.count()) == ("AUTO_VERIFIED", 44.27, 44.27, False, 0)
    again, _ = geocoding.submit(first.drop("cached"), spark.createDataFrame([answer], ANSWER), F.lit("2030-01-01").cast("timestamp"))
    [s] = again.collect()
    assert s.cached and s.geocoded_at == r.geocoded_at


def test_a_suspicious_answer_takes_the_place_away(spark):
    known = _store(spark, geocoding_status="MANUALLY_VERIFIED", latitude=1.0, longitude=1.0, geocoded_at=THEN, review_note="x", reviewed_at=THEN)
    rows = [(1, 1, 44.0, 19.0, D("0.9"), "SURVEY", None, "Karađorđeva 5, Valjevo"), (2, 1, 44.0, 19.0, D("0.5"), "SURVEY", None, "Karađorđeva 7, Valjevo")]
    [r] = geocoding.submit(known, spark.createDataFrame(rows, ANSWER), _now())[0].collect()
    assert (r.geocoding_status, r.latitude, r.candidate_latitude, r.review_note, r.suspicious_reason) == ("NEEDS_REVIEW", None, 44.0, None, "LOW_CONFIDENCE,HOUSE_NUMBER_MISMATCH")


def test_answers_that_are_refused(spark):
    good = (44.0, 19.0, D("0.9"), "SURVEY", None, "Karađorđeva 5, Valjevo")
    rows = [(1, 9, *good), (2, 1, None, *good[1:]), (3, 1, float("nan"), *good[1:]), (4, 1, *good[:2], None, *good[3:]), (5, 1, *good[:3], " ", *good[4:]), (6, 1, *good[:5], "x" * 501), (7, 1, *good[:4], "r" * 1001, good[5])]
    after, refused = geocoding.submit(_store(spark), spark.createDataFrame(rows, ANSWER), _now())
    assert {r.answer_id: r.reason for r in refused.collect()} == {1: "STORE_NOT_FOUND", 2: "COORDINATES", 3: "COORDINATES", 4: "CONFIDENCE", 5: "SOURCE", 6: "MATCHED_ADDRESS", 7: "REFERENCE"}
    [r] = after.collect()
    assert (r.geocoding_status, r.cached) == ("PENDING", None)


def test_reviews(spark):
    waiting = {"geocoding_status": "NEEDS_REVIEW", "candidate_latitude": 44.0, "candidate_longitude": 19.0}
    known = _store(spark, **waiting).union(_store(spark, store_id=2, **waiting)).union(_store(spark, store_id=3, **waiting)).union(_store(spark, store_id=4))
    rows = [(1, 1, True, None, None, "seen"), (2, 1, False, None, None, "late"), (3, 2, False, None, None, "no"), (4, 3, True, 45.0, None, "half"), (5, 3, False, 45.0, 20.0, "both"), (6, 3, True, 95.0, 20.0, "far"), (7, 4, True, None, None, "x"), (8, 3, True, None, None, " "), (9, 3, None, None, None, "x")]
    reviews = spark.createDataFrame(rows, "review_id long, store_id long, accepted boolean, corrected_latitude double, corrected_longitude double, note string")
    after, refused = geocoding.review(known, reviews, _now())
    assert {r.store_id: (r.geocoding_status, r.latitude) for r in after.collect()} == {1: ("MANUALLY_VERIFIED", 44.0), 2: ("REJECTED", None), 3: ("NEEDS_REVIEW", None), 4: ("PENDING", None)}
    assert {r.review_id: r.reason for r in refused.collect()} == {2: "NOT_IN_REVIEW", 4: "COORDINATES_TOGETHER", 5: "COORDINATES_NOT_ALLOWED", 6: "COORDINATES", 7: "NOT_IN_REVIEW", 8: "NOTE", 9: "ACCEPTED"}


def test_a_store_list_with_coordinates_verifies_places(spark):
    old = _store(spark, source_reference="r", suspicious_reason="CITY_MISMATCH")
    new = old.select("store_id", F.lit(" Nova 1").alias("address"), "city", F.lit(45.0).alias("latitude"), F.lit(20.0).alias("longitude"), F.lit(1).alias("row_number"))
    [r] = geocoding.upsert_located(old, new, ["store_id"], _now()).collect()
    assert (r.geocoding_status, r.latitude, r.candidate_longitude, r.geocoding_query, r.matched_address, r.confidence) == ("MANUALLY_VERIFIED", 45.0, 20.0, "nova 1, valjevo", "Nova 1, Valjevo", D("1.0000"))
    assert (r.source_reference, r.suspicious_reason, r.geocoding_source) == (None, None, "LOCATION_IMPORT")


def test_strategies_of_a_list(spark):
    """Two retailers a kilometre away: together 90 and travel, A alone 100 and travel; C lacks an item and D has no store."""
    step = 1000 / 111_195.0802
    best = spark.createDataFrame([(10, 1, 7, 1, D("40.00"), True), (11, 1, 8, 2, D("50.00"), True)], "item_id long, list_id long, product_id long, retailer_id long, line_total decimal(18,2), available boolean")
    baskets = spark.createDataFrame([(1, 1, "A", 0, True, D("100.00")), (1, 3, "C", 1, False, D("10.00")), (1, 4, "D", 0, True, D("1.00"))], "list_id long, retailer_id long, retailer_code string, missing_items long, complete boolean, total_price decimal(18,2)")
    near = spark.createDataFrame([(5, 1, 100, 0.0, 0.0, step, 0.0), (5, 2, 200, 0.0, 0.0, -step, 0.0)], "user_id long, retailer_id long, store_id long, latitude double, longitude double, to_latitude double, to_longitude double")
    codes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "retailer_id long, retailer_code string")
    options = plans.location_options(best, baskets, spark.createDataFrame([(1, 5)], "list_id long, user_id long"), near, codes)
    told = {r.retailer_code: (str(r.final), r.km, r.route, r.reason, r.recommended) for r in options.collect()}
    assert told == {
        None: ("170.00", 4.0, "A>B", None, False), "A": ("140.00", 2.0, "A", None, True),
        "C": ("None", None, None, "C nema 1 stavki", False), "D": ("None", None, None, "Nedostaje lokacija za D", False),
    }
    assert [tuple(r) for r in plans.location_recommendation(options).collect()] == [(1, "SINGLE_STORE", D("140.00"))]


def test_own_prices_of_a_store_replace_those_of_its_format(spark):
    """Products 1 to 3 serve one category at 5, 6 and 7; store 1 has its own higher prices of 1 and 2."""
    day = dt.date(2024, 1, 1)
    stores = spark.createDataFrame([(1, 1, "F", "Format"), (2, 1, "F", "Format")], "store_id long, retailer_id long, format_code string, format_name string")
    products = spark.createDataFrame([(p, 1, p, None, "Mleko", None, D(1), "ml") for p in (1, 2, 3)], "product_id long, retailer_id long, canonical_id long, barcode string, name string, brand string, quantity_value decimal(14,4), base_unit string")
    rows = [(1, 1, D(5), None, None), (2, 2, D(9), None, None), (3, 2, D(6), " f", None), (4, 3, D(7), None, None), (5, 1, D(20), None, 1), (6, 2, D(8), None, 1)]
    prices = spark.createDataFrame([(i, p, 1, day, c, None, None, None, f, s) for i, p, c, f, s in rows], "price_id long, product_id long, retailer_id long, price_date date, regular_price decimal(12,2), discounted_price decimal(12,2), discount_start date, discount_end date, format_name string, store_id long")
    items = spark.createDataFrame([(50, 9, D(2), "FLEXIBLE_CATEGORY", "PENDING", None, None, "mleko")], "item_id long, list_id long, quantity decimal(10,3), matching_rule string, matching_status string, canonical_id long, barcode string, category string")
    items = items.withColumns({"required_brand": F.lit(None).cast("string"), "required_unit": F.lit(None).cast("string"), "min_pack": F.lit(None).cast("decimal(14,4)"), "max_pack": F.lit(None).cast("decimal(14,4)")})
    pairs = spark.createDataFrame([(9, 1), (9, 2)], "list_id long, store_id long")
    told = offers.store_item_offers(pairs, items, products, prices, stores, F.lit(day))
    assert {r.store_id: (r.product_id, str(r.effective_price), r.price_scope, str(r.line_total)) for r in told.collect()} == {1: (3, "7.00", "RETAILER", "14.00"), 2: (1, "5.00", "RETAILER", "10.00")}


def test_users_and_stores_at_one_place_meet_once(spark):
    """3,000 users and 3,000 stores at three places: the search has a row per place and rank, and everybody gets it."""
    place = lambda n: (42.0 + n % 3 / 1000.0, 19.0)
    users = spark.createDataFrame([(n, *place(n)) for n in range(3000)] + [(-1, None, 19.0)], "user_id long, latitude double, longitude double")
    shops = spark.createDataFrame([(n, n % 2, True, "AUTO_VERIFIED", *place(n)) for n in range(3000)], "store_id long, retailer_id long, active boolean, geocoding_status string, latitude double, longitude double")
    assert S.nearby_places(users, shops).count() == 60
    near = S.nearby(users, shops).select("user_id", "position", "store_id").collect()
    assert len(near) == 60_000 and {(r.position, r.store_id) for r in near if r.user_id == 4} == {(k + 1, 1 + 3 * k) for k in range(20)}
    first = S.nearest(users, shops, 2).select("user_id", "position", "store_id").collect()
    assert len(first) == 6000 and {(r.position, r.store_id) for r in first if r.user_id == 5} == {(1, 2), (2, 5)}
    each = {(r.user_id, r.retailer_id): r.store_id for r in S.nearest_per_retailer(users, shops).collect()}
    assert len(each) == 6000 and (each[3, 0], each[3, 1], each[4, 0], each[4, 1]) == (0, 3, 4, 1)

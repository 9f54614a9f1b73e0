"""Places of stores: geocoders' answers, their review, and store lists with coordinates.

A store's state is ``PLACE`` beside its ``store_id``, ``address`` and ``city``. Each
operator takes many answers at once and returns the stores as they are afterwards;
what is refused comes back with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kantar.functions.text import normalize_name
from kantar.operators import stores as S
from kantar.operators import upsert
from kantar.operators.pricing import first_by

PLACE = [
    "geocoding_status", "latitude", "longitude", "candidate_latitude", "candidate_longitude", "geocoding_query", "geocoding_source",
    "source_reference", "matched_address", "confidence", "suspicious_reason", "geocoded_at", "review_note", "reviewed_at",
]

# The longest texts, and what a store list with coordinates says of its places.
LONGEST = {"matched_address": 500, "source_reference": 1000, "address": 300, "city": 100, "note": 500}
IMPORT_SOURCE = "LOCATION_IMPORT"
IMPORT_NOTE = "Koordinate su potvrđene kroz location import."


def _filled(name: str) -> Column:
    """Is there a text, and is it short enough? Never null."""
    text = F.trim(F.col(name))
    return F.coalesce((text != "") & (F.length(text) <= LONGEST[name]), F.lit(False))


def _inside(name: str, most: float) -> Column:
    """Is there a finite coordinate in range? Never null."""
    return F.coalesce(F.col(name).between(-most, most) & ~F.isnan(name), F.lit(False))


def submit(stores: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(stores after the geocoder's answers with ``cached``, answers refused with ``reason``).

    ``answers``: ``answer_id``, of which the last of a store counts, ``store_id``,
    ``found_latitude``, ``found_longitude``, ``found_confidence``, ``found_source``,
    ``found_reference``, ``found_address``. An answer that says again what the store
    already holds changes nothing (``cached``; null where no answer came). Another one
    becomes the candidate; the store is located by it only if nothing is suspicious,
    and an earlier review no longer counts.
    """
    place = stores.select("store_id", "address", "city", F.lit(True).alias("known"))
    told = answers.join(place, "store_id", "left").withColumn("matched_address", F.col("found_address")).withColumn("source_reference", F.col("found_reference"))
    reason = (
        F.when(F.col("known").isNull(), "STORE_NOT_FOUND")
        .when(~_inside("found_latitude", 90) | ~_inside("found_longitude", 180), "COORDINATES")
        .when(~F.coalesce(F.col("found_confidence").between(0, 1), F.lit(False)), "CONFIDENCE")
        .when(F.coalesce(F.trim("found_source"), F.lit("")) == "", "SOURCE")
        .when(F.length("source_reference") > LONGEST["source_reference"], "REFERENCE")
        .when(~_filled("matched_address"), "MATCHED_ADDRESS")
        .when(~_filled("address") | ~_filled("city"), "STORE_ADDRESS")
    )
    told = told.withColumn("reason", reason)
    refused = told.where("reason IS NOT NULL").select(*answers.columns, "reason")
    last = first_by(told.where("reason IS NULL"), ["store_id"], [F.desc("answer_id")])
    last = last.select("store_id", *[c for c in answers.columns if c.startswith("found_")], F.lit(True).alias("asked"))
    both = stores.join(last, "store_id", "left")
    query = normalize_name(F.concat_ws(", ", "address", "city"))
    confidence = F.col("found_confidence").cast("decimal(5,4)")
    source, reference, matched = F.trim("found_source"), F.nullif(F.trim("found_reference"), F.lit("")), F.trim("found_address")
    pairs = {
        "geocoding_query": query, "geocoding_source": source, "source_reference": reference, "matched_address": matched,
        "confidence": confidence, "candidate_latitude": F.col("found_latitude"), "candidate_longitude": F.col("found_longitude"),
    }
    again = F.col("geocoded_at").isNotNull()
    for name, value in pairs.items():
        again = again & F.col(name).eqNullSafe(value)
    both = both.withColumn("cached", F.when(F.col("asked"), again))
    new = F.coalesce(~F.col("cached"), F.lit(False))
    both = both.withColumn("decided", F.when(new, S.geocoding_decision(confidence, F.col("address"), F.col("city"), matched)))
    good = F.col("decided.status") == "AUTO_VERIFIED"
    pairs |= {
        "geocoding_status": F.col("decided.status"), "suspicious_reason": F.col("decided.reasons"), "geocoded_at": now, "review_note": F.lit(None), "reviewed_at": F.lit(None),
        "latitude": F.when(good, F.col("found_latitude")), "longitude": F.when(good, F.col("found_longitude")),
    }
    return both.select(*[(F.when(new, pairs[c]).otherwise(F.col(c)).alias(c) if c in pairs else F.col(c)) for c in stores.columns], "cached"), refused


def review(stores: DataFrame, reviews: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(stores after the reviews, reviews refused with ``reason``).

    ``reviews``: ``review_id``, of which the first of a store counts (after it nothing
    waits for review), ``store_id``, ``accepted``, ``corrected_latitude``,
    ``corrected_longitude``, ``note``. A place that was accepted takes the corrected
    coordinates, or else those of the candidate; one that was rejected has none.
    """
    told = reviews.join(stores.select("store_id", "geocoding_status"), "store_id", "left")
    has_latitude, has_longitude = F.col("corrected_latitude").isNotNull(), F.col("corrected_longitude").isNotNull()
    reason = (
        F.when(F.col("geocoding_status").isNull(), "STORE_NOT_FOUND")
        .when(F.col("geocoding_status") != "NEEDS_REVIEW", "NOT_IN_REVIEW")
        .when(~_filled("note"), "NOTE")
        .when(F.col("accepted").isNull(), "ACCEPTED")
        .when(has_latitude != has_longitude, "COORDINATES_TOGETHER")
        .when(~F.col("accepted") & has_latitude, "COORDINATES_NOT_ALLOWED")
        .when(has_latitude & (~_inside("corrected_latitude", 90) | ~_inside("corrected_longitude", 180)), "COORDINATES")
    )
    told = told.withColumn("reason", reason)
    passed = first_by(told.where("reason IS NULL"), ["store_id"], ["review_id"]).select("store_id", "review_id", "accepted", "corrected_latitude", "corrected_longitude", F.trim("note").alias("note"))
    late = told.where("reason IS NULL").join(passed.select("store_id", "review_id"), ["store_id", "review_id"], "left_anti").withColumn("reason", F.lit("NOT_IN_REVIEW"))
    refused = told.where("reason IS NOT NULL").unionByName(late).select(*reviews.columns, "reason")
    both = stores.join(passed, "store_id", "left")
    seen, yes = F.col("accepted").isNotNull(), F.coalesce("accepted", F.lit(False))
    after = {
        "geocoding_status": F.when(yes, "MANUALLY_VERIFIED").otherwise("REJECTED"), "review_note": F.col("note"), "reviewed_at": now,
        "latitude": F.when(yes, F.coalesce("corrected_latitude", "candidate_latitude")), "longitude": F.when(yes, F.coalesce("corrected_longitude", "candidate_longitude")),
    }
    return both.select(*[(F.when(seen, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c)) for c in stores.columns]), refused


def review_queue(stores: DataFrame, cities: DataFrame) -> DataFrame:
    """The stores of the given cities that wait for review; case and outer blanks of ``city`` don't count."""
    key = F.lower(F.trim("city"))
    asked = cities.select(key.alias("_city")).distinct()
    return stores.where("geocoding_status = 'NEEDS_REVIEW'").withColumn("_city", key).join(asked, "_city", "left_semi").drop("_city")


def upsert_located(old: DataFrame, new: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """A store list with coordinates over the stored stores: its places count as verified.

    Of several rows with a key the last by ``row_number`` counts.
    """
    address, city = F.trim("address"), F.trim("city")
    place = {
        "geocoding_status": F.lit("MANUALLY_VERIFIED"), "candidate_latitude": F.col("latitude"), "candidate_longitude": F.col("longitude"),
        "geocoding_query": F.concat(F.lower(address), F.lit(", "), F.lower(city)), "geocoding_source": F.lit(IMPORT_SOURCE), "source_reference": F.lit(None).cast("string"),
        "matched_address": F.concat(address, F.lit(", "), city), "confidence": F.lit("1.0000").cast("decimal(5,4)"), "suspicious_reason": F.lit(None).cast("string"),
        "geocoded_at": now, "review_note": F.lit(IMPORT_NOTE), "reviewed_at": now,
    }
    return upsert.upsert(old, new.withColumns({c: v for c, v in place.items() if c in old.columns}), keys, [F.desc("row_number")])


def upsert_formats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Store formats that a list names: new ones are added, known ones renamed and active again. The last by ``row_number`` counts."""
    return upsert.upsert(old, new.withColumn("active", F.lit(True)), ["retailer_id", "format_code"], [F.desc("row_number")])

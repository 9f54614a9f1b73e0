"""Rules that rows of the domain keep, as named boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def price_rules() -> dict[str, Column]:
    return {
        "has_price": c("regular_price").isNotNull() | c("discounted_price").isNotNull(),
        "prices_not_negative": (F.coalesce("regular_price", F.lit(0)) >= 0) & (F.coalesce("discounted_price", F.lit(0)) >= 0),
        "unit_price_not_negative": c("unit_price") >= 0,
        "vat_in_range": c("vat_rate").between(0, 100),
        "discount_days_ordered": c("discount_end") >= c("discount_start"),
    }


def import_rules() -> dict[str, Column]:
    return {
        "selected_of_read": c("rows_selected") <= c("rows_read"),
        "saved_of_selected": c("rows_saved") <= c("rows_selected"),
        "skipped_not_negative": c("rows_skipped") >= 0,
        "known_status": c("status").isin("RUNNING", "SUCCEEDED", "SUCCEEDED_WITH_ERRORS", "FAILED"),
    }


def product_rules() -> dict[str, Column]:
    return {
        "barcode_shaped": c("barcode").rlike("^[0-9]{8,14}$") & ~c("barcode").rlike("^0+$"),
        "quantity_positive": c("quantity_value") > 0,
        "quantity_with_unit": c("quantity_value").isNull() == c("base_unit").isNull(),
        "known_unit": c("base_unit").isin("g", "ml", "piece"),
    }


def decision_rules() -> dict[str, Column]:
    accepted = c("status") == "AUTO_ACCEPTED"
    return {
        "status_fits_score": F.when(accepted, c("score") >= 0.92).when(c("status") == "NEEDS_CONFIRMATION", (c("score") >= 0.75) & (c("score") < 0.92)).otherwise(c("score") < 0.75),
        "accepted_is_top": F.when(accepted, c("matched").eqNullSafe(c("top_candidate"))).otherwise(c("matched").isNull()),
        "no_candidate_no_score": F.when(c("top_candidate").isNull(), c("score") == 0).otherwise(True),
    }


def feedback_rules() -> dict[str, Column]:
    return {"product_if_confirmed": (c("action") == "CONFIRMED") == c("canonical_id").isNotNull()}


def item_rules() -> dict[str, Column]:
    exact = c("matching_rule") == "EXACT_PRODUCT"
    plain = c("category").isNull() & c("required_brand").isNull() & c("required_unit").isNull() & c("min_pack").isNull() & c("max_pack").isNull()
    return {
        "quantity_positive": c("quantity") > 0,
        "exact_is_plain": ~exact | plain,
        "flexible_has_category": exact | c("category").isNotNull(),
        "pack_range_ordered": c("min_pack") <= c("max_pack"),
    }


def store_rules() -> dict[str, Column]:
    applied = c("latitude").isNotNull() & c("longitude").isNotNull()
    return {
        "review_has_no_location": ~c("geocoding_status").isin("NEEDS_REVIEW", "REJECTED") | (c("latitude").isNull() & c("longitude").isNull()),
        "verified_has_location": ~c("geocoding_status").isin("AUTO_VERIFIED", "MANUALLY_VERIFIED") | applied,
        "reviewed_after_geocoded": c("geocoding_reviewed_at") >= c("geocoded_at"),
    }

"""Matching the items of lists, and what users answer to it.

Items of all lists are worked on together: candidates are looked up once for each
distinct text, however many items ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kantar.functions import similarity as M
from kantar.functions.text import normalize_name
from kantar.operators import matching
from kantar.operators.pricing import first_by
from kantar.sources.sinks import staged

# What an item says of its match, by rule and status.
FLEXIBLE_SENTENCES = {
    "AUTO_MATCHED": "Fleksibilna kategorija ima automatski predlog; optimizator i dalje sme da izabere jeftiniji proizvod koji ispunjava ograničenja.",
    "NEEDS_CONFIRMATION": "Kandidati su prikazani, ali fleksibilna stavka može da se optimizuje po zadatim ograničenjima.",
    "UNMATCHED": "Nema kanonskog kandidata; fleksibilna kategorija ostaje vidljiva i proverava se među ponudama trgovaca.",
}
FLEXIBLE_OTHERWISE = "Fleksibilna stavka je spremna."
EXACT_SENTENCES = {
    "AUTO_MATCHED": "Proizvod je automatski povezan.",
    "NEEDS_CONFIRMATION": "Potrebna je potvrda kandidata pre optimizacije.",
    "UNMATCHED": "Proizvod nije uparen i neće biti sakriven iz rezultata.",
    "CONFIRMED": "Proizvod je potvrđen.",
    "PENDING": "Uparivanje još nije pokrenuto.",
}
ALREADY = "Proizvod je već potvrđen."


def _flexible() -> Column:
    return F.col("matching_rule") == "FLEXIBLE_CATEGORY"


def asked_text() -> Column:
    """What an item is looked up by: its name, or category, brand and (where it is one) pack size."""
    size = M._number(F.col("min_pack"))
    one = (F.col("min_pack") == F.col("max_pack")) & F.col("required_unit").isNotNull()
    return F.when(_flexible() & F.col("category").isNotNull(), F.concat_ws(" ", "category", "required_brand", F.when(one, size), F.when(one, F.col("required_unit")))).otherwise(F.col("requested_name"))


def meets_constraints(brand: Column, unit: Column, quantity: Column) -> Column:
    """Does a candidate meet the constraints of a flexible item? What is not set is met; an unknown size meets no bound."""
    return (
        (F.col("required_brand").isNull() | (normalize_name(F.col("required_brand")) == normalize_name(brand)))
        & (F.col("required_unit").isNull() | F.coalesce(unit == F.col("required_unit"), F.lit(False)))
        & (F.col("min_pack").isNull() | F.coalesce(quantity >= F.col("min_pack"), F.lit(False)))
        & (F.col("max_pack").isNull() | F.coalesce(quantity <= F.col("max_pack"), F.lit(False)))
    )


def explanation() -> Column:
    """The sentence of an item's rule and status."""
    status = F.col("matching_status")
    one = lambda told, otherwise: F.coalesce(*[F.when(status == k, v) for k, v in told.items()], F.lit(otherwise))
    return F.when(_flexible(), one(FLEXIBLE_SENTENCES, FLEXIBLE_OTHERWISE)).otherwise(one(EXACT_SENTENCES, None))


def match_items(items: DataFrame, products: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Every item with its status, product, score, whether it blocks the plans of its list, and why.

    ``items``: ``item_id``, ``requested_name``, rule, status, ``canonical_id``, ``score``
    and the constraints; with ``feedback`` (see ``matching.decide``) also ``client``.
    Confirmed items stay as they are. A flexible item takes the first of its candidates
    that meets the constraints; a client's earlier answers count for exact items only.
    """
    free = F.coalesce(~_flexible() | F.col("category").isNull(), F.lit(False))
    constraints = ("required_brand", "required_unit", "min_pack", "max_pack")
    # What decides an item's match, nulls among it; many items share one.
    wish = F.struct("raw", free.alias("free"), *[F.when(~free, F.col(n)).alias(n) for n in constraints])
    open_items = items.where("matching_status <> 'CONFIRMED'").withColumn("raw", asked_text()).withColumn("wish", wish)
    wishes = staged(open_items.select("wish").distinct(), "list-wishes")
    found = matching.text_candidates(wishes.select("wish.raw"), products).select(
        "raw", "rank", F.col("canonical_id").alias("candidate"), F.col("score").alias("candidate_score"), F.col("brand").alias("_brand"), F.col("base_unit").alias("_unit"), F.col("quantity_value").alias("_quantity")
    )
    fits = F.col("free") | meets_constraints(F.col("_brand"), F.col("_unit"), F.col("_quantity"))
    top = first_by(wishes.select("wish", "wish.*").join(found, "raw").where(fits), ["wish"], ["rank"]).select("wish", "candidate", "candidate_score")
    decided = wishes.join(top, "wish", "left").withColumn("decided", M.decision(F.col("candidate_score")))
    decided = decided.withColumn("found", F.when(F.col("decided") == "AUTO_ACCEPTED", F.col("candidate"))).withColumn("new_score", F.coalesce("candidate_score", F.lit(0)).cast("decimal(5,4)"))
    # Written: its size tells Spark whether items must be shuffled to it.
    told = open_items.join(staged(decided, "list-decided"), "wish")
    if feedback is not None:
        last = first_by(feedback, ["client", "query"], [F.desc("feedback_id")]).select("client", "query", "action", F.col("canonical_id").alias("chosen"))
        told = told.withColumn("query", normalize_name(F.col("raw"))).join(last, ["client", "query"], "left")
        yes, no = (~_flexible() & (F.col("action") == a) for a in ("CONFIRMED", "REJECTED"))
        told = told.withColumns({
            "decided": F.when(yes, "AUTO_ACCEPTED").when(no, "UNMATCHED").otherwise(F.col("decided")),
            "found": F.when(yes, F.col("chosen")).when(no, F.lit(None)).otherwise(F.col("found")),
            "new_score": F.when(yes, F.lit(1)).when(no, F.lit(0)).otherwise(F.col("new_score")).cast("decimal(5,4)"),
        })
    status = F.when(F.col("decided") == "AUTO_ACCEPTED", "AUTO_MATCHED").otherwise(F.col("decided"))
    columns = ["item_id", "matching_rule", "matching_status", "canonical_id", "score", "blocks", "explanation"]
    matched = told.select("item_id", "matching_rule", status.alias("matching_status"), F.col("found").alias("canonical_id"), F.col("new_score").alias("score"))
    blocks = (F.col("matching_rule") == "EXACT_PRODUCT") & (F.col("matching_status") == "NEEDS_CONFIRMATION")
    matched = matched.withColumn("blocks", blocks).withColumn("explanation", explanation()).select(*columns)
    kept = items.where("matching_status = 'CONFIRMED'").select("item_id", "matching_rule", "matching_status", "canonical_id", F.col("score").cast("decimal(5,4)").alias("score"), F.lit(False).alias("blocks"), F.lit(ALREADY).alias("explanation"))
    return matched.unionByName(kept)

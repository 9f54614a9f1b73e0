"""Changes of stored tables from one version to the next.

Each step takes the tables by name and gives them back changed. A step looks only at
what is not changed yet, so carrying it out again leaves the tables as they are.
Updates from another table are joins on distinct keys; look-ups with a fall-back are two joins
and a coalesce; a condition on other rows of a table is a semi join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kantar.operators.pricing import first_by
from kantar.sources.imports import number_new
from kantar.sources.sinks import staged

Tables = dict[str, DataFrame]

# Names of formats and what they hang on.
DEMO = "DEMO-%"
STANDARD, STANDARD_NAME, LEGACY = "STANDARD", "Standardni format", "LEGACY-"
FORMAT_NAMES = (("EUROPROM", None, "Europrom"), ("TEKIJANKA", "Kladovo", "TEKIJANKA D.O.O. TEKIJA Kladovo"))

c = F.col


def deactivate_demo_stores(tables: Tables) -> Tables:
    """Demo stores of a retailer end where it has a real active store.

    ``stores``: ``retailer_id``, ``external_code``, ``active``.
    """
    stores = tables["stores"]
    demo = F.coalesce(c("external_code").like(DEMO), F.lit(False))
    real = stores.where(c("active") & c("external_code").isNotNull() & ~demo).select("retailer_id", F.lit(True).alias("_real")).distinct()
    told = stores.join(real, "retailer_id", "left")
    return {**tables, "stores": told.withColumn("active", c("active") & ~(demo & c("_real").isNotNull())).select(*stores.columns)}


def name_store_formats(tables: Tables) -> Tables:
    """Stores of two retailers get the name of their price list's format; a name that is there stays.

    ``stores`` gains ``format_name``; ``retailers``: ``retailer_id``, ``retailer_code``.
    """
    stores = tables["stores"]
    if "format_name" not in stores.columns:
        stores = stores.withColumn("format_name", F.lit(None).cast("string"))
    codes = tables["retailers"].select("retailer_id", "retailer_code")
    real = ~F.coalesce(c("external_code").like(DEMO), F.lit(True))
    names = [F.when((c("retailer_code") == code) & real & (F.lit(True) if city is None else c("city") == city), name) for code, city, name in FORMAT_NAMES]
    told = stores.join(codes, "retailer_id", "left").withColumn("format_name", F.coalesce("format_name", *names))
    return {**tables, "stores": told.select(*stores.columns)}


def legacy_code(name: Column) -> Column:
    """The code of a format that only had a name."""
    return F.concat(F.lit(LEGACY), F.upper(F.substring(F.md5(F.trim(name)), 1, 12)))


def split_out_formats(tables: Tables) -> Tables:
    """Formats become a table: a standard one for each retailer and one for each name in use; stores refer to theirs by id.

    A store gets the format of its name, else its retailer's standard one. New formats are
    numbered after those that ``formats`` (``id``, ``retailer_id``, ``code``, ``name``) has.
    """
    stores = tables["stores"]
    if "format_id" not in stores.columns:
        stores = stores.withColumn("format_id", F.lit(None).cast("long"))
    known = tables["formats"].select("id", "retailer_id", "code", "name")
    named = F.nullif(F.trim("format_name"), F.lit("")).isNotNull()
    wanted = tables["retailers"].select("retailer_id", F.lit(STANDARD).alias("code"), F.lit(STANDARD_NAME).alias("name")).unionByName(
        stores.where(named).select("retailer_id", legacy_code(c("format_name")).alias("code"), F.trim("format_name").alias("name"))
    )
    fresh = first_by(wanted.join(known, ["retailer_id", "code"], "left_anti"), ["retailer_id", "code"], ["name"])
    numbered = number_new(staged(fresh, "formats-new"), known, ["retailer_id", "code"], ["retailer_id", "code"])
    formats = staged(known.unionByName(numbered.select(*known.columns)), "formats")
    own = formats.select("retailer_id", c("code").alias("_own"), c("id").alias("_own_id"))
    standard = formats.where(c("code") == STANDARD).select("retailer_id", c("id").alias("_standard_id"))
    told = stores.withColumn("_own", F.when(named, legacy_code(c("format_name")))).join(own, ["retailer_id", "_own"], "left").join(standard, "retailer_id", "left")
    placed = told.withColumn("format_id", F.coalesce("format_id", "_own_id", "_standard_id")).select(*stores.columns)
    return {**tables, "stores": placed, "formats": formats}


def open_items_to_matching(tables: Tables) -> Tables:
    """Items get what matching needs; those whose barcode is a product's are confirmed, others wait.

    ``items`` gains ``raw_input``, ``matching_rule``, ``matching_status``, ``canonical_id`` and
    ``updated_at``; items that have a status stay. ``products``: ``barcode``, ``canonical_id``.
    """
    items = tables["items"]
    added = {"raw_input": "string", "matching_rule": "string", "matching_status": "string", "canonical_id": "long", "updated_at": items.schema["created_at"].dataType}
    for name, kind in added.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    codes = first_by(tables["products"].where("barcode IS NOT NULL"), ["barcode"], ["canonical_id"]).select("barcode", c("canonical_id").alias("_product"))
    told = items.join(codes, "barcode", "left")
    new = c("matching_status").isNull()
    settled = told.withColumns({
        "raw_input": F.coalesce("raw_input", "name"), "matching_rule": F.coalesce("matching_rule", F.lit("EXACT_PRODUCT")), "updated_at": F.coalesce("updated_at", "created_at"),
        "canonical_id": F.when(new, c("_product")).otherwise(c("canonical_id")),
        "matching_status": F.when(new, F.when(c("_product").isNotNull(), "CONFIRMED").otherwise("PENDING")).otherwise(c("matching_status")),
    })
    return {**tables, "items": settled.select(*items.columns)}


@dataclass(frozen=True)
class Step:
    version: int
    change: Callable[[Tables], Tables]
    writes: tuple[str, ...]


STEPS = (
    Step(10, deactivate_demo_stores, ("stores",)),
    Step(12, name_store_formats, ("stores",)),
    Step(18, split_out_formats, ("stores", "formats")),
    Step(20, open_items_to_matching, ("items",)),
)


def migrate(tables: Tables, version: int = 0, upto: int | None = None) -> tuple[Tables, int]:
    """(tables, version) after the steps over ``version``; what a step writes is written before the next one reads it."""
    for step in STEPS:
        if step.version > version and (upto is None or step.version <= upto):
            tables = step.change(tables)
            tables = {n: staged(t, f"migrated-{step.version}-{n}") if n in step.writes else t for n, t in tables.items()}
            version = step.version
    return tables, version

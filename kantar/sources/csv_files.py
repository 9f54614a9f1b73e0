"""Price lists and store directories in CSV: reading, checking, rejects.

Files are read by Spark with every column as text. A row that breaks the contract
keeps its raw text and the first reason; nothing is dropped in silence but the
price rows that the contract drops (those without any price).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kantar.functions import text as T
from kantar.sources.sinks import staged

# Column names of the two file contracts.
PRICE_COLUMNS = {
    "KATEGORIJA": "category_code",
    "NAZIV KATEGORIJE": "category_name",
    "Naziv proizvoda": "product_name",
    "Robna marka": "brand",
    "Barkod proizvoda": "barcode",
    "Jedinica mere": "unit",
    "Naziv trgovca - formata*": "format_name",
    "Redovna cena": "regular_price",
    "Snižena cena": "discounted_price",
    "Datum cenovnika": "price_date",
    "Cena po jedinici mere": "unit_price",
    "Datum početka sniženja": "discount_start",
    "Datum kraja sniženja": "discount_end",
    "Stopa PDV": "vat_rate",
}
STORE_REQUIRED = ("external_code", "name", "address", "city", "active")
STORE_PAIRS = (("latitude", "longitude"), ("store_format_code", "store_format_name"))


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Semicolons, a header in any case, quotes doubled inside quotes, blanks around values ignored.

    ``_raw_short`` marks rows with fewer fields than the header, which Spark fills
    with nulls, so that they can be told from rows with empty fields.
    """
    options = {"sep": ";", "header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "enforceSchema": "true"}
    header = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in header) + ", _broken string"
    rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").schema(schema).csv(path)
    return rows.withColumn("_raw_short", F.col("_broken").isNotNull()).drop("_broken")


def first_rows(raw: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of the files in the order of their names and of their rows, however they are split.

    Spark numbers rows by partition, and partitions of a scan need not follow the files. So the
    rows of each piece of a file are counted, pieces are put in order by file and offset, and
    a row's number is its place in its piece and the rows of the pieces before. Only the counts
    are gathered, one for each piece; no task sorts all rows.
    """
    piece = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    # The identifier rises along a piece.
    rows = staged(raw.select("*", piece.alias("_piece"), F.monotonically_increasing_id().alias("_id")), "csv-rows")
    held = rows.groupBy("_piece").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each piece of a file.
    starts = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n).drop("_n")
    # Identifiers of a piece follow each other without a gap, so the difference is the place.
    return rows.join(F.broadcast(starts), "_piece").where(F.col("_before") + F.col("_id") - F.col("_least") < n).select(*raw.columns)


def _renamed(raw: DataFrame, wanted: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    found = {c.strip().lower(): c for c in raw.columns}
    missing = [w for w in wanted if w.lower() not in found]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    kept = [F.col(f"`{found[w.lower()]}`").alias(n) for w, n in wanted.items()]
    short = F.col("_raw_short") if "_raw_short" in raw.columns else F.lit(False)
    return raw.select(*kept, *[F.col(f"`{k}`") for k in keep], short.alias("_short"))


def _first(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for broken, reason in reversed(checks):
        out = F.when(broken, reason).otherwise(out)
    return out


def parse_prices(raw: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prices, rejects, all rows parsed with ``_error`` and ``_priced``); columns of ``keep`` go along.

    The order of the checks is that of the contract: a row without any price is
    left out before its day is looked at, and is no reject.
    """
    rows = _renamed(raw, PRICE_COLUMNS, keep)
    money = {"regular_price": "decimal(12,2)", "discounted_price": "decimal(12,2)", "unit_price": "decimal(14,4)", "vat_rate": "decimal(5,2)"}
    days = ("price_date", "discount_start", "discount_end")
    # Texts are cleaned, and numbers and days read, in steps of their own: checks and results ask for them more than once.
    clean = rows.withColumns({n: T.clean_text(F.col(n)) for n in PRICE_COLUMNS.values()})
    read = clean.withColumns({f"_n_{n}": T.clean_decimal(F.col(n), "decimal(24,6)") for n in money} | {f"_d_{n}": T.clean_date(F.col(n)) for n in days})
    wrong_number = lambda n: T.clean_decimal_is_wrong(F.col(n), F.col(f"_n_{n}"))
    wrong_day = lambda n: F.col(n).isNotNull() & F.col(f"_d_{n}").isNull()
    priced = F.col("_n_regular_price").isNotNull() | F.col("_n_discounted_price").isNotNull()
    error = _first(
        (F.col("_short"), "SHORT_ROW"),
        (F.col("product_name").isNull(), "NO_PRODUCT_NAME"),
        (F.col("format_name").isNull(), "NO_FORMAT_NAME"),
        (wrong_number("regular_price"), "BAD_REGULAR_PRICE"),
        (wrong_number("discounted_price"), "BAD_DISCOUNTED_PRICE"),
        (~priced, None),
        (F.col("price_date").isNull(), "NO_PRICE_DATE"),
        (wrong_day("price_date"), "BAD_PRICE_DATE"),
        (wrong_number("unit_price"), "BAD_UNIT_PRICE"),
        (wrong_day("discount_start"), "BAD_DISCOUNT_START"),
        (wrong_day("discount_end"), "BAD_DISCOUNT_END"),
        (wrong_number("vat_rate"), "BAD_VAT_RATE"),
    )
    parsed = read.withColumns({"_error": error, "_priced": priced}).withColumns(
        {n: T.clean_decimal(F.col(n), k) for n, k in money.items()} | {n: F.col(f"_d_{n}") for n in days} | {"barcode": T.normalize_barcode(F.col("barcode"))}
    )
    key = T.source_product_key(*[F.col(c) for c in ("barcode", "product_name", "brand", "unit", "category_code")])
    parsed = parsed.withColumn("source_product_key", key).drop("_short", *[f"_n_{n}" for n in money], *[f"_d_{n}" for n in days])
    return *split_parsed(parsed), parsed


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices, rejects) of parsed rows."""
    good = parsed.where("_error IS NULL AND _priced").drop("_error", "_priced")
    return good, parsed.where("_error IS NOT NULL").drop("_priced")


def parse_stores(raw: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(stores, rejects). Optional columns come in pairs, and so do their values.

    Without a format the store is of the format STANDARD. With coordinates it counts
    as verified by hand, with full confidence.
    """
    names = {c.strip().lower() for c in raw.columns}
    missing = [c for c in STORE_REQUIRED if c not in names]
    halves = [p for p in STORE_PAIRS if len(names & set(p)) == 1]
    if missing or halves:
        raise ValueError(f"columns are missing: {missing or halves}")
    if max_rows is not None:
        if not 1 <= max_rows <= 10_000:
            raise ValueError("max_rows is from 1 to 10000")
        raw = first_rows(raw, max_rows)
    optional = [c for p in STORE_PAIRS for c in p]
    present = [c for c in optional if c in names]
    rows = _renamed(raw, {c: c for c in [*STORE_REQUIRED, *present]}).withColumns({c: F.lit(None).cast("string") for c in optional if c not in names})
    lat, lon = T.clean_text(F.col("latitude")), T.clean_text(F.col("longitude"))
    code, label = T.clean_text(F.col("store_format_code")), T.clean_text(F.col("store_format_name"))
    error = _first(
        (F.col("_short"), "SHORT_ROW"),
        *[(T.clean_text(F.col(c)).isNull(), f"NO_{c.upper()}") for c in ("external_code", "name", "address", "city")],
        (T.parse_active(F.col("active")).isNull(), "BAD_ACTIVE"),
        (lat.isNull() != lon.isNull(), "HALF_A_PLACE"),
        (lat.isNotNull() & (T.parse_coordinate(lat, 90).isNull() | T.parse_coordinate(lon, 180).isNull()), "BAD_PLACE"),
        (code.isNull() != label.isNull(), "HALF_A_FORMAT"),
        (code.isNotNull() & T.format_code(code).isNull(), "BAD_FORMAT_CODE"),
    )
    parsed = rows.withColumn("_error", error).select(
        *[T.clean_text(F.col(c)).alias(c) for c in ("external_code", "name", "address", "city")],
        T.parse_active(F.col("active")).alias("active"),
        T.parse_coordinate(lat, 90).alias("latitude"),
        T.parse_coordinate(lon, 180).alias("longitude"),
        F.coalesce(T.format_code(code), F.lit("STANDARD")).alias("format_code"),
        F.coalesce(label, F.lit("Standard")).alias("format_name"),
        F.when(lat.isNotNull(), "MANUALLY_VERIFIED").otherwise("PENDING").alias("geocoding_status"),
        F.when(lat.isNotNull(), F.lit(1)).cast("decimal(5,4)").alias("geocoding_confidence"),
        "_error",
    )
    return parsed.where("_error IS NULL").drop("_error"), parsed.where("_error IS NOT NULL")

"""Queries on prices and baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.functions import price
from kantar.operators import pricing
from kantar.plans import adapters as A
from kantar.plans.adapters import AS_OF, DOMAIN_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its name, with its SQL over the domain views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = DOMAIN_SQL + sql
        return f

    return add


def money(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("double").alias(alias or name)


def text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def day() -> Column:
    return F.lit(AS_OF).cast("date")


@query("SELECT product_id, price_id, CAST(price_date AS VARCHAR) AS price_date, CAST(regular_price AS DOUBLE) AS regular_price, CAST(own_price AS DOUBLE) AS effective_price FROM v_latest")
def latest_price_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = pricing.latest(A.prices(spark, sf_dir)).withColumn("effective_price", pricing.own_date_price())
    return newest.select("product_id", "price_id", text("price_date"), money("regular_price"), money("effective_price"))


@query("SELECT price_id, CAST(own_price AS DOUBLE) AS effective_price FROM v_own")
def effective_price_at_own_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prices(spark, sf_dir).withColumn("effective_price", pricing.own_date_price()).select("price_id", money("effective_price"))


@query(f"SELECT price_id, CAST(as_of_price AS DOUBLE) AS effective_price FROM v_own WHERE price_date <= DATE '{AS_OF}'")
def effective_price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.prices(spark, sf_dir).where(F.col("price_date") <= day())
    return known.withColumn("effective_price", pricing.as_of_price(day())).select("price_id", money("effective_price"))


@query("SELECT price_id, CAST(naive_price AS DOUBLE) AS effective_price FROM v_own")
def effective_price_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.prices(spark, sf_dir).withColumn("effective_price", price.naive(F.col("regular_price"), F.col("discounted_price")))
    return known.select("price_id", money("effective_price"))


BEST_SQL = """, v_best AS (
  SELECT barcode, product_id, retailer_id, price_date, own_price
  FROM v_product JOIN (SELECT product_id, price_date, own_price FROM v_latest) USING (product_id)
  QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY own_price NULLS LAST, product_id) = 1
), v_item_price AS (
  SELECT i.item_id, i.list_id, b.product_id, b.retailer_id, b.price_date, b.own_price,
    CAST(round(b.own_price * i.quantity, 2) AS DECIMAL(18,2)) AS line_total
  FROM v_item i LEFT JOIN v_best b USING (barcode)
), v_totals AS (
  SELECT list_id, count(*) AS total_items, count(own_price) AS matched_items, count(*) - count(own_price) AS unmatched_items,
    coalesce(sum(line_total), 0) AS total_price, count(DISTINCT CASE WHEN own_price IS NOT NULL THEN retailer_id END) AS used_retailers
  FROM v_item_price GROUP BY list_id
)"""


@query(BEST_SQL + """
SELECT item_id, list_id, product_id, retailer_id, CAST(price_date AS VARCHAR) AS price_date,
  CAST(own_price AS DOUBLE) AS effective_price, CAST(line_total AS DOUBLE) AS line_total, own_price IS NOT NULL AS available FROM v_item_price""")
def best_price_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = pricing.best_price_per_item(A.items(spark, sf_dir), A.products(spark, sf_dir), A.prices(spark, sf_dir))
    return best.select("item_id", "list_id", "product_id", "retailer_id", text("price_date"), money("effective_price"), money("line_total"), "available")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.totals(pricing.best_price_per_item(A.items(spark, sf_dir), A.products(spark, sf_dir), A.prices(spark, sf_dir)))


@query(BEST_SQL + "SELECT list_id, total_items, matched_items, unmatched_items, CAST(total_price AS DOUBLE) AS total_price, used_retailers FROM v_totals")
def best_price_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).withColumn("total_price", money("total_price"))


BASKET_SQL = """, v_offer AS (
  SELECT barcode, retailer_id, own_price FROM v_product JOIN (SELECT product_id, own_price FROM v_latest) USING (product_id)
  QUALIFY row_number() OVER (PARTITION BY barcode, retailer_id ORDER BY own_price NULLS LAST, product_id) = 1
), v_had AS (
  SELECT list_id, retailer_id, count(*) AS matched, sum(CAST(round(own_price * quantity, 2) AS DECIMAL(18,2))) AS total
  FROM v_item JOIN v_offer USING (barcode) WHERE own_price IS NOT NULL GROUP BY ALL
), v_size AS (SELECT list_id, count(*) AS total_items FROM v_item GROUP BY list_id
), v_basket AS (
  SELECT list_id, retailer_id, retailer_code, coalesce(matched, 0) AS matched_items, total_items - coalesce(matched, 0) AS missing_items,
    coalesce(matched, 0) = total_items AS complete, coalesce(total, 0) AS total_price
  FROM v_size CROSS JOIN v_retailer LEFT JOIN v_had USING (list_id, retailer_id)
), v_single AS (
  SELECT * FROM v_basket WHERE complete QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY total_price, retailer_code) = 1
)"""


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.retailer_baskets(A.items(spark, sf_dir), A.products(spark, sf_dir), A.prices(spark, sf_dir), A.retailers(spark, sf_dir))


@query(BASKET_SQL + "SELECT * REPLACE (CAST(total_price AS DOUBLE) AS total_price) FROM v_basket")
def retailer_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baskets(spark, sf_dir).withColumn("total_price", money("total_price"))


@query(BASKET_SQL + "SELECT list_id, retailer_code, CAST(total_price AS DOUBLE) AS total_price FROM v_single")
def best_single_retailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.best_single_retailer(_baskets(spark, sf_dir)).select("list_id", "retailer_code", money("total_price"))


@query(BEST_SQL + BASKET_SQL + """
SELECT list_id, CAST(t.total_price AS DOUBLE) AS total_price, s.retailer_code AS single_retailer, CAST(s.total_price AS DOUBLE) AS single_price,
  CAST(s.total_price - t.total_price AS DOUBLE) AS savings,
  CASE WHEN unmatched_items > 0 THEN 'SELECT_PRODUCTS' WHEN s.total_price IS NULL THEN 'MULTI_STORE_REQUIRED'
    WHEN used_retailers <= 1 OR s.total_price - t.total_price <= 0 THEN 'SINGLE_STORE' ELSE 'COMPARE_TRAVEL_COST' END AS recommendation
FROM v_totals t LEFT JOIN v_single s USING (list_id)""")
def basket_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    advised = pricing.recommendation(_totals(spark, sf_dir), pricing.best_single_retailer(_baskets(spark, sf_dir)))
    return advised.select("list_id", money("total_price"), "single_retailer", money("single_price"), money("savings"), "recommendation")


SCOPED_SQL = f""", v_scoped AS (
  SELECT s.store_id, p.product_id, p.canonical_id, p.retailer_id, p.price_date, p.as_of_price,
    CASE WHEN p.store_id = s.store_id THEN 1 WHEN p.store_id IS NULL AND trim(coalesce(p.format_name, '')) <> '' THEN 2 ELSE 3 END AS scope
  FROM v_own p JOIN v_store s USING (retailer_id)
  WHERE p.price_date <= DATE '{AS_OF}' AND p.as_of_price IS NOT NULL
    AND (p.store_id = s.store_id
      OR (p.store_id IS NULL AND (trim(coalesce(p.format_name, '')) = '' OR lower(trim(p.format_name)) IN (lower(s.format_name), lower(s.format_code)))))
  QUALIFY row_number() OVER (PARTITION BY s.store_id, p.product_id ORDER BY scope, p.price_date DESC, p.price_id DESC) = 1
)"""
SCOPE_NAME = "CASE scope WHEN 1 THEN 'STORE' WHEN 2 THEN 'STORE_FORMAT' ELSE 'RETAILER' END"


@query(SCOPED_SQL + f"SELECT store_id, product_id, CAST(price_date AS VARCHAR) AS price_date, CAST(as_of_price AS DOUBLE) AS effective_price, {SCOPE_NAME} AS price_scope FROM v_scoped")
def scoped_price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = pricing.scoped_prices(A.prices(spark, sf_dir), A.stores(spark, sf_dir), day())
    return won.select("store_id", "product_id", text("price_date"), money("effective_price"), "price_scope")


@query("""
SELECT retailer_id, product_id, coalesce(trim(format_name), '') AS format_name, CAST(price_date AS VARCHAR) AS price_date, price_id
FROM v_price JOIN (SELECT retailer_id, max(price_date) AS newest FROM v_price GROUP BY retailer_id) USING (retailer_id)
WHERE price_date = newest
QUALIFY row_number() OVER (PARTITION BY retailer_id, product_id, coalesce(trim(format_name), '') ORDER BY price_id DESC) = 1""")
def latest_snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.prices(spark, sf_dir).withColumn("format_name", F.coalesce(F.trim("format_name"), F.lit("")))
    last = pricing.snapshot(known, ["retailer_id"], ["product_id", "format_name"], [F.desc("price_id")])
    return last.select("retailer_id", "product_id", "format_name", text("price_date"), "price_id")


@query("""
SELECT coalesce(nullif(trim(barcode), ''), CAST(product_id AS VARCHAR)) AS offer_key, arg_min(product_id, (naive_price, product_id)) AS product_id,
  CAST(min(naive_price) AS DOUBLE) AS effective_price
FROM v_product JOIN (SELECT product_id, naive_price FROM v_latest) USING (product_id) WHERE naive_price IS NOT NULL GROUP BY offer_key""")
def best_offer_per_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = pricing.latest(A.prices(spark, sf_dir)).select("product_id", price.naive(F.col("regular_price"), F.col("discounted_price")).alias("p"))
    offered = A.products(spark, sf_dir).join(newest.where("p IS NOT NULL"), "product_id")
    key = F.coalesce(F.nullif(F.trim("barcode"), F.lit("")), F.col("product_id").cast("string"))
    return offered.groupBy(key.alias("offer_key")).agg(F.min_by("product_id", F.struct("p", "product_id")).alias("product_id"), F.min("p").cast("double").alias("effective_price"))


@query("""
SELECT product_id, name, retailer_code, CAST(price_date AS VARCHAR) AS price_date, CAST(naive_price AS DOUBLE) AS effective_price
FROM v_product JOIN v_retailer USING (retailer_id) JOIN (SELECT product_id, price_date, naive_price FROM v_latest) USING (product_id)
WHERE name ILIKE '%ring%' OR brand ILIKE '%ring%' OR barcode ILIKE '%ring%' OR category ILIKE '%ring%'
ORDER BY naive_price NULLS LAST, name, product_id LIMIT 100""")
def offer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred cheapest offers that mention a word anywhere: a top-k report."""
    said = F.lit(False)
    for c in ("name", "brand", "barcode", "category"):
        said = said | F.col(c).ilike("%ring%")
    found = A.products(spark, sf_dir).where(said)
    newest = pricing.latest(A.prices(spark, sf_dir).join(found.select("product_id"), "product_id", "left_semi"))
    newest = newest.select("product_id", "price_date", price.naive(F.col("regular_price"), F.col("discounted_price")).alias("effective_price"))
    offers = found.join(newest, "product_id").join(F.broadcast(A.retailers(spark, sf_dir)), "retailer_id")
    top = offers.orderBy(F.asc_nulls_last("effective_price"), "name", "product_id").limit(100)
    return top.select("product_id", "name", "retailer_code", text("price_date"), money("effective_price"))


@query("SELECT l.list_id, name, count(item_id) AS item_count FROM v_list l LEFT JOIN v_item i ON l.list_id = i.list_id GROUP BY ALL")
def list_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = A.items(spark, sf_dir).groupBy("list_id").agg(F.count("item_id").alias("item_count"))
    return A.lists(spark, sf_dir).join(count, "list_id", "left").select("list_id", "name", F.coalesce("item_count", F.lit(0)).alias("item_count"))

"""The rules of prices, names and similarity as functions of SQL.

``register`` makes them temporary functions of a session, each a SQL expression that
the optimizer sees through; no Python runs in a query that uses them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from kantar.functions import text as T

_VALID = "discounted IS NOT NULL AND (from_day IS NULL OR from_day <= {day}) AND (to_day IS NULL OR to_day >= {day})"
_PRICES = "regular DECIMAL(12,2), discounted DECIMAL(12,2)"
_DAYS = "from_day DATE, to_day DATE"


def _words() -> str:
    """``text.normalize_name`` written in SQL, from the same letters."""
    out = f"TRANSLATE(LOWER(COALESCE(name, '')), '{T.CYRILLIC}', '{T.LATIN}')"
    for letter, pair in T.DIGRAPHS.items():
        out = f"REPLACE({out}, '{letter}', '{pair}')"
    out = rf"REGEXP_REPLACE(TRANSLATE({out}, '{T.MARKED}', '{T.BARE}'), '\\p{{M}}+', '')"
    out = f"REPLACE(REPLACE({out}, 'đ', 'dj'), '×', 'x')"
    out = f"REGEXP_REPLACE({out}, '(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])', ' ')"
    return f"TRIM(REGEXP_REPLACE({out}, '[^a-z0-9]+', ' '))"


_SHARED = "SIZE(ARRAY_INTERSECT(kantar_trigrams(a), kantar_trigrams(b)))"
_UNITED = "SIZE(ARRAY_UNION(kantar_trigrams(a), kantar_trigrams(b)))"

FUNCTIONS = {
    # Valid on its own day, else regular, else discounted after all.
    "kantar_price_own": (f"{_PRICES}, {_DAYS}, price_day DATE", "DECIMAL(12,2)", f"COALESCE(CASE WHEN {_VALID.format(day='price_day')} THEN discounted END, regular, discounted)"),
    # Valid on the day asked for, else regular; nothing else.
    "kantar_price_as_of": (f"{_PRICES}, {_DAYS}, asked_day DATE", "DECIMAL(12,2)", f"COALESCE(CASE WHEN {_VALID.format(day='asked_day')} THEN discounted END, regular)"),
    # Days don't count.
    "kantar_price_naive": (_PRICES, "DECIMAL(12,2)", "COALESCE(discounted, regular)"),
    "kantar_line_total": ("price DECIMAL(12,2), quantity DECIMAL(10,3)", "DECIMAL(18,2)", "CAST(ROUND(price * quantity, 2) AS DECIMAL(18,2))"),
    "kantar_words": ("name STRING", "STRING", _words()),
    "kantar_trigrams": (
        "name STRING",
        "ARRAY<STRING>",
        "ARRAY_DISTINCT(FLATTEN(TRANSFORM(FILTER(SPLIT(LOWER(COALESCE(name, '')), '[^a-z0-9]+'), w -> w <> ''), w -> TRANSFORM(SEQUENCE(1, LENGTH(w) + 1), i -> SUBSTRING(CONCAT('  ', w, ' '), i, 3)))))",
    ),
    "kantar_similarity": ("a STRING, b STRING", "FLOAT", f"CASE WHEN {_UNITED} = 0 THEN CAST(0 AS FLOAT) ELSE CAST(CAST({_SHARED} AS FLOAT) / CAST({_UNITED} AS FLOAT) AS FLOAT) END"),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to the session; those of the same name are replaced."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")

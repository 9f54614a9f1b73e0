"""Named queries over the driver's tables, each with its DuckDB twin.

Every query reads its tables whole. Amounts come out as doubles and days as text,
so that two engines can be held against each other.
"""

from __future__ import annotations

from kantar.plans import list_queries, log_queries, match_queries, model_queries, place_queries, price_queries, store_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (price_queries, store_queries, match_queries, list_queries, log_queries, model_queries, place_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)

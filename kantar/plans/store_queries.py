"""Queries on stores, distances and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.operators import stores as S
from kantar.plans import adapters as A
from kantar.plans.adapters import DOMAIN_SQL
from kantar.sources import sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = DOMAIN_SQL + sql
        return f

    return add


def metres_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371008.8 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"


GOOD = "s.active AND s.geocoding_status IN ('AUTO_VERIFIED', 'MANUALLY_VERIFIED')"
FAR = metres_sql("u.latitude", "u.longitude", "s.latitude", "s.longitude")
NEARBY_SQL = f""", v_near AS (
  SELECT u.user_id, s.store_id, s.retailer_id, s.latitude, s.longitude, u.latitude AS lat0, u.longitude AS lon0, {FAR} AS m FROM v_user u JOIN v_store s
    ON abs(u.latitude - s.latitude) < 0.2 AND abs(u.longitude - s.longitude) < 0.3 WHERE {GOOD}
), v_nearby AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m, store_id) AS position FROM v_near WHERE m <= 15000 QUALIFY position <= 20
)"""


@query(NEARBY_SQL + "SELECT user_id, store_id, CAST(position AS INTEGER) AS position, CAST(floor(m + 0.5) AS BIGINT) AS metres FROM v_nearby")
def nearby_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.nearby(A.users(spark, sf_dir), A.stores(spark, sf_dir))
    return near.select("user_id", "store_id", "position", S.whole_metres(F.col("distance_m")).alias("metres"))


@query(f"""SELECT user_id, store_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m, store_id) AS INTEGER) AS position, CAST(floor(m + 0.5) AS BIGINT) AS metres
FROM (SELECT u.user_id, s.store_id, {FAR} AS m FROM v_user u CROSS JOIN v_store s WHERE s.active)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m, store_id) <= 5""")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.nearest(A.users(spark, sf_dir), A.stores(spark, sf_dir), 5)
    return near.select("user_id", "store_id", "position", S.whole_metres(F.col("distance_m")).alias("metres"))


@query(f"""SELECT user_id, retailer_id, store_id, CAST(floor(m + 0.5) AS BIGINT) AS metres
FROM (SELECT u.user_id, s.retailer_id, s.store_id, {FAR} AS m FROM v_user u CROSS JOIN v_store s WHERE s.active)
QUALIFY row_number() OVER (PARTITION BY user_id, retailer_id ORDER BY m, store_id) = 1""")
def nearest_per_retailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.nearest_per_retailer(A.users(spark, sf_dir), A.stores(spark, sf_dir))
    return near.select("user_id", "retailer_id", "store_id", S.whole_metres(F.col("distance_m")).alias("metres"))


POINTS_SQL = """, v_point AS (
  SELECT user_id, 'STORE:' || store_id AS point_id, latitude, longitude FROM v_nearby
  UNION ALL SELECT DISTINCT user_id, 'USER', lat0, lon0 FROM v_nearby
)"""


@query(NEARBY_SQL + POINTS_SQL + f"""SELECT a.user_id AS trip_id, a.point_id AS from_id, b.point_id AS to_id,
  CASE WHEN a.point_id = b.point_id THEN 0 ELSE CAST(floor({metres_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} + 0.5) AS BIGINT) END AS metres
FROM v_point a JOIN v_point b USING (user_id)""")
def route_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense matrix of each user's way-points: the user and the nearby stores."""
    users, place = A.users(spark, sf_dir), F.struct("latitude", "longitude").alias("trip_id")
    # Users at one place have the same way-points: one matrix a place, then a copy for each user.
    near = sinks.staged(S.nearby_places(users, A.stores(spark, sf_dir)), "matrix-points")
    at_store = near.select(place, F.concat(F.lit("STORE:"), F.col("store_id").cast("string")).alias("point_id"), F.col("to_latitude").alias("latitude"), F.col("to_longitude").alias("longitude"))
    at_user = near.where("position = 1").select(place, F.lit("USER").alias("point_id"), "latitude", "longitude")
    matrix = S.route_matrix(at_store.unionByName(at_user)).select("trip_id.*", "from_id", "to_id", "metres")
    return S.at_places(users.withColumnRenamed("user_id", "trip_id"), matrix).select("trip_id", "from_id", "to_id", "metres")


GREEDY_SQL = NEARBY_SQL.replace("WITH ", "", 1) + f""", v_walk AS (
  SELECT user_id, lat0 AS lat, lon0 AS lon, lat0, lon0, CAST(0 AS BIGINT) AS total, 0 AS steps, [0]::BIGINT[] AS seen, '' AS route FROM v_nearby WHERE position = 1
  UNION ALL
  SELECT * FROM (
    SELECT w.user_id, s.latitude, s.longitude, w.lat0, w.lon0,
      w.total + CAST(floor({metres_sql('w.lat', 'w.lon', 's.latitude', 's.longitude')} + 0.5) AS BIGINT), w.steps + 1, list_append(w.seen, s.position),
      CASE WHEN w.route = '' THEN '' ELSE w.route || '>' END || s.store_id
    FROM v_walk w JOIN v_nearby s ON s.user_id = w.user_id AND NOT list_contains(w.seen, s.position)
    QUALIFY row_number() OVER (PARTITION BY w.user_id ORDER BY CAST(floor({metres_sql('w.lat', 'w.lon', 's.latitude', 's.longitude')} + 0.5) AS BIGINT), s.position) = 1)
)
SELECT user_id AS trip_id, route, total + CAST(floor({metres_sql('lat', 'lon', 'lat0', 'lon0')} + 0.5) AS BIGINT) AS metres
FROM v_walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY steps DESC) = 1"""


def greedy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, place = A.users(spark, sf_dir), F.struct("latitude", "longitude").alias("trip_id")
    # Trips that begin at one place have the same stops, so they are one walk.
    near = sinks.staged(S.nearby_places(users, A.stores(spark, sf_dir)), "route-stops")
    start = near.where("position = 1").select(place, "latitude", "longitude")
    stops = near.select(place, "position", "store_id", F.col("to_latitude").alias("latitude"), F.col("to_longitude").alias("longitude"))
    walked = S.greedy_route(start, stops).select("trip_id.*", F.concat_ws(">", F.transform("route", lambda r: r.cast("string"))).alias("route"), "metres")
    return S.at_places(users.withColumnRenamed("user_id", "trip_id"), walked).select("trip_id", "route", "metres")


QUERIES["greedy_route"] = greedy_route
ORACLE["greedy_route"] = DOMAIN_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + GREEDY_SQL


@query("""
SELECT store_id, CASE WHEN r = '' THEN 'AUTO_VERIFIED' ELSE 'NEEDS_REVIEW' END AS status, nullif(r, '') AS reasons
FROM (SELECT store_id, concat_ws(',', CASE WHEN store_id % 20 < 3 THEN 'LOW_CONFIDENCE' END, CASE WHEN store_id % 5 = 0 THEN 'CITY_MISMATCH' END,
    CASE WHEN position(CAST(store_id % 30 AS VARCHAR) IN 'glavna ' || (store_id % 17) || CASE WHEN store_id % 5 = 0 THEN ' beograd' ELSE ' valjevo srbija' END) = 0 THEN 'HOUSE_NUMBER_MISMATCH' END) AS r FROM v_store)""")
def geocoding_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("store_id")
    address = F.concat(F.lit("Главна "), (k % 30).cast("string"))
    matched = F.concat(F.lit("Glavna "), (k % 17).cast("string"), F.when(k % 5 == 0, ", Beograd").otherwise(", Ваљево, Србија"))
    confidence = F.when(k % 20 < 3, F.lit("0.8499")).otherwise(F.lit("0.8500")).cast("decimal(5,4)")
    told = S.geocoding_decision(confidence, address, F.lit("Valjevo"), matched)
    return A.stores(spark, sf_dir).select("store_id", told.alias("x")).select("store_id", "x.status", "x.reasons")

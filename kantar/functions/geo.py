"""Distances on the sphere, and joins by nearness through grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kantar.functions.text import let

#: Mean radius of the earth in metres.
RADIUS_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, unrounded."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(2 * RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


# The ellipsoid of WGS 84.
EQUATOR_M, FLATTENING = 6_378_137.0, 1 / 298.257223563
#: Rounds of the spheroid's longitude; each gains more than two digits away from the antipodes.
ROUNDS = 12


def spheroid_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the geodesic of the WGS 84 ellipsoid, by Vincenty's inverse; null for nearly antipodal points, for which it does not converge.

    The difference of longitudes on the auxiliary sphere is the fold of a fixed number of
    rounds, so the whole stays one expression.
    """
    pole = EQUATOR_M * (1 - FLATTENING)
    one, n = F.lit(1.0), F.lit
    # Nothing here depends on the round.
    u1, u2 = (F.atan(n(1 - FLATTENING) * F.tan(F.radians(lat))) for lat in (lat1, lat2))
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))

    def arc(k: Column, turn: Column) -> Column:
        """What a difference of longitudes gives: the arc and its azimuth at the equator."""
        x, y = k["c2"] * F.sin(turn), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(turn)
        one_step = F.struct(F.sqrt(x * x + y * y).alias("sin"), (k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(turn)).alias("cos"))
        tilt = lambda a: F.when(a["sin"] > 0, k["c1"] * k["c2"] * F.sin(turn) / a["sin"]).otherwise(0.0)
        more = let(one_step, lambda a: F.struct(a["sin"].alias("sin"), a["cos"].alias("cos"), F.atan2(a["sin"], a["cos"]).alias("arc"), tilt(a).alias("tilt")))
        middle = lambda b: F.when(1 - b["tilt"] * b["tilt"] > 1e-15, b["cos"] - 2 * k["s1"] * k["s2"] / (1 - b["tilt"] * b["tilt"])).otherwise(0.0)
        return let(more, lambda b: F.struct(b["sin"].alias("sin"), b["cos"].alias("cos"), b["arc"].alias("arc"), b["tilt"].alias("tilt"), (one - b["tilt"] * b["tilt"]).alias("flat"), middle(b).alias("mid")))

    def turned(k: Column, turn: Column) -> Column:
        def next_turn(a: Column) -> Column:
            c = n(FLATTENING / 16) * a["flat"] * (4 + n(FLATTENING) * (4 - 3 * a["flat"]))
            inner = a["mid"] + c * a["cos"] * (-one + 2 * a["mid"] * a["mid"])
            return k["l"] + (one - c) * n(FLATTENING) * a["tilt"] * (a["arc"] + c * a["sin"] * inner)

        return let(arc(k, turn), next_turn)

    def length(a: Column) -> Column:
        w = a["flat"] * n((EQUATOR_M**2 - pole**2) / pole**2)
        big = one + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
        small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
        m = a["mid"]
        odd = small / 6 * m * (4 * a["sin"] * a["sin"] - 3) * (4 * m * m - 3)
        return n(pole) * big * (a["arc"] - small * a["sin"] * (m + small / 4 * (a["cos"] * (2 * m * m - 1) - odd)))

    def whole(k: Column) -> Column:
        last = F.aggregate(F.sequence(n(1), n(ROUNDS)), k["l"], lambda turn, _: turned(k, turn))
        return let(last, lambda t: F.when(F.abs(turned(k, t) - t) < 1e-11, let(arc(k, t), length)))

    return F.when((lat1 == lat2) & (lon1 == lon2), n(0.0)).otherwise(let(fixed, whole))


def kilometres(metres: Column) -> Column:
    """With two places, halves up."""
    return F.round((metres / F.lit(1000.0)).cast("decimal(20,6)"), 2).cast("decimal(12,2)")


def whole_metres(metres: Column) -> Column:
    return F.floor(metres + 0.5).cast("long")


def within(left: DataFrame, right: DataFrame, radius_m: float, distance: str = "distance_m", band: float = 1.0) -> DataFrame:
    """Pairs of rows at most ``radius_m`` apart, with their distance.

    Both sides have ``latitude`` and ``longitude``; those of ``right`` come back as
    ``to_latitude`` and ``to_longitude``. Rows meet in cells: latitude bands at
    least as high as the radius, and columns that are at least as wide at the
    band's latitude, each left row being sent to the nine cells around its own.
    So this is an equi join, whatever the number of rows, and no cross join.
    """
    step_lat = max(band * math.degrees(radius_m / RADIUS_M) * 1.001, 1e-6)

    def wide(row: Column) -> Column:
        """Degrees of longitude of a cell, the same for all cells of a row of the grid."""
        edge = F.least(F.lit(89.0), (F.abs(row) + 1) * F.lit(step_lat))
        return F.least(F.lit(360.0), F.lit(step_lat) / F.cos(F.radians(edge)))

    row = lambda lat: F.floor(lat / F.lit(step_lat))
    cells = left.withColumn("cell_row", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: row(F.col("latitude")) + d)))
    column = F.floor(F.col("longitude") / wide(F.col("cell_row")))
    last = F.floor(F.lit(360.0) / wide(F.col("cell_row")))
    # Cells wrap around the date line; the remainder column is looked at from both ends.
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: column + d)
    cells = cells.withColumn("cell_col", F.explode(F.array_distinct(F.concat(around, F.transform(around, lambda x: x - last - 1), F.transform(around, lambda x: x + last + 1), F.transform(around, lambda x: x - last), F.transform(around, lambda x: x + last)))))
    other = right.withColumnRenamed("latitude", "to_latitude").withColumnRenamed("longitude", "to_longitude")
    other = other.withColumn("to_row", row(F.col("to_latitude"))).withColumn("to_col", F.floor(F.col("to_longitude") / wide(F.col("to_row"))))
    met = cells.join(other, (F.col("cell_row") == F.col("to_row")) & (F.col("cell_col") == F.col("to_col")))
    metres = haversine_m(F.col("latitude"), F.col("longitude"), F.col("to_latitude"), F.col("to_longitude"))
    return met.withColumn(distance, metres).where(F.col(distance) <= radius_m).drop("cell_row", "cell_col", "to_row", "to_col")

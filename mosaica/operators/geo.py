"""Radius search and distance join, with a grid so that only near pairs are compared."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import GEOHASH, RADIUS, haversine


def box(lon: float, lat: float, metres: float) -> tuple[float, float, float, float] | None:
    """Longitudes and latitudes that hold the circle; None where it crosses a pole or the date line."""
    dlat = math.degrees(metres / RADIUS) * 1.0000001
    if abs(lat) + dlat >= 89.9:
        return None
    dlon = math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, metres / RADIUS)) / math.cos(math.radians(lat))))) * 1.0000001
    return (lon - dlon, lon + dlon, lat - dlat, lat + dlat) if abs(lon) + dlon < 180 else None


def within(df: DataFrame, lon: Column, lat: Column, centre: tuple[float, float], metres: float) -> DataFrame:
    """Rows nearer than metres: plain range predicates first (they reach the scan), then the exact distance."""
    around = box(*centre, metres)
    if around:
        df = df.where(lon.between(around[0], around[1]) & lat.between(around[2], around[3]))
    return df.where(haversine(lon, lat, F.lit(centre[0]), F.lit(centre[1])) < metres)


def covering(around: tuple[float, float, float, float], precision: int, most: int = 256) -> list[str]:
    """Geohashes that cover a box of longitudes and latitudes: of this precision, or of the finest below it that takes at most so
    many cells. Cells are counted along either axis, longitude having the odd bit."""
    for k in range(precision, 0, -1):
        bits = 5 * k
        wide, high = (bits + 1) // 2, bits // 2
        place = lambda v, low, span, n: min((1 << n) - 1, max(0, math.floor((v - low) / span * (1 << n))))
        xs = range(place(around[0], -180, 360, wide), place(around[1], -180, 360, wide) + 1)
        ys = range(place(around[2], -90, 180, high), place(around[3], -90, 180, high) + 1)
        if len(xs) * len(ys) <= most:
            bit = lambda x, y, i: (x >> (wide - 1 - i // 2) if i % 2 == 0 else y >> (high - 1 - i // 2)) & 1  # noqa: B023, E731
            return sorted("".join(GEOHASH[sum(bit(x, y, 5 * j + i) << (4 - i) for i in range(5))] for j in range(k)) for x in xs for y in ys)
    return [""]


def within_cells(df: DataFrame, cell: Column, lon: Column, lat: Column, centre: tuple[float, float], metres: float, precision: int) -> DataFrame:
    """Rows nearer than metres, of a table whose column cell holds geohashes of this precision: those in the cells that cover the circle
    (a condition that reaches the scan, and prunes where the table is partitioned or sorted by cell), then the exact distance."""
    around = box(*centre, metres)
    if around:
        cells = covering(around, precision)
        if cells != [""]:
            df = df.where(cell.isin(*cells) if len(cells[0]) == precision else F.substring(cell, 1, len(cells[0])).isin(*cells))
    return df.where(haversine(lon, lat, F.lit(centre[0]), F.lit(centre[1])) < metres)


def distance_join(a: DataFrame, b: DataFrame, a_at: tuple[str, str], b_at: tuple[str, str], metres: float) -> DataFrame:
    """Pairs of rows nearer than metres, with their ``distance``: an equi-join on grid cells, b entering its neighbours' cells too.

    Latitudes are cut into bands as high as the radius; within a band, longitudes into cells as wide as the radius is there."""
    high = math.degrees(metres / RADIUS) * 1.0001
    band = lambda lat: F.floor((lat + 90) / high)
    # width of a cell: the radius at the band's edge that is farther from the equator, one band further for neighbours
    edge = lambda k: F.least(F.greatest(F.abs(k * high - 90), F.abs((k + 1) * high - 90)) + high, F.lit(89.9))
    cells = lambda k: F.greatest(F.floor(360 * F.cos(F.radians(edge(k))) / high), F.lit(1))
    cell = lambda lon, k: F.pmod(F.floor((lon + 180) / 360 * cells(k)), cells(k))
    left = a.withColumn("__band", band(F.col(a_at[1]))).withColumn("__cell", cell(F.col(a_at[0]), F.col("__band")))
    right = b.withColumn("__band", F.explode(F.array(*(band(F.col(b_at[1])) + d for d in (-1, 0, 1)))))
    right = right.withColumn("__cell", F.explode(F.array_distinct(F.array(*(F.pmod(cell(F.col(b_at[0]), F.col("__band")) + d, cells(F.col("__band"))) for d in (-1, 0, 1))))))
    met = left.join(right, ["__band", "__cell"]).withColumn("distance", haversine(F.col(a_at[0]), F.col(a_at[1]), F.col(b_at[0]), F.col(b_at[1])))
    return met.where(F.col("distance") < metres).drop("__band", "__cell")

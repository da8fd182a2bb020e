"""Terrain parameters of a cell table (row, col, z), by 3x3 windows and by flow from cell to cell.

Neighbours come from two window passes, along rows and then along columns, and are neighbours only if their row or
column differs by one: cells may be missing anywhere. Both passes are partitioned by bands, each with one line of its
neighbours on either side, so that no window partition grows with the raster. All window parameters of a raster come
from one such plan (`parameters`). Cells whose window is not whole have null; flow takes the neighbours there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored

BAND = 4096
NAMES = "abcdefghi"
#: Steps (row, col) to the eight neighbours, in the order of the window's letters without e.
AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
LETTERS = [n for n in NAMES if n != "e"]
ROOT2 = 2**0.5


def _neighbours(cells: DataFrame, z: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns a..i: the window row by row, e the cell itself; keep: columns that tell rasters or tiles apart."""

    def banded(df: DataFrame, c: str) -> DataFrame:
        return df.withColumn("part", F.explode(F.array_distinct(F.array(*(F.expr(f"({c} + {d}) div {BAND}") for d in (-1, 0, 1))))))

    def beside(value: Column, c: str, d: int, over) -> Column:
        there = F.lag(F.struct(F.col(c).alias("at"), value.alias("is")), -d).over(over)
        return F.when(there["at"] == F.col(c) + d, there["is"])

    strip = banded(cells.select(*keep, "row", "col", F.col(z).cast("double").alias("z")), "col")
    across = Window.partitionBy(*keep, "row", "part").orderBy("col")
    line = F.struct(beside(F.col("z"), "col", -1, across).alias("w"), F.col("z"), beside(F.col("z"), "col", 1, across).alias("e"))
    rows = banded(strip.withColumn("line", line).where(f"part = col div {BAND}").drop("part"), "row")
    down = Window.partitionBy(*keep, "col", "part").orderBy("row")
    rows = rows.withColumns({"up": beside(F.col("line"), "row", -1, down), "dn": beside(F.col("line"), "row", 1, down)}).where(f"part = row div {BAND}")
    places = ("up.w", "up.z", "up.e", "line.w", "line.z", "line.e", "dn.w", "dn.z", "dn.e")
    return rows.select(*keep, "row", "col", *(F.col(p).alias(n) for n, p in zip(NAMES, places)))


def _around(cells: DataFrame, z: str) -> DataFrame:
    """As `_neighbours`, with every neighbour there is: a corner also counts where the cells beside it are missing.

    Each cell hands its value to the nine windows it is in, which are put together by one aggregation.
    """
    steps = F.array(*(F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(k).alias("k")) for k, (dr, dc) in enumerate((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1))))
    given = cells.select(F.explode(steps).alias("s"), F.col(z).cast("double").alias("z"))
    window = given.groupBy("s.row", "s.col").agg(*(F.max(F.when(F.col("s.k") == k, F.col("z"))).alias(n) for k, n in enumerate(NAMES)))
    return window.where("e is not null")


def _gradient(res: float) -> tuple[Column, Column]:
    """Horn's weights: eastward and southward slope."""
    a, b, c, d, f, g, h, i = (F.col(x) for x in LETTERS)
    return ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * res), ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * res)


def _slope(res: float) -> Column:
    dx, dy = _gradient(res)
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def _aspect(res: float) -> Column:
    dx, dy = _gradient(res)
    turned = 90 - F.degrees(F.atan2(dy, -dx))
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.when(turned < 0, turned + 360).when(turned >= 360, turned - 360).otherwise(turned))


def _hillshade(res: float, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    dx, dy = _gradient(res)
    az, alt = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    light = (F.sin(alt) - F.cos(alt) * (dx * F.sin(az) - dy * F.cos(az))) / F.sqrt(1 + dx * dx + dy * dy)
    return F.when(light <= 0, 1.0).otherwise(1 + 254 * light)


def _curvature(kind: str) -> Callable[[float], Column]:
    def make(res: float) -> Column:
        a, b, c, d, e, f, g, h, i = (F.col(x) for x in NAMES)
        dd, ee = ((d + f) / 2 - e) / res**2, ((b + h) / 2 - e) / res**2
        ff, gg, hh = (c + g - a - i) / (4 * res**2), (f - d) / (2 * res), (b - h) / (2 * res)
        steep = gg * gg + hh * hh
        bend = -2 * (dd * gg * gg + ee * hh * hh + ff * gg * hh) if kind == "profile" else 2 * (dd * hh * hh + ee * gg * gg - ff * gg * hh)
        return F.when(steep.isNotNull(), F.when(steep == 0, 0.0).otherwise(bend / steep))

    return make


#: What one plan can compute side by side: name -> column over the window, from the cell size.
PARAMETERS: dict[str, Callable[..., Column]] = {
    "slope": _slope,
    "aspect": _aspect,
    "hillshade": _hillshade,
    "profile": _curvature("profile"),
    "plan": _curvature("plan"),
}


def parameters(cells: DataFrame, z: str, names: list[str], res: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep.., row, col, names..) from one pair of window passes."""
    return _neighbours(cells, z, keep).select(*keep, "row", "col", *(PARAMETERS[n](res).alias(n) for n in names))


def slope(cells: DataFrame, z: str, res: float = 1.0) -> DataFrame:
    return parameters(cells, z, ["slope"], res)


def aspect(cells: DataFrame, z: str, res: float = 1.0) -> DataFrame:
    """Azimuth of the steepest descent, clockwise from north; 0 where flat."""
    return parameters(cells, z, ["aspect"], res)


def hillshade(cells: DataFrame, z: str, res: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """1 to 255; 1 where the light does not reach."""
    return _neighbours(cells, z).select("row", "col", _hillshade(res, azimuth, altitude).alias("hillshade"))


def curvature(cells: DataFrame, z: str, res: float = 1.0) -> DataFrame:
    """Profile and plan curvature from second differences (Zevenbergen and Thorne); 0 where flat."""
    return parameters(cells, z, ["profile", "plan"], res)


def convergence(cells: DataFrame, z: str, res: float = 1.0) -> DataFrame:
    """Convergence index: the mean angle, less 90 degrees, between the neighbours' aspects and the way to the cell.

    -90 where all neighbours drain into the cell, 90 where all drain away. Null unless all eight have an aspect.
    """
    found = _neighbours(aspect(cells, z, res), "aspect")

    def off(letter: str, dr: int, dc: int) -> Column:
        towards = F.degrees(F.atan2(F.lit(float(-dc)), F.lit(float(dr))))  # azimuth from the neighbour to the cell
        turn = F.pmod(F.abs(F.col(letter) - towards), F.lit(360.0))
        return F.least(turn, 360.0 - turn)

    total = reduce(lambda p, q: p + q, (off(n, dr, dc) for n, (dr, dc) in zip(LETTERS, AROUND)))
    return found.select("row", "col", (total / 8 - 90).alias("convergence"))


def flow_direction(cells: DataFrame, z: str, res: float = 1.0) -> DataFrame:
    """(row, col, to_row, to_col, drop): the neighbour of steepest descent (the first in AROUND of equally steep); null
    at pits and on flats. drop: height by distance."""
    e = F.col("e")
    falls = F.array(*(F.struct(((e - F.col(n)) / (res * (ROOT2 if dr and dc else 1.0))).alias("drop"), F.lit(-k).alias("k"), (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for k, (n, (dr, dc)) in enumerate(zip(LETTERS, AROUND))))
    best = F.array_max(F.filter(falls, lambda s: s["drop"] > 0))
    return _around(cells, z).withColumn("best", best).select("row", "col", F.col("best.row").alias("to_row"), F.col("best.col").alias("to_col"), F.col("best.drop").alias("drop"))


def flow_accumulation(cells: DataFrame, z: str, res: float = 1.0) -> DataFrame:
    """(row, col, cells, drop): how many cells drain through each, itself included.

    Pointers are doubled: after k rounds a cell's sum holds all cells up to 2**k - 1 steps above it, and it points 2**k
    steps on; so a path of a million cells takes twenty rounds of two joins. Each round is a stored table.
    """
    way = stored(flow_direction(cells, z, res), "flow")
    now, before = way.select("row", "col", "to_row", "to_col", F.lit(1).cast("long").alias("cells")), []
    while now.where("to_row is not null").limit(1).count():
        above = now.where("to_row is not null").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("cells").alias("more"))
        onward = now.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("next_row"), F.col("to_col").alias("next_col"))
        step = now.join(above, ["row", "col"], "left").join(onward, ["to_row", "to_col"], "left")
        now = stored(step.select("row", "col", F.col("next_row").alias("to_row"), F.col("next_col").alias("to_col"), (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells")), "flow")
        discard(*before)
        before = [now]
    return now.select("row", "col", "cells").join(way.select("row", "col", "drop"), ["row", "col"])


def wetness(cells: DataFrame, z: str, res: float = 1.0, least: float = 1e-3) -> DataFrame:
    """(row, col, twi): ln(catchment per width / slope); slopes under `least` count as that."""
    flow = flow_accumulation(cells, z, res)
    return flow.select("row", "col", F.log(F.col("cells") * res / F.greatest(F.coalesce("drop", F.lit(0.0)), F.lit(least))).alias("twi"))


def slope_length(cells: DataFrame, z: str, res: float = 1.0) -> DataFrame:
    """(row, col, ls): the length-slope factor (Moore and Burch) from catchment and steepest descent."""
    flow = flow_accumulation(cells, z, res)
    sine = F.sin(F.atan(F.coalesce("drop", F.lit(0.0))))
    return flow.select("row", "col", (F.pow(F.col("cells") * res / 22.13, F.lit(0.4)) * F.pow(sine / 0.0896, F.lit(1.3))).alias("ls"))

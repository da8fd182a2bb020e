"""Profiles and regions of interest of images held as cells (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line(cells: DataFrame, value: str, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """(step, distance, value) along a line in steps of one pixel of its longer axis."""
    n = max(abs(x2 - x1), abs(y2 - y1))
    steps = cells.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("step"))
    at = lambda a, b: F.bround(F.lit(float(a)) + F.col("step") * ((b - a) / n if n else 0.0)).cast("int")
    path = steps.withColumns({"col": at(x1, x2), "row": at(y1, y2)})
    gap = F.sqrt(F.pow(F.col("col") - x1, 2) + F.pow(F.col("row") - y1, 2))
    return path.join(cells, ["row", "col"], "left").select("step", gap.alias("distance"), value)


def band(cells: DataFrame, value: str, x1: float, y1: float, x2: float, y2: float, width: float, bins: int) -> DataFrame:
    """(bin, value): means across a band of a given width about a line, by position along it; 0 without cells."""
    dx, dy = x2 - x1, y2 - y1
    length = (dx * dx + dy * dy) ** 0.5
    along = ((F.col("col") - x1) * dx + (F.col("row") - y1) * dy) / length
    across = F.abs((F.col("col") - x1) * dy - (F.col("row") - y1) * dx) / length
    inside = cells.where((across <= width / 2) & along.between(0, length)).select(F.least(F.floor(along * bins / length), F.lit(bins - 1)).cast("int").alias("bin"), value)
    means = inside.groupBy("bin").agg(F.avg(value).alias("mean"))
    return cells.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(means, "bin", "left").select("bin", F.coalesce("mean", F.lit(0.0)).alias(value))


def pixel(cells: DataFrame, row: int, col: int, nrow: int, ncol: int) -> DataFrame:
    """The cell at an offset, held within the image."""
    return cells.where((F.col("row") == min(max(row, 0), nrow - 1)) & (F.col("col") == min(max(col, 0), ncol - 1)))


def region_of_interest(cells: DataFrame, value: str, row: int, col: int, nrow: int, ncol: int) -> DataFrame:
    """A rectangle's cells moved to the origin of a square as long as its longer side, filled up with ones."""
    side = max(nrow, ncol)
    inside = cells.where(F.col("row").between(row, row + nrow - 1) & F.col("col").between(col, col + ncol - 1)).select((F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), value)
    square = cells.sparkSession.range(side * side).select((F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    return square.join(inside, ["row", "col"], "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(1.0)))


def horizontal_band(cells: DataFrame, value: str, x1: float, x2: float, y: float, width: float, bins: int) -> DataFrame:
    """Means along a row's direction, by position along x."""
    return band(cells, value, min(x1, x2), y, max(x1, x2), y, width, bins)


def vertical_band(cells: DataFrame, value: str, y1: float, y2: float, x: float, width: float, bins: int) -> DataFrame:
    """Means along a column's direction, by position along y."""
    return band(cells, value, x, min(y1, y2), x, max(y1, y2), width, bins)

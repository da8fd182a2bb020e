"""Raster algebra on cell tables (row, col, values): joins by integer cell keys, never by coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    xmin: float
    xres: float
    ymax: float
    yres: float
    nrow: int
    ncol: int

    def x(self, col: Column) -> Column:
        return F.lit(self.xmin) + self.xres / 2 + col * self.xres

    def y(self, row: Column) -> Column:
        return F.lit(self.ymax) - self.yres / 2 - row * self.yres

    def col(self, x: Column) -> Column:
        """The containing cell's column; null outside."""
        k = F.floor((x - self.xmin) / self.xres).cast("int")
        return F.when((k >= 0) & (k < self.ncol), k)

    def row(self, y: Column) -> Column:
        k = F.floor((F.lit(self.ymax) - y) / self.yres).cast("int")
        return F.when((k >= 0) & (k < self.nrow), k)


def to_points(cells: DataFrame, grid: Grid, bands: list[str], nodata: float | None = None) -> DataFrame:
    """Cell centres and bands; cells with nodata in any band go."""
    values = [(F.nullif(F.col(b), F.lit(nodata)) if nodata is not None else F.col(b)).alias(b) for b in bands]
    return cells.select(grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"), *values).na.drop()


def full_grid(spark, nrow: int, ncol: int) -> DataFrame:
    """All (row, col), made where they are used."""
    return spark.range(nrow * ncol).select((F.col("id") / ncol).cast("int").alias("row"), (F.col("id") % ncol).cast("int").alias("col"))


def to_raster(points: DataFrame, grid: Grid, value: str) -> DataFrame:
    """A whole grid, null where no point falls; of several points in a cell, their mean."""
    keyed = points.select(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col"), value).na.drop(subset=["row", "col"])
    cells = keyed.groupBy("row", "col").agg(F.avg(value).alias(value))
    return full_grid(points.sparkSession, grid.nrow, grid.ncol).join(cells, ["row", "col"], "left")


def extract(points: DataFrame, cells: DataFrame, grid: Grid, bands: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Points with the bands of the cell that holds them; null outside the grid."""
    keyed = points.withColumns({"row": grid.row(F.col(y)), "col": grid.col(F.col(x))})
    return keyed.join(cells.select("row", "col", *bands), ["row", "col"], "left")


def coarsen(cells: DataFrame, factor: float, band: str) -> DataFrame:
    """Means of blocks of factor x factor cells; partial blocks at the edges stay; a factor under 1 counts as 1."""
    f = max(1, int(factor))
    return cells.groupBy(F.expr(f"row div {f}").alias("row"), F.expr(f"col div {f}").alias("col")).agg(F.avg(band).alias(band))


def downsample(cells: DataFrame, nrow: int, ncol: int, width: int, band: str) -> DataFrame:
    """To a given width, the height in proportion, by averaging."""
    height = int(nrow * width / ncol)
    return cells.groupBy(F.floor(F.col("row") * height / nrow).cast("int").alias("row"), F.floor(F.col("col") * width / ncol).cast("int").alias("col")).agg(F.avg(band).alias(band))


def tiles(cells: DataFrame, nrow: int, ncol: int, n: int, halo: int = 0) -> DataFrame:
    """Each cell in every tile (of n x n) whose window, widened by the halo on all sides, holds it."""
    h, w = -(-nrow // n), -(-ncol // n)

    def reach(c: str, size: int) -> Column:
        low = F.greatest(F.expr(f"({c} - {halo}) div {size}"), F.lit(0))
        high = F.least(F.expr(f"({c} + {halo}) div {size}"), F.lit(n - 1))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    return cells.withColumn("tile_row", reach("row", h)).withColumn("tile_col", reach("col", w))


def mosaic(tiled: DataFrame, band: str) -> DataFrame:
    """The mean of all tiles that hold a cell."""
    return tiled.groupBy("row", "col").agg(F.avg(band).alias(band))


def merge_last(tiled: DataFrame, band: str, order: str) -> DataFrame:
    """The value of the last tile that has one."""
    return tiled.where(F.col(band).isNotNull()).groupBy("row", "col").agg(F.max_by(band, order).alias(band))


def stack(*layers: DataFrame) -> DataFrame:
    """Layers of one grid side by side, cells of any of them."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.join(layer, ["row", "col"], "full")
    return out


def resample_nearest(coarse: Grid, fine: Grid, cells: DataFrame, band: str) -> DataFrame:
    """For each coarse cell the fine cell at its centre."""
    centres = full_grid(cells.sparkSession, coarse.nrow, coarse.ncol).select(F.col("row").alias("crow"), F.col("col").alias("ccol"), coarse.x(F.col("col")).alias("x"), coarse.y(F.col("row")).alias("y"))
    return extract(centres, cells, fine, [band]).select(F.col("crow").alias("row"), F.col("ccol").alias("col"), band)


def crop_pixels(cells: DataFrame, row: int, col: int, nrow: int, ncol: int) -> DataFrame:
    return cells.where(F.col("row").between(row, row + nrow - 1) & F.col("col").between(col, col + ncol - 1))


def extent(vertices: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """Upper left and lower right corner."""
    return vertices.agg(F.min(x).alias("ulx"), F.max(y).alias("uly"), F.max(x).alias("lrx"), F.min(y).alias("lry"))


def crop_window(cells: DataFrame, grid: Grid, ulx: float, uly: float, lrx: float, lry: float) -> DataFrame:
    """Cells whose centres lie in a window of projected coordinates; a range of rows and columns, which reaches the scan."""
    from math import ceil, floor

    rows = ceil((grid.ymax - uly) / grid.yres - 0.5), floor((grid.ymax - lry) / grid.yres - 0.5)
    cols = ceil((ulx - grid.xmin) / grid.xres - 0.5), floor((lrx - grid.xmin) / grid.xres - 0.5)
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def mean_of(rasters: list[DataFrame], band: str, nodata: float | None = None) -> DataFrame:
    """(row, col, band): the mean of several rasters where they have data; null where none has."""
    value = F.col(band).cast("double")
    known = F.when(~F.isnan(value) & (F.lit(True) if nodata is None else value != nodata), value)
    rows = None
    for r in rasters:
        one = r.select("row", "col", known.alias(band))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("row", "col").agg(F.avg(band).alias(band))


def combine(tiled: DataFrame, band: str, function: str = "avg") -> DataFrame:
    """The value of overlapping tiles by a named aggregate: avg, min, max, median or sum."""
    known = {"avg": F.avg, "min": F.min, "max": F.max, "median": F.median, "sum": F.sum}
    if function not in known:
        raise ValueError(f"unknown function {function}")
    return tiled.groupBy("row", "col").agg(known[function](band).alias(band))


def reproject(cells: DataFrame, source: Grid, target: Grid, to_source, bands: list[str]) -> DataFrame:
    """A raster in another projection: each target cell takes the source cell at its centre.

    to_source: a function of the target's columns (x, y) that gives the source's. Null outside the source.
    """
    centres = full_grid(cells.sparkSession, target.nrow, target.ncol).select(F.col("row").alias("_r"), F.col("col").alias("_c"), target.x(F.col("col")).alias("_tx"), target.y(F.col("row")).alias("_ty"))
    x, y = to_source(F.col("_tx"), F.col("_ty"))
    found = extract(centres.withColumns({"x": x, "y": y}), cells, source, bands)
    return found.select(F.col("_r").alias("row"), F.col("_c").alias("col"), *bands)

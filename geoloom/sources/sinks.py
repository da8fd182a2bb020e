"""Sinks: tables as text with or without header, of fixed precision, and appended metric lines.

Every task writes its own file. NaN and null are written alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(value: Column, digits: int, missing: str = "NA") -> Column:
    """A number as text with as many decimals, as C prints it: of the exact binary value, a tie to the even digit.

    Java's formats round the shortest text of the number, and ties away from zero.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return pd.Series([missing if v != v else f"{v:.{digits}f}" for v in values.tolist()], dtype=object)

    return text(value.cast("double"))


def write_csv(df: DataFrame, path: str, header: bool = True, missing: str = "", mode: str = "overwrite") -> None:
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    clean = df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats}) if floats else df
    clean.write.mode(mode).option("header", header).option("nullValue", missing).csv(path)


def write_predictions(df: DataFrame, path: str, digits: int = 9, header: bool = False, mode: str = "overwrite") -> None:
    """All columns but integers at `digits` decimals."""
    whole = {c for c, t in df.dtypes if t in ("int", "bigint", "string")}
    df.select(*(F.col(f"`{c}`") if c in whole else fixed(F.col(f"`{c}`"), digits).alias(c) for c in df.columns)).write.mode(mode).option("header", header).csv(path)


def write_xyz(df: DataFrame, path: str, digits: int = 7, mode: str = "overwrite") -> None:
    """x, y, z sorted as a raster runs: north to south, then west to east, in files whose names sort so too."""
    df.select("x", "y", "z").orderBy(F.desc("y"), "x").select(*(fixed(F.col(c), digits).alias(c) for c in ("x", "y", "z"))).write.mode(mode).option("header", True).csv(path)


def append_metrics(df: DataFrame, path: str, value: str = "value", name: str = "path") -> None:
    """Append lines `value,path`."""
    df.select(F.concat_ws(",", F.col(value).cast("string"), name).alias("value")).write.mode("append").text(path)


def write_residuals(df: DataFrame, path: str, digits: int = 9) -> None:
    """x, y and delta, without a header."""
    write_predictions(df.select("x", "y", "delta"), path, digits)


def write_stats(stats: DataFrame, path: str) -> None:
    """A long table of statistics as `path`/stats, values only, a line a statistic in the order of `path`/keys."""
    keyed = stats.orderBy("stat", "column")  # a row for each statistic and column
    keyed.select(F.concat_ws(",", "stat", "column").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/keys")
    keyed.select(F.col("value").cast("string").alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/stats")


def write_manifest(spark, path: str, parameters: dict, survivors: DataFrame) -> None:
    """A job's parameters and the regions that are left, as one JSON line."""
    import json

    rows = [r.asDict() for r in survivors.collect()]  # regions by kind: a few hundred at most
    spark.createDataFrame([(json.dumps({"parameters": parameters, "regions": sorted(rows, key=str)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()[0])


def write_tiles(df: DataFrame, path: str, tile: list[str], header: bool = True) -> None:
    """A CSV folder for each tile; tiles without rows have none."""
    df.write.mode("overwrite").partitionBy(*tile).option("header", header).csv(path)


def write_raster(raster: DataFrame, grid, bands: list[str], path: str, form: str = "GTiff", **how) -> None:
    """Cells as GTiff tiles, one NC file of all cells (a grid of at most 2**27 cells), XYZ text, or Parquet."""
    from . import geotiff, netcdf

    spark = raster.sparkSession
    if form == "GTiff":
        geotiff.save(geotiff.tiles(raster, grid, bands, **how), path)
    elif form == "NC":
        import numpy as np

        if grid.nrow * grid.ncol * len(bands) > 1 << 27:
            raise ValueError("too large for one classic file: write GTiff tiles")
        layers = {b: np.full((grid.nrow, grid.ncol), np.nan) for b in bands}
        for part in raster.select("row", "col", *bands).toLocalIterator():
            for b in bands:
                if part[b] is not None:
                    layers[b][part["row"], part["col"]] = part[b]
        axes = {"lat": (["lat"], grid.ymax - (np.arange(grid.nrow) + 0.5) * grid.yres, {}), "lon": (["lon"], grid.xmin + (np.arange(grid.ncol) + 0.5) * grid.xres, {})}
        content = netcdf.encode(axes | {b: (["lat", "lon"], a, {}) for b, a in layers.items()}, {"lat": grid.nrow, "lon": grid.ncol})
        geotiff.save(spark.createDataFrame([("raster.nc", bytearray(content))], "name string, content binary"), path)
    elif form == "XYZ":
        write_xyz(raster.select(grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"), F.col(bands[0]).alias("z")), path)
    elif form == "Parquet":
        raster.select("row", "col", *bands).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {form}")


def write_vertices(shapes: DataFrame, path: str, digits: int = 9) -> None:
    """x and y of the vertices of shapes, in their order within each part, under a header."""
    ordered = shapes.repartition("file", "record").sortWithinPartitions("file", "record", "part", "place")
    write_predictions(ordered.select(F.col("px").alias("x"), F.col("py").alias("y")), path, digits, header=True)

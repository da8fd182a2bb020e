"""Files and folders of any store: names by pattern, the latest job, and a source by kind and year."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, geotiff, netcdf, text
from .config import valid_year

#: Readers by kind of source.
READERS: dict[str, Callable[..., DataFrame]] = {
    "points": text.points,
    "predictions": text.predictions,
    "delimited": text.delimited,
    "saga": binary.saga_grids,
    "geotiff": geotiff.cells,
    "netcdf": netcdf.daily,
    "shapes": binary.shapes,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def names(spark: SparkSession, pattern: str, containing: str = "") -> list[str]:
    """Paths that match a glob pattern, sorted, those with a part of a name only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    paths = [s.getPath() for s in found] if found is not None else []
    return sorted(p.toString() for p in paths if containing in p.getName())


def latest(spark: SparkSession, folder: str) -> str | None:
    """The entry of a folder whose name sorts last: of names that start with a date, the latest job."""
    found = names(spark, f"{folder.rstrip('/')}/*")
    return found[-1] if found else None


def read(spark: SparkSession, kind: str, path: str, year: int | None = None, **how) -> DataFrame:
    """A source by its kind; `{year}` in the path is filled in, and must be a year that there are data of."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}")
    if year is not None:
        path = path.replace("{year}", str(valid_year(year)))
    return READERS[kind](spark, path, **how)

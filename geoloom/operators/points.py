"""Point tables: roles of columns by name, header rules, filters and guards."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONTHS


@dataclass(frozen=True)
class PointSchema:
    """Which columns hold the coordinates, the target (None in evaluation tables) and the covariates."""

    x: str
    y: str
    target: str | None
    covariates: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, with_target: bool = True) -> PointSchema:
        x, y, *rest = df.columns
        return cls(x, y, rest[0] if with_target else None, tuple(rest[1:] if with_target else rest))


def keep_columns(df: DataFrame, places: list[int]) -> DataFrame:
    return df.select(*(df.columns[i] for i in places))


def drop_columns(df: DataFrame, places: list[int], keep: list[int] | None = None) -> DataFrame:
    """`keep` supersedes `places`."""
    return keep_columns(df, keep) if keep else df.drop(*(df.columns[i] for i in places))


def plain(header: str) -> str:
    return re.sub(r"[\W_]+", "", header)


def month_of(header: str) -> int:
    """The driver's twin of functions.scalars.month_to_int, for headers."""
    name = plain(header).lower()
    if any(c.isdigit() for c in name[:2]):
        n = int("".join(c for c in name if c.isdigit()))
        return n if 1 <= n <= 12 else 0
    return MONTHS.index(name[:3]) + 1 if name[:3] in MONTHS else 0


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*map(plain, df.columns))


def align_coordinates(evaluation: DataFrame, train: DataFrame) -> DataFrame:
    return evaluation.withColumnsRenamed(dict(zip(evaluation.columns[:2], train.columns[:2])))


def monthify(df: DataFrame) -> DataFrame:
    """Headers that name a month become its number."""
    return df.withColumnsRenamed({c: str(m) for c in df.columns if (m := month_of(c))})


def keep_month(df: DataFrame, month: int) -> DataFrame:
    """Without the other months' columns."""
    return df.drop(*(str(m) for m in range(1, 13) if m != month))


def wide_to_long(df: DataFrame, x: str = "x", y: str = "y", value: str = "sm") -> DataFrame:
    months = [c for c in df.columns if c.isdigit() and 1 <= int(c) <= 12]
    return df.unpivot([x, y], months, "month", value).withColumn("month", F.col("month").cast("int"))


def rename_target(df: DataFrame, place: int = 2, name: str = "z") -> DataFrame:
    return df.withColumnRenamed(df.columns[place], name)


def nan_to_null(df: DataFrame, nodata: float | None = None) -> DataFrame:
    """NaN and the nodata value become null in floating columns, so that aggregates skip them."""
    def clean(c: str) -> Column:
        ok = ~F.isnan(c) if nodata is None else ~F.isnan(c) & (F.col(c) != nodata)
        return F.when(ok, F.col(c))

    return df.withColumns({c: clean(c) for c, t in df.dtypes if t in ("double", "float")})


def clear_outliers(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0, strict: bool = False) -> DataFrame:
    c = F.col(column)
    return df.where((c > low) & (c < high) if strict else c.between(low, high))


def crop_box(df: DataFrame, x: str, y: str, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Bounds in either order; both conditions reach the scan."""
    return df.where(F.col(x).between(*sorted(lon)) & F.col(y).between(*sorted(lat)))


def drop_sentinel(df: DataFrame, columns: list[str], sentinel: float = -99999.0) -> DataFrame:
    return df.where(~F.array_contains(F.array(*(F.col(c).cast("double") for c in columns)), sentinel))


def large_groups(df: DataFrame, group: list[str], least: int) -> DataFrame:
    """Rows of groups of `least` rows or more."""
    counts = df.groupBy(*group).count().where(F.col("count") >= least).select(*group)
    return df.join(counts, group, "left_semi")


def groups_in_both(train: DataFrame, evaluation: DataFrame, group: list[str]) -> DataFrame:
    return train.select(*group).intersect(evaluation.select(*group))


def mask(df: DataFrame, keep) -> DataFrame:
    """Rows for which a function of the table's columns, by name, is true."""
    return df.where(keep({c: F.col(f"`{c}`") for c in df.columns}))


def name_layers(df: DataFrame, names: list[str], first: int = 0) -> DataFrame:
    """Columns from `first` on take the names, in order; the number must fit."""
    if len(names) != len(df.columns) - first:
        raise ValueError(f"{len(df.columns) - first} layers, {len(names)} names")
    return df.toDF(*df.columns[:first], *names)


def layer_names(df: DataFrame, first: int = 0) -> list[str]:
    return df.columns[first:]


def layer_count(df: DataFrame, first: int = 0) -> int:
    return len(df.columns) - first


def model_columns(df: DataFrame, target: int = 2, skip: tuple[int, ...] = (), variables: list[str] | None = None) -> tuple[str, list[str]]:
    """(target, covariates): all columns but the target and those skipped by place, or only the named ones."""
    names = [c for i, c in enumerate(df.columns) if i != target and i not in skip]
    if variables:
        missing = [v for v in variables if v not in names]
        if missing:
            raise ValueError(f"no columns {missing}")
        names = [c for c in names if c in variables]
    return df.columns[target], names


def with_place(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Each row's place, from 0, in an order that its columns fix; no task holds more than its range.

    The table is sorted by ranges, rows are counted a range, and each range starts where the others end.
    """
    from ..storage import stored

    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # a row a range
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.create_map(*(F.lit(x) for p, s in starts.items() for x in (p, s)))[F.col("_part")]
    return ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + start).drop("_part")


def rows_between(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows of places first to last (not itself)."""
    return with_place(df, order, "_place").where(F.col("_place").between(first, last - 1)).drop("_place")


def side_by_side(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Columns of two tables next to each other by place; the shorter one's are null beyond its end."""
    left, right = with_place(a, order_a, "_place"), with_place(b, order_b, "_place")
    return left.join(right, "_place", "full").drop("_place")


def feasible_regions(train: DataFrame, evaluation: DataFrame, group: list[str], parameters: int | None = None, validation: DataFrame | None = None) -> DataFrame:
    """Regions that have rows in all tables, and, for joint components of `parameters` columns, no fewer rows than those."""
    counted = lambda df, n: df.groupBy(*group).agg(F.count("*").alias(n))
    out = counted(train, "n_train").join(counted(evaluation, "n_evaluation"), group)
    if validation is not None:
        out = out.join(counted(validation, "n_validation"), group)
    return out if parameters is None else out.where(F.least("n_train", "n_evaluation") >= parameters)


def preview(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first rows in an order: a look at a table, by a bounded heap in each task."""
    return df.orderBy(*order).limit(n)

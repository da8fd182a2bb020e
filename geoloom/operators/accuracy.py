"""Accuracy: predictions against observations, and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import metric_line
from .stats import r_squared, rmse

KEY = ["year", "month", "reg_type", "region", "method"]


def residuals(observed: DataFrame, predicted: DataFrame, digits: int = 9) -> DataFrame:
    """(x, y, old, new, delta, relative) of points in both, by coordinates rounded half to even.

    observed (x, y, z), predicted (x, y, sm); relative is null where the old value is 0.
    """
    key = lambda c: F.bround(c, digits).alias(c)
    both = observed.select(key("x"), key("y"), F.col("z").alias("old")).join(predicted.select(key("x"), key("y"), F.col("sm").alias("new")), ["x", "y"]).na.drop()
    delta = F.col("new") - F.col("old")
    return both.withColumns({"delta": delta, "relative": F.try_divide(delta, F.col("old"))})


def metrics(pairs: DataFrame, group: list[str], predicted: str = "new", observed: str = "old") -> DataFrame:
    return pairs.groupBy(*group).agg(rmse(predicted, observed).alias("rmse"), r_squared(predicted, observed).alias("r2"), F.count("*").alias("n"))


def gather(rmse_lines: DataFrame, r2_lines: DataFrame) -> DataFrame:
    """One table of both metrics from their lines (column `value` of text files)."""
    parse = lambda df, name: df.select(*metric_line(F.col("value"))).withColumnRenamed("value", name)
    return parse(rmse_lines, "rmse").join(parse(r2_lines, "r2"), KEY, "left")

"""Preparation: exact-count hold-out, standardising, joint principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hold_out(df: DataFrame, key: str, fraction: float, seed: int, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Column held_out: of each group exactly bround(fraction * n) rows, by the order of md5(seed | key).

    Within a group ranks come in two steps: rows by the hash's first byte and half, whose counts give each bucket's
    offset, and ranks within a bucket; so no task sorts a whole table.
    """
    mark = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("_hash", mark).withColumn("_part", F.substring("_hash", 1, 3))
    counts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part") if group else Window.partitionBy(F.lit(0)).orderBy("_part")
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("_all", F.sum("_n").over(whole))
    ranked = rows.join(F.broadcast(counts) if not group else counts, [*group, "_part"])  # without groups: 4096 rows at most
    rank = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_hash", key)) + F.col("_before")
    return ranked.withColumn("held_out", rank <= F.bround(F.col("_all") * fraction)).drop("_hash", "_part", "_n", "_before", "_all")


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """Mean, minimum and population deviation of each, in one pass."""
    row = df.agg(*(f(c).alias(f"{n}|{c}") for c in columns for n, f in (("avg", F.avg), ("min", F.min), ("std", F.stddev_pop)))).first()
    return {c: (row[f"avg|{c}"], row[f"min|{c}"], row[f"std|{c}"]) for c in columns}


def standardise(fit_on: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """(c - mean) / population deviation of fit_on; a constant column is only centred."""
    known = moments(fit_on, columns)
    return df.withColumns({c: (F.col(c) - known[c][0]) / (known[c][2] or 1.0) for c in columns})


def shift_scale(df: DataFrame, columns: list[str], power: float = 1.0, from_minimum: bool = False) -> DataFrame:
    """((c - shift) / deviation) ** power; shift: mean, or minimum where powers need it."""
    known = moments(df, columns)
    return df.withColumns({c: F.pow((F.col(c) - known[c][1 if from_minimum else 0]) / (known[c][2] or 1.0), F.lit(power)) for c in columns})


def principal_axes(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, dict]:
    """Eigenvalues of 1 and more of the standardised columns' covariance (n - 1), and their axes.

    The covariance is one pass of aggregates; each axis has its largest entry positive.
    """
    known = moments(df, columns)
    scaled = standardise(df, df, columns)
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = scaled.agg(*(F.covar_samp(columns[i], columns[j]).alias(f"{i}|{j}") for i, j in cells)).first()
    cov = np.zeros((len(columns),) * 2)
    for i, j in cells:
        cov[i, j] = cov[j, i] = row[f"{i}|{j}"] or 0.0
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(columns))])
    n = int((values >= 1 - 1e-12).sum())
    return values[:n], axes[:, :n], known


def joint_pca(train: DataFrame, evaluation: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns replaced by Component0.., fitted on the first."""
    _, axes, known = principal_axes(train, columns)

    def project(df: DataFrame) -> DataFrame:
        def dot(k: int) -> Column:
            return sum(((F.col(c) - known[c][0]) / (known[c][2] or 1.0) * float(axes[i, k]) for i, c in enumerate(columns)), F.lit(0.0))

        return df.withColumns({f"Component{k}": dot(k) for k in range(axes.shape[1])}).drop(*columns)

    return project(train), project(evaluation)

"""Random forest regression on Spark ML, and scores of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import knn

#: Spark ML's own limit.
DEEPEST = 30
#: Shares of a deviation that count as equal.
SAME = 1e-9


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


def predict(evaluation: DataFrame, train: DataFrame, features: list[str], target: str = "z", trees: int = 50, depth: int = 20, seed: int = 0) -> DataFrame:
    """evaluation with column sm; depths beyond DEEPEST are cut to it."""
    forest = RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol="sm", numTrees=trees, maxDepth=min(depth, DEEPEST), featureSubsetStrategy="sqrt", seed=seed)
    return forest.fit(assembled(train, features)).transform(assembled(evaluation, features)).drop("_features")


def linear_scores(df: DataFrame, features: list[str], target: str = "z") -> DataFrame:
    """(feature, score): absolute coefficients of an unregularised regression."""
    model = LinearRegression(featuresCol="_features", labelCol=target, regParam=0.0, solver="normal", standardization=False).fit(assembled(df, features))
    return df.sparkSession.createDataFrame([(f, float(abs(c))) for f, c in zip(features, model.coefficients)], "feature string, score double")


def univariate_scores(df: DataFrame, features: list[str], target: str = "z", group: list[str] = []) -> DataFrame:  # noqa: B006
    """(group.., feature, score): the F statistic of each feature alone, from its correlation, in one pass."""
    row = df.groupBy(*group).agg(F.count("*").alias("_n"), *(F.corr(f, target).alias(f) for f in features))
    long = row.unpivot([*group, "_n"], features, "feature", "r")
    return long.select(*group, "feature", F.try_divide(F.col("r") ** 2 * (F.col("_n") - 2), 1 - F.col("r") ** 2).alias("score"))


def forest_scores(df: DataFrame, features: list[str], target: str = "z", trees: int = 100, seed: int = 0) -> DataFrame:
    model = RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=trees, seed=seed).fit(assembled(df, features))
    return df.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(features, model.featureImportances.toArray())], "feature string, score double")


def information_scores(df: DataFrame, features: list[str], target: str = "z", bins: int = 16) -> DataFrame:
    """(feature, score): mutual information of equal-width bins, by joint and marginal counts."""
    ends = df.agg(*(f(c).cast("double").alias(f"{n}|{c}") for c in [*features, target] for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def bin_of(c: str):
        lo, hi = ends[f"lo|{c}"], ends[f"hi|{c}"]
        return F.lit(0) if not hi or hi == lo else F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1))

    long = df.select(bin_of(target).cast("int").alias("b"), *(bin_of(f).cast("int").alias(f) for f in features)).unpivot(["b"], features, "feature", "a")
    joint = long.na.drop().groupBy("feature", "a", "b").agg(F.count("*").alias("n"))  # at most bins * bins rows a feature
    by = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    part = joint.select("feature", (F.col("n") / by() * F.log(F.col("n") * by() / (by("a") * by("b")))).alias("part"))
    return part.groupBy("feature").agg(F.sum("part").alias("score"))


def neighbour_information(df: DataFrame, features: list[str], target: str = "z", k: int = 3) -> DataFrame:
    """(feature, score): mutual information of each feature and the target by the k nearest neighbours of every row in
    both together (largest difference), and the counts of rows as near in either alone; not below 0.

    Both are divided by their deviation. The two columns of each feature are broadcast: for tables beyond
    knn.BROADCAST_BYTES use `information_scores`. Differences of less than SAME are none.
    """
    spark, names = df.sparkSession, [*features, target]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in names)).na.drop()
    n = rows.count()
    if n * len(names) * 8 > knn.BROADCAST_BYTES:
        raise ValueError("too many rows: use information_scores")
    if n <= k:
        return spark.createDataFrame([(f, 0.0) for f in features], "feature string, score double")
    table = rows.toArrow()
    columns = {c: table[c].to_numpy() / (np.std(table[c].to_numpy()) or 1.0) for c in names}
    sent, step = spark.sparkContext.broadcast(columns), 4096
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])  # digamma(m) = harmonic[m - 1] - gamma

    def near(values: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        order, reach = np.sort(values), np.maximum(reach - SAME, SAME)
        return np.searchsorted(order, at + reach, "left") - np.searchsorted(order, at - reach, "right")

    def run(batches):
        for b in batches:
            out, blocks = [], {}
            for place in b["id"].to_pylist():
                feature, first = features[place % len(features)], place // len(features) * step
                x, z = sent.value[feature], sent.value[target]
                both = np.column_stack([x, z])
                if feature not in blocks:
                    blocks = {feature: knn.Blocks(both, np.arange(n), z)}
                row, rank, _, gap, _ = blocks[feature].search(both[first : first + step], k + 1, np.maximum)  # the row itself is one
                reach = np.sqrt(gap[rank == k + 1])
                out.append((feature, float((harmonic[near(x, x[first : first + step], reach) - 1] + harmonic[near(z, z[first : first + step], reach) - 1]).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out]), pa.array([v for _, v in out])], ["feature", "part"])

    parts = spark.range(-(-n // step) * len(features)).mapInArrow(run, "feature string, part double")
    whole = float(harmonic[n - 1] + harmonic[k - 1])
    return parts.groupBy("feature").agg(F.greatest(F.lit(0.0), whole - F.sum("part") / n).alias("score"))


def ranked(scores: DataFrame, group: list[str], descending: bool = True) -> DataFrame:
    """Column rank within a group; ties by feature."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(order, "feature")))



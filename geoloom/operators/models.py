"""The models by name, their validation, their search, and models stored for later use.

Tables: training (tid, covariates.., target), evaluation (eid, covariates.., and whatever goes along). Every model is a
function of both that gives (eid, sm); a new one is a new entry of MODELS. A stored model is a folder: its settings and
scaling as one line of JSON, and what it was fitted to as Parquet or as a Spark ML model; `apply` reads it back and
keeps the evaluation table's own columns, so that tiles can be written apart.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import accuracy, forest, knn, local_polynomial, prep

Model = Callable[..., DataFrame]


def _nearest(k: int, weights: str):
    def run(train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", **how) -> DataFrame:
        return knn.weighted(knn.join(evaluation, train, how.get("k", k), features, target=target), how.get("weights", weights))

    return run


def _tuned(train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", max_k: int = 20, folds: int = 10, tries: int | None = 50, seed: int = 0) -> DataFrame:
    return knn_search(train, evaluation, features, target, max_k=max_k, folds=folds, tries=tries, seed=seed)[0]


def _forest(train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", trees: int = 300, depth: int = 30, seed: int = 0) -> DataFrame:
    return forest.predict(evaluation, train, features, target, trees=trees, depth=depth, seed=seed).select("eid", "sm")


def _local(train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", **how) -> DataFrame:
    return local_polynomial.predict(evaluation, train, features, target=target, **how).select("eid", "sm")


def _global(train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", **how) -> DataFrame:
    return local_polynomial.predict_global(evaluation, train, features, target=target, **how).select("eid", "sm")


MODELS: dict[str, Model] = {"1NN": _nearest(1, "uniform"), "KNN": _nearest(10, "uniform"), "KKNN": _tuned, "RF": _forest, "HYPPO": _local, "SBM": _global}


def run(name: str, train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", **how) -> DataFrame:
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    return MODELS[name](train, evaluation, features, target, **how)


def validated(name: str, train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", validate: float = 0.0, seed: int = 0, **how) -> tuple[DataFrame, DataFrame | None]:
    """(predictions of the evaluation rows, validation).

    validate 0: none. From 1 to below 2: rmse, r2 and n of held-out training rows, the share validate - 1 of them; at
    1 nothing is held out and all training rows are predicted. 2: the difference of every prediction from the
    evaluation table's own target, and relative to it.
    """
    if not (validate == 0 or 1 <= validate <= 2):
        raise ValueError(f"validate is 0, from 1 to below 2, or 2, not {validate}")
    if validate == 0:
        return run(name, train, evaluation, features, target, **how), None
    if validate == 2:
        found = run(name, train, evaluation, features, target, **how)
        pairs = found.join(evaluation.select("eid", F.col(target).alias("old")), "eid").withColumnRenamed("sm", "new")
        delta = F.col("new") - F.col("old")
        return found, pairs.select("eid", "old", "new", delta.alias("delta"), F.try_divide(delta, F.col("old")).alias("relative"))
    held = known = train
    if validate > 1:
        marked = prep.hold_out(train, "tid", validate - 1, seed)
        held, known = marked.where("held_out").drop("held_out"), marked.where("not held_out").drop("held_out")
    again = run(name, known, held.withColumnRenamed("tid", "eid"), features, target, **how)
    pairs = again.join(held.select(F.col("tid").alias("eid"), F.col(target).alias("old")), "eid").withColumnRenamed("sm", "new")
    return run(name, known, evaluation, features, target, **how), accuracy.metrics(pairs, [])


def _picked(options: list, tries: int | None, seed: int) -> list:
    """As many of the options as are tried, at random."""
    if tries is None or tries >= len(options):
        return options
    return [options[i] for i in sorted(np.random.default_rng(seed).choice(len(options), tries, replace=False))]


def knn_search(train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", *, max_k: int = 20, folds: int = 10, tries: int | None = 50, seed: int = 0) -> tuple[DataFrame, dict]:
    """(predictions, best): of `tries` pairs (k, weights) at random, the one of least error over folds, applied to
    scaled covariates. One neighbour join a fold serves all pairs."""
    known = prep.moments(train, features)
    scaled = lambda df: df.withColumns({c: (F.col(c) - known[c][0]) / (known[c][2] or 1.0) for c in features})
    tried = _picked([(k, w) for k in range(2, max_k) for w in ("uniform", "distance", "gaussian")], tries, seed)
    errors = {(r["k"], r["weights"]): r["rmse"] for r in knn.search(scaled(train), features, max_k - 1, folds, target=target).collect()}  # 3 * max_k rows
    k, weights = min((p for p in tried if p in errors), key=lambda p: (errors[p], p))
    found = knn.weighted(knn.join(scaled(evaluation), scaled(train), k, features, target=target), weights)
    return found, {"k": k, "weights": weights, "rmse": errors[k, weights]}


def forest_search(train: DataFrame, evaluation: DataFrame, features: list[str], target: str = "z", *, trees: tuple[int, ...] = (300, 500, 700), depths: tuple[int, ...] = (20, 30), tries: int | None = 10, folds: int = 10, seed: int = 0) -> tuple[DataFrame, dict]:
    """(predictions, best): of `tries` settings (trees, depth, bootstrap) at random, the one of least error over folds,
    fitted to all rows. Folds go by a hash of the id, so they do not depend on the rows' order."""
    rows = forest.assembled(train, features).withColumn("_fold", F.pmod(F.crc32(F.concat(F.lit(f"{seed}|"), F.col("tid").cast("string"))), F.lit(folds)))
    tried = _picked([(n, d, b) for n in trees for d in depths for b in (True, False)], tries, seed)

    def model(n: int, d: int, b: bool) -> RandomForestRegressor:
        return RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol="sm", numTrees=n, maxDepth=min(d, forest.DEEPEST), featureSubsetStrategy="sqrt", bootstrap=b, seed=seed)

    judge = RegressionEvaluator(predictionCol="sm", labelCol=target, metricName="mse")
    errors = {}
    for setting in tried:
        each = [judge.evaluate(model(*setting).fit(rows.where(F.col("_fold") != f)).transform(rows.where(F.col("_fold") == f))) for f in range(folds) if rows.where(F.col("_fold") == f).limit(1).count()]
        errors[setting] = float(np.mean(each))
    best = min(tried, key=lambda s: (errors[s], s))
    found = model(*best).fit(rows).transform(forest.assembled(evaluation, features))
    return found.select("eid", "sm"), {"trees": best[0], "depth": best[1], "bootstrap": best[2], "rmse": errors[best] ** 0.5}


def store(name: str, train: DataFrame, features: list[str], path: str, target: str = "z", **how) -> None:
    """Fit on scaled covariates and write all that `apply` needs to a folder in any store."""
    known = prep.moments(train, features)
    scaled = train.withColumns({c: (F.col(c) - known[c][0]) / (known[c][2] or 1.0) for c in features})
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    if name == "RF":
        fitted = RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol="sm", numTrees=how.get("trees", 300), maxDepth=min(how.get("depth", 30), forest.DEEPEST), featureSubsetStrategy="sqrt", seed=how.get("seed", 0)).fit(forest.assembled(scaled, features))
        fitted.write().overwrite().save(f"{path}/forest")
    else:
        scaled.select("tid", *features, target).write.mode("overwrite").parquet(f"{path}/rows")
    settings = {"model": name, "features": features, "target": target, "scaling": {c: [known[c][0], known[c][2]] for c in features}, "how": how}
    train.sparkSession.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def apply(spark: SparkSession, path: str, evaluation: DataFrame) -> DataFrame:
    """The evaluation table, whole, with column sm of a stored model. Rows for which it has none have null."""
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    features, target = settings["features"], settings["target"]
    scaled = reduce(lambda df, c: df.withColumn(c, (F.col(c) - settings["scaling"][c][0]) / (settings["scaling"][c][1] or 1.0)), features, evaluation.select("eid", *features))
    if settings["model"] == "RF":
        found = RandomForestRegressionModel.load(f"{path}/forest").transform(forest.assembled(scaled, features)).select("eid", "sm")
    else:
        found = run(settings["model"], spark.read.parquet(f"{path}/rows"), scaled, features, target, **settings["how"])
    return evaluation.join(found, "eid", "left")

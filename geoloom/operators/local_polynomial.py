"""Local polynomial regression over neighbourhoods.

Evaluation points that share their k nearest training rows share one model: the neighbourhood's sorted ids name it, its
rows go along once, and each distinct neighbourhood is fitted once in `applyInPandas`, with the others of its part.
The degree is the one of least summed error over folds, the lower of equal sums; with one fold a point (the default)
the choice does not depend on any shuffle.

Where a design has more columns than the rows determine, `Terms` says which take part: all, by the solution of least
norm; those that the lasso leaves; or a random choice. The global form takes all training rows but the farthest; on
many rows it is computed from sums over them, never from a list of neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import knn, prep

#: A fold's squared error counts at most this much.
MOST_ERROR = 9999.0
SCHEMA = "eid long, sm double, degree int"
#: The lasso's penalties, from the largest to the smallest that is tried.
PENALTIES = np.geomspace(1.0, 2.0**-9, 28)
#: Neighbourhoods that are fitted at once.
TOGETHER = 256
#: Neighbourhoods of one part of a shuffle, and ids that those list for each of their rows.
PART, LISTED = 1024, 1 << 17
#: Sweeps of coordinate descent at one penalty at most, and problems of the lasso that are solved one by one.
SWEEPS, ALONE = 4096, 8
#: Training rows up to which the global form may list its neighbours.
FEW = 2000


@dataclass(frozen=True)
class Terms:
    """How terms are chosen when there are too many. kind: least_norm, lasso or random (best of `tries` a fold)."""

    kind: str = "least_norm"
    tries: int = 10
    seed: int = 0


def design(points: np.ndarray, degree: int) -> np.ndarray:
    """Columns of all monomials up to the degree, the constant first, lower degrees before higher."""
    with_one = np.column_stack([np.ones(len(points)), points])
    picks = combinations_with_replacement(range(with_one.shape[1]), degree)
    return np.column_stack([with_one[:, list(p)].prod(1) for p in picks])


def degree_counts(coefficients: np.ndarray, variables: int, degree: int) -> list[int]:
    """How many monomials of each degree have a coefficient other than 0."""
    edges = np.cumsum([0, *(comb(variables + d - 1, d) if d else 1 for d in range(degree + 1))])
    return [int(np.count_nonzero(coefficients[a:b])) for a, b in zip(edges[:-1], edges[1:])]


def lasso(a: np.ndarray, values: np.ndarray, penalty: float, start: np.ndarray | None = None, sweeps: int = SWEEPS) -> np.ndarray:
    """Coordinate descent for |values - a w|^2 / 2n + penalty |w|, of centred columns and values.

    The columns are few: it goes on products of columns, as plain numbers.
    """
    products, bound = (a.T @ a).tolist(), penalty * len(values)
    w = [0.0] * a.shape[1] if start is None else start.tolist()
    pulls = (a.T @ (values - a @ np.array(w))).tolist()
    active = [j for j in range(len(w)) if products[j][j] > 0]
    for _ in range(sweeps):
        moved = 0.0
        for j in active:
            row, old = products[j], w[j]
            pull = pulls[j] + row[j] * old
            new = (pull - bound) / row[j] if pull > bound else (pull + bound) / row[j] if pull < -bound else 0.0
            if new != old:
                step = new - old
                w[j], moved = new, max(moved, abs(step))
                pulls = [p - g * step for p, g in zip(pulls, row)]
        if moved <= 1e-4 * max(1e-12, *map(abs, w)):
            break
    return np.array(w)


def lasso_terms(a: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """Columns beside the constant that the lasso leaves at the largest penalty with as many of them as can be had,
    `most` at best; none if no penalty leaves any."""
    centred = a[:, 1:] - a[:, 1:].mean(0)
    best, w = np.empty(0, int), None
    for penalty in PENALTIES:
        w = lasso(centred, values - values.mean(), penalty, w)
        chosen = np.flatnonzero(w) + 1
        if len(best) < len(chosen) <= most:
            best = chosen
        if len(chosen) >= most:
            break
    return best


def lasso_terms_together(designs: list[np.ndarray], values: list[np.ndarray], most: list[int]) -> list[np.ndarray]:
    """`lasso_terms` of many problems of as many columns, by the same steps, each problem at its own penalty and sweep.

    The last few problems go on one by one, where that is the faster way.
    """
    count, m, n = len(designs), designs[0].shape[1] - 1 if designs else 0, max(map(len, designs), default=0)
    best = [np.empty(0, int)] * count
    if not count or not m:
        return best
    a, z = np.zeros((count, n, m)), np.zeros((count, n))
    for i, (d, v) in enumerate(zip(designs, values)):
        a[i, : len(d)], z[i, : len(d)] = d[:, 1:] - d[:, 1:].mean(0), v - v.mean()
    rows, most = np.array([len(d) for d in designs]), np.array(most)
    lane, at, swept, going = np.arange(count), np.zeros(count, int), np.zeros(count, int), np.ones(count, bool)
    products = np.ascontiguousarray((a.transpose(0, 2, 1) @ a).transpose(1, 2, 0))
    w, pulls, bound = np.zeros((m, count)), (a.transpose(0, 2, 1) @ z[:, :, None])[:, :, 0].T.copy(), PENALTIES[0] * rows
    by = np.stack([np.where(products[j, j] > 0, products[j, j], 1.0) for j in range(m)])
    while going.sum() > ALONE:
        if going.mean() < 0.75:
            lane, at, swept, bound, w, pulls, by, products = (x[..., going] for x in (lane, at, swept, bound, w, pulls, by, products))
            going = np.ones(len(lane), bool)
        moved = np.zeros(len(lane))
        for j in range(m):
            pull = products[j, j] * w[j]
            pull += pulls[j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - bound, 0.0) / by[j]
            step = new - w[j]
            w[j] = new
            np.maximum(moved, np.abs(step), out=moved)
            pulls -= products[j] * step
        swept += 1
        for i in np.flatnonzero(going & ((moved <= 1e-4 * np.maximum(1e-12, np.abs(w).max(0))) | (swept == SWEEPS))).tolist():
            k, chosen = lane[i], np.flatnonzero(w[:, i]) + 1
            if len(best[k]) < len(chosen) <= most[k]:
                best[k] = chosen
            at[i], swept[i] = at[i] + 1, 0
            if len(chosen) >= most[k] or at[i] == len(PENALTIES):
                going[i] = False
            else:
                bound[i], pulls[:, i] = PENALTIES[at[i]] * rows[k], a[k].T @ (z[k] - a[k] @ w[:, i])
    for k in lane[going].tolist():
        best[k] = lasso_terms(designs[k], values[k], most[k])
    return best


def _of_columns(a: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    out = np.zeros(a.shape[1])
    out[chosen] = np.linalg.lstsq(a[:, chosen], values, rcond=None)[0]
    return out


def solve(points: np.ndarray, values: np.ndarray, degree: int, tried: list[np.ndarray] | None = None, terms: Terms = Terms(), rng: np.random.Generator | None = None) -> np.ndarray:
    """Least squares. Where columns outnumber what the rows determine: with coefficients from earlier fits, only the
    terms take part whose sum there is among the largest, as many as rows (more where equal); without, as `terms` says.
    """
    return _solved(design(points, degree), values, tried, terms, rng)


def _solved(a: np.ndarray, values: np.ndarray, tried: list[np.ndarray] | None = None, terms: Terms = Terms(), rng: np.random.Generator | None = None) -> np.ndarray:
    n, m = a.shape
    if m <= n and np.linalg.matrix_rank(a) == m:
        return np.linalg.solve(a.T @ a, a.T @ values)
    if terms.kind == "lasso":
        return _of_columns(a, values, np.concatenate([[0], lasso_terms(a, values, n - 1)]))
    if tried:
        size = np.abs(np.array(tried).sum(0))
        least = np.sort(size)[::-1][min(n, m) - 1]
        return _of_columns(a, values, np.flatnonzero(size >= least if least > 0 else size > 0))
    if terms.kind == "random" and rng is not None:
        return _of_columns(a, values, np.concatenate([[0], 1 + np.sort(rng.choice(m - 1, min(n - 1, m - 1), replace=False))]))
    return np.linalg.lstsq(a, values, rcond=None)[0]


def choose_degree(points: np.ndarray, values: np.ndarray, most: int, folds: int | None = None, terms: Terms = Terms()) -> tuple[int, list[np.ndarray], list[float]]:
    """The degree of least summed error, its fits' coefficients, and all degrees' errors.

    folds: as many, dealt out at random by terms.seed; one a point by default.
    """
    n, rng = len(points), np.random.default_rng([terms.seed, len(points)])
    fold = np.arange(n) if folds is None or folds >= n else rng.permutation(n) % folds
    errors, fits_of = [], []
    for degree in range(most + 1):
        total, fits = 0.0, []
        for k in range(fold.max() + 1 if n > 1 else 0):
            inside, best, kept = fold != k, MOST_ERROR, None
            if not inside.any():
                continue
            held = design(points[~inside], degree)
            for _ in range(terms.tries if terms.kind == "random" else 1):
                fit = solve(points[inside], values[inside], degree, terms=terms, rng=rng)
                missed = float(((held @ fit - values[~inside]) ** 2).sum())
                if kept is None or missed < best:
                    kept = fit
                best = min(best, missed) if np.isfinite(missed) else best
            fits.append(kept)
            total += best
        errors.append(total)
        fits_of.append(fits)
    chosen = int(np.argmin(errors))
    return chosen, fits_of[chosen], errors


def predict(evaluation: DataFrame, train: DataFrame, features: list[str], *, k: int = 10, degree: int = 3, eid: str = "eid", tid: str = "tid", target: str = "z", low: float = 0.0, high: float = 1.0, folds: int | None = None, terms: Terms = Terms(), details: bool = False) -> DataFrame:
    """(eid, sm, degree[, errors, counts]), sm within [low, high].

    details: every degree's summed error, and how many monomials of each degree the model has.

    While the training rows may be broadcast, neighbourhoods are found and fitted where the evaluation rows are, those
    of a batch together, and nothing is shuffled; beyond that, neighbourhoods meet their rows in a cogroup.
    """
    sent = knn.broadcast_blocks(train, features, tid=tid, target=target) if terms.kind == "least_norm" and folds is None and not details else None
    if sent is not None:
        return _predict_in_place(knn._vectors(evaluation, eid, "eid", features, None), sent, k, degree, low, high)
    near = knn.join(evaluation, train, k, features, eid=eid, tid=tid, target=target)
    hoods = near.groupBy("eid").agg(F.array_sort(F.collect_list("tid")).alias("hood"))  # k ids a row
    asked = hoods.join(evaluation.select(F.col(eid).cast("long").alias("eid"), F.array(*(F.col(f).cast("double") for f in features)).alias("point")), "eid")
    members = asked.select(F.col("hood").alias("of")).distinct().select("of", F.explode("of").alias("tid"))
    members = members.join(train.select(F.col(tid).cast("long").alias("tid"), F.array(*(F.col(f).cast("double") for f in features)).alias("point"), F.col(target).cast("double").alias("z")), "tid")
    schema = SCHEMA + (", errors array<double>, counts array<int>" if details else "")
    spark = evaluation.sparkSession
    cores, per = spark.sparkContext.defaultParallelism, max(1, min(PART, LISTED // max(k, 1) ** 2))
    parts = max(-(-evaluation.count() // per), 2 * cores)
    tasks = min(parts, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # fitting is long for few bytes: as many tasks as named, which are not put together by their bytes
    dealt = lambda df, hood: df.withColumn("part", F.pmod(F.xxhash64(hood), F.lit(parts))).repartition(tasks, "part").groupBy("part")

    def fit(key, points: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = {c.split()[0]: [] for c in schema.split(", ")}
        if points.empty or rows.empty:
            return pd.DataFrame(found)
        asked_of, known = ({h: group for h, group in df.groupby(df[c].map(lambda ids: ids.tobytes()), sort=True)} for df, c in ((points, "hood"), (rows, "of")))
        hoods = [h for h in asked_of if h in known]
        known = [known[h].sort_values("tid") for h in hoods]
        x, z = [np.stack(r.point.to_numpy()) for r in known], [r.z.to_numpy() for r in known]
        shift, scale = [p.mean(0) for p in x], [p.std(0) for p in x]
        for s in scale:
            s[s == 0] = 1.0
        x = [(p - m) / s for p, m, s in zip(x, shift, scale)]
        for h, (chosen, model, errors) in enumerate(_chosen(x, z, degree, folds, terms)):
            mine = asked_of[hoods[h]]
            out = design((np.stack(mine.point.to_numpy()) - shift[h]) / scale[h], chosen) @ model
            found["eid"] += mine.eid.tolist()
            found["sm"] += np.clip(out, low, high).tolist()
            found["degree"] += [chosen] * len(mine)
            if details:
                counts = degree_counts(model, x[h].shape[1], chosen)
                found["errors"] += [errors] * len(mine)
                found["counts"] += [counts + [0] * (degree - chosen)] * len(mine)
        return pd.DataFrame(found)

    return dealt(asked, "hood").cogroup(dealt(members, "of")).applyInPandas(fit, schema)


def _chosen(points: list[np.ndarray], values: list[np.ndarray], most: int, folds: int | None, terms: Terms) -> list[tuple[int, np.ndarray, list[float]]]:
    """(degree, model, errors) of neighbourhoods: together those of as many rows, where the lasso chooses terms."""
    out = [None] * len(points)
    if terms.kind == "lasso":
        for n in {len(z) for z in values}:
            mine = [h for h, z in enumerate(values) if len(z) == n]
            for h, found in zip(mine, choose_together(np.stack([points[h] for h in mine]), np.stack([values[h] for h in mine]), most, folds, terms)):
                out[h] = found
        return out
    for h, (x, z) in enumerate(zip(points, values)):
        chosen, fits, errors = choose_degree(x, z, most, folds, terms)
        out[h] = chosen, solve(x, z, chosen, fits, terms), errors
    return out


def _predict_in_place(rows: DataFrame, sent, k: int, degree: int, low: float, high: float) -> DataFrame:
    def run(batches):
        blocks = sent.value
        for b in batches:
            if not len(b):
                continue
            points = knn._matrix(b["v"], blocks.points.shape[1])
            _, _, tid, _, _ = blocks.search(points, k)
            hoods, which = np.unique(np.sort(tid.reshape(len(points), -1), axis=1), axis=0, return_inverse=True)
            which, out, degrees = which.ravel(), np.empty(len(points)), np.empty(len(points), np.int32)
            for at in range(0, len(hoods), TOGETHER):
                place = blocks.places(hoods[at : at + TOGETHER])
                x = blocks.points[place]
                shift, scale = x.mean(1, keepdims=True), x.std(1, keepdims=True)
                scale[scale == 0] = 1.0
                chosen, models = fit_together((x - shift) / scale, blocks.z[place], degree)
                for h in range(len(place)):
                    mine = np.flatnonzero(which == at + h)
                    out[mine] = design((points[mine] - shift[h]) / scale[h], chosen[h]) @ models[h]
                    degrees[mine] = chosen[h]
            yield pa.RecordBatch.from_arrays([b["eid"], pa.array(np.clip(out, low, high)), pa.array(degrees)], ["eid", "sm", "degree"])

    return rows.mapInArrow(run, SCHEMA)


def fit_together(points: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(degrees, models) of many neighbourhoods (H, n, variables) at once: `choose_degree` and `solve`, each point a fold."""
    count, n, variables = points.shape
    folds = np.array([[j for j in range(n) if j != i] for i in range(n)], int).reshape(n, n - 1)
    errors, fits, designs = [], [], []
    for d in range(most + 1):
        a = design(points.reshape(-1, variables), d).reshape(count, n, -1)
        designs.append(a)
        if n < 2:
            errors.append(np.zeros(count))
            fits.append(np.zeros((count, 0, a.shape[2])))
            continue
        size = max(n - 1, a.shape[2])
        w = (np.linalg.pinv(a[:, folds], rcond=size * np.finfo(float).eps) @ values[:, folds][..., None])[..., 0]
        missed = ((a * w).sum(2) - values) ** 2
        errors.append(np.where(np.isfinite(missed), np.minimum(missed, MOST_ERROR), MOST_ERROR).sum(1))
        fits.append(w)
    degrees, models = np.argmin(np.stack(errors, 1), axis=1), []
    for h, d in enumerate(degrees.tolist()):
        models.append(_solved(designs[d][h], values[h], list(fits[d][h])))
    return degrees, models


def choose_together(points: np.ndarray, values: np.ndarray, most: int, folds: int | None = None, terms: Terms = Terms("lasso")) -> list[tuple[int, np.ndarray, list[float]]]:
    """(degree, model, errors) of many neighbourhoods (H, n, variables): `choose_degree` and `solve` where the lasso chooses terms."""
    count, n, variables = points.shape
    fold = np.arange(n) if folds is None or folds >= n else np.random.default_rng([terms.seed, n]).permutation(n) % folds
    designs = [design(points.reshape(-1, variables), d).reshape(count, n, -1) for d in range(most + 1)]
    errors = np.zeros((count, most + 1))
    for d, a in enumerate(designs):
        parts = [fold != k for k in range(fold.max() + 1 if n > 1 else 0)]
        parts = [inside for inside in parts if inside.any()]
        fits = _solved_together([a[h, inside] for inside in parts for h in range(count)], [values[h, inside] for inside in parts for h in range(count)])
        for k, inside in enumerate(parts):
            missed = np.array([float(((a[h, ~inside] @ fits[k * count + h] - values[h, ~inside]) ** 2).sum()) for h in range(count)])
            errors[:, d] += np.where(np.isfinite(missed), np.minimum(missed, MOST_ERROR), MOST_ERROR)
    degrees, models = errors.argmin(1), [None] * count
    for d in range(most + 1):
        mine = np.flatnonzero(degrees == d).tolist()
        for h, model in zip(mine, _solved_together([designs[d][h] for h in mine], [values[h] for h in mine])):
            models[h] = model
    return list(zip(degrees.tolist(), models, errors.tolist()))


def _solved_together(designs: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """`_solved` of many designs of as many columns, where the lasso chooses terms."""
    short = [a.shape[1] > a.shape[0] or np.linalg.matrix_rank(a) < a.shape[1] for a in designs]
    left = [i for i, s in enumerate(short) if s]
    terms = dict(zip(left, lasso_terms_together([designs[i] for i in left], [values[i] for i in left], [len(values[i]) - 1 for i in left])))
    return [_of_columns(a, z, np.concatenate([[0], terms[i]])) if i in terms else np.linalg.solve(a.T @ a, a.T @ z) for i, (a, z) in enumerate(zip(designs, values))]


def farthest(evaluation: DataFrame, train: DataFrame, features: list[str], eid: str, tid: str) -> DataFrame:
    """(eid, far): the training row farthest from each evaluation row, the largest id of equally far ones.

    Training rows meet evaluation rows in blocks; only the farthest of each block is passed on.
    """
    width = len(features)
    vector = lambda df, i, name: df.select(F.col(i).cast("long").alias(name), F.array(*(F.col(f).cast("double") for f in features)).alias("v"))
    right, left = vector(train, tid, "tid"), vector(evaluation, eid, "eid")
    parts = max(1, -(-right.count() // knn.BLOCK_ROWS))
    blocks = right.withColumn("block", F.pmod(F.xxhash64("tid"), F.lit(parts)).cast("int"))
    ends = [f(F.col("v")[c]).alias(f"{name}{c}") for name, f in (("lo", F.min), ("hi", F.max)) for c in range(width)]
    boxes = blocks.groupBy("block").agg(*ends).toArrow()  # a row for BLOCK_ROWS rows
    numbers = boxes["block"].to_numpy()
    low, high = (np.column_stack([boxes[f"{e}{c}"].to_numpy() for c in range(width)]) for e in ("lo", "hi"))

    def reach(batches):
        for b in batches:
            if len(b):
                points = knn._matrix(b["v"], width)
                most = sum(np.maximum(np.abs(points[:, c, None] - low[None, :, c]), np.abs(points[:, c, None] - high[None, :, c])) ** 2 for c in range(width))
                row, block = np.nonzero(most >= knn._gaps(points, low, high).max(1)[:, None])
                yield pa.RecordBatch.from_arrays([b["eid"].take(pa.array(row)), b["v"].take(pa.array(row)), pa.array(numbers[block])], ["eid", "v", "block"])

    def meet(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"eid": [], "tid": [], "gap": []})
        b = b.sort_values("tid", ascending=False)
        points, others, best = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy()), []
        for at in range(0, len(points), 256):
            d = sum((points[at : at + 256, c, None] - others[None, :, c]) ** 2 for c in range(width))
            best.append(np.stack([d.argmax(1), d.max(1)]))
        place, gap = np.concatenate(best, 1)
        return pd.DataFrame({"eid": a.eid, "tid": b.tid.to_numpy()[place.astype(int)], "gap": gap})

    asked = left.mapInArrow(reach, "eid long, v array<double>, block int").withColumn("chunk", F.pmod(F.xxhash64("eid"), F.lit(64)).cast("int"))
    copies = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(63))))
    found = asked.groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk")).applyInPandas(meet, "eid long, tid long, gap double")
    return found.groupBy("eid").agg(F.max(F.struct("gap", "tid"))["tid"].alias("far"))


def predict_global(evaluation: DataFrame, train: DataFrame, features: list[str], *, degree: int = 3, eid: str = "eid", tid: str = "tid", target: str = "z", low: float = 0.0, high: float = 1.0, few: int = FEW, **how) -> DataFrame:
    """All training rows but the farthest are the neighbourhood.

    On more than `few` rows: the normal equations are one sum over the rows for each degree; a farthest row's share is
    taken off; a second pass sums the errors of leaving each row out, from its residual and leverage. Fits do not
    depend on the columns' scale, so one scale serves all.
    """
    n = train.count()
    if n <= few or how:
        return predict(evaluation, train, features, k=max(1, n - 1), degree=degree, eid=eid, tid=tid, target=target, low=low, high=high, **how)
    known = prep.moments(train, features)
    scaled = lambda c: (F.col(c).cast("double") - known[c][0]) / (known[c][2] or 1.0)
    rows = train.select(F.col(tid).cast("long").alias("tid"), F.array(*map(scaled, features)).alias("v"), F.col(target).cast("double").alias("z"))
    far = stored(farthest(evaluation, train, features, eid, tid), "far")
    gone = rows.join(far.select(F.col("far").alias("tid")).distinct(), "tid").orderBy("tid").toArrow()  # rows on the hull
    ids, width = gone["tid"].to_numpy(), len(features)
    gone_x, gone_z = knn._matrix(gone["v"], width), gone["z"].to_numpy()
    sizes = [comb(width + d, d) for d in range(degree + 1)]

    def sums(batches):
        total = [np.zeros((m + 1, m + 1)) for m in sizes]
        for b in batches:
            for d in range(degree + 1):
                a = np.column_stack([design(knn._matrix(b["v"], width), d), b["z"].to_numpy()])
                total[d] += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(range(degree + 1)), pa.array([t.ravel() for t in total], pa.list_(pa.float64()))], ["degree", "total"])

    matrices = [0.0] * (degree + 1)
    for r in rows.mapInArrow(sums, "degree long, total array<double>").toLocalIterator():  # one small matrix a task
        matrices[r.degree] = matrices[r.degree] + np.array(r.total).reshape(sizes[r.degree] + 1, -1)
    models = {}
    for d in range(degree + 1):
        for i, x, z in zip(ids.tolist(), gone_x, gone_z):
            a = np.append(design(x[None], d)[0], z)
            left = matrices[d] - np.outer(a, a)
            if np.linalg.matrix_rank(left[:-1, :-1]) == sizes[d]:
                inverse = np.linalg.inv(left[:-1, :-1])
                models[d, i] = inverse @ left[:-1, -1], inverse

    def errors(batches):
        total = {key: 0.0 for key in models}
        for b in batches:
            x, z, t = knn._matrix(b["v"], width), b["z"].to_numpy(), b["tid"].to_numpy()
            for d in range(degree + 1):
                a = design(x, d)
                for (e, i), (w, inverse) in models.items():
                    if e == d:
                        missed = (z - a @ w) / (1 - ((a @ inverse) * a).sum(1))
                        total[e, i] += np.where(t == i, 0.0, np.minimum(np.where(np.isfinite(missed), missed**2, MOST_ERROR), MOST_ERROR)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.float64())], ["degree", "far", "error"])

    summed = rows.mapInArrow(errors, "degree long, far long, error double").groupBy("far", "degree").agg(F.sum("error").alias("error"))
    best = {r.far: r.degree for r in summed.groupBy("far").agg(F.min(F.struct("error", "degree"))["degree"].alias("degree")).collect()}
    chosen = {i: (d, models[d, i][0]) for i, d in best.items()}
    asked = evaluation.select(F.col(eid).cast("long").alias("eid"), F.array(*map(scaled, features)).alias("v")).join(far, "eid")

    def apply(batches):
        for b in batches:
            x, f = knn._matrix(b["v"], width), b["far"].to_numpy()
            out, degrees = np.zeros(len(f)), np.zeros(len(f), np.int32)
            for i in np.unique(f).tolist():
                mine = f == i
                degrees[mine], w = chosen[i]
                out[mine] = design(x[mine], chosen[i][0]) @ w
            yield pa.RecordBatch.from_arrays([b["eid"], pa.array(np.clip(out, low, high)), pa.array(degrees)], ["eid", "sm", "degree"])

    return asked.select("eid", "v", "far").mapInArrow(apply, SCHEMA)

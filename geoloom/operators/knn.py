"""k nearest neighbours: one join serves the mean, the weighted means and the choice of parameters.

Training rows lie in blocks of a k-d tree, whose splits come from a bounded sample. An evaluation row is compared with
its own block first, which bounds its k-th distance, and then only with the blocks whose box is within that bound.
While the training rows fit BROADCAST_BYTES they are broadcast as such blocks; beyond it both sides meet in shuffles by
block, evaluation rows in parts of bounded size, first at their own block and then at those within the bound, and the
findings are merged. Either way every distance that counts is computed and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gaussian
from ..storage import stored

BROADCAST_BYTES = 64 << 20
#: Training rows of a block, and evaluation rows that meet it at once.
BLOCK_ROWS = 50_000
#: Rows of a block of the broadcast form, which is searched in one go.
LEAF_ROWS = 512
#: Training rows whose coordinates give the splits.
SAMPLE = 100_000
JOIN_SCHEMA = "eid long, rank int, tid long, distance double, z double"
FIELDS = ["eid", "rank", "tid", "distance", "z"]


class Tree:
    """Splits (axis, value) of space into leaves; leaf numbers follow the order of the splits."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.root, self.leaves = self._split(points, leaves, 0)

    def _split(self, points: np.ndarray, leaves: int, number: int):
        axis = int(np.argmax(points.max(0) - points.min(0))) if len(points) else 0
        if leaves < 2 or len(points) < 2 or points[:, axis].min() == points[:, axis].max():
            return number, number + 1
        value = float(np.median(points[:, axis]))
        if not (points[:, axis] < value).any():  # the least value is more than half of them
            value = float(points[points[:, axis] > value, axis].min())
        low = points[:, axis] < value
        left, number = self._split(points[low], leaves // 2, number)
        right, number = self._split(points[~low], leaves - leaves // 2, number)
        return (axis, value, left, right), number

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)

        def go(node, rows):
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                low = points[rows, node[0]] < node[1]
                go(node[2], rows[low])
                go(node[3], rows[~low])

        go(self.root, np.arange(len(points)))
        return out


def _gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray, norm=np.add) -> np.ndarray:
    """Squared distances of points from boxes, a row for each point: never above what `_nearest` finds within."""
    out = np.zeros((len(points), len(low)))
    for c in range(points.shape[1]):
        norm(out, np.maximum(np.maximum(low[None, :, c] - points[:, c, None], points[:, c, None] - high[None, :, c]), 0) ** 2, out=out)
    return out


def _nearest(points: np.ndarray, train: np.ndarray, tids: np.ndarray, z: np.ndarray, k: int, norm=np.add):
    """(row, tid, squared distance, z) of the k nearest of each point, by (distance, id).

    norm puts the squares of the coordinates' differences together: np.add, or np.maximum for the largest.
    """
    order = np.argsort(tids, kind="stable")
    train, tids, z = train[order], tids[order], z[order]
    k, found = min(k, len(tids)), []
    for at in range(0, len(points), 256):
        part = points[at : at + 256]
        d = np.zeros((len(part), len(train)))
        for c in range(train.shape[1]):
            norm(d, (part[:, c, None] - train[None, :, c]) ** 2, out=d)
        bound = np.partition(d, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(d <= bound[:, None])
        gap = d[row, col]
        rank = np.lexsort((col, gap, row))
        row, col, gap = row[rank], col[rank], gap[rank]
        first = np.searchsorted(row, row)
        near = np.arange(len(row)) - first < k
        found.append((row[near] + at, tids[col[near]], gap[near], z[col[near]]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]


def _merged(found: list, k: int):
    """The k nearest of each row of several findings, in order, with their ranks."""
    row, tid, gap, z = (np.concatenate([f[c] for f in found]) for c in range(4))
    order = np.lexsort((tid, gap, row))
    row, tid, gap, z = row[order], tid[order], gap[order], z[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    near = rank <= k
    return row[near], rank[near], tid[near], gap[near], z[near]


class Blocks:
    """Training rows in the leaves of a tree, with the box of each."""

    def __init__(self, points: np.ndarray, tids: np.ndarray, z: np.ndarray):
        self.tree = Tree(points, max(1, len(points) // LEAF_ROWS))
        leaf = self.tree.leaf(points)
        order = np.argsort(leaf, kind="stable")
        self.points, self.tids, self.z = points[order], tids[order], z[order]
        starts = np.searchsorted(leaf[order], np.arange(self.tree.leaves + 1))
        self.spans = [(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        full = [(a, b) for a, b in self.spans if b > a]
        self.where = np.cumsum([b > a for a, b in self.spans]) - 1  # a leaf's block, or one near it
        self.spans = full
        self.low = np.array([self.points[a:b].min(0) for a, b in full])
        self.high = np.array([self.points[a:b].max(0) for a, b in full])

    def places(self, tids: np.ndarray) -> np.ndarray:
        """Where the rows of some ids are, any shape."""
        order = np.argsort(self.tids, kind="stable")
        return order[np.searchsorted(self.tids, tids, sorter=order)]

    def search(self, points: np.ndarray, k: int, norm=np.add):
        """(row, rank, tid, squared distance, z) of the k nearest of each point."""
        own = np.maximum(self.where[self.tree.leaf(points)], 0)
        gaps = _gaps(points, self.low, self.high, norm)
        found, bound = [], np.full(len(points), np.inf)
        for mine in (True, False):
            for block, (a, b) in enumerate(self.spans):
                rows = np.flatnonzero((own == block) if mine else (own != block) & (gaps[:, block] <= bound))
                if len(rows):
                    row, tid, gap, z = _nearest(points[rows], self.points[a:b], self.tids[a:b], self.z[a:b], k, norm)
                    found.append((rows[row], tid, gap, z))
                    if b - a >= k:
                        bound[rows] = np.minimum(bound[rows], np.maximum.reduceat(gap, np.arange(0, len(gap), k)))
        return _merged(found, k) if found else [np.empty(0)] * 5


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _batch(eid, rank, tid, gap, z) -> pa.RecordBatch:
    types = (np.int64, np.int32, np.int64, np.float64, np.float64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t)) for c, t in zip((eid, rank, tid, np.sqrt(np.asarray(gap, float)), z), types)], FIELDS)


def broadcast_blocks(train: DataFrame, features: list[str], *, tid: str = "tid", target: str = "z", scale: list[float] | None = None):
    """The training rows with whole coordinates and target as broadcast Blocks; None of no rows, or beyond BROADCAST_BYTES."""
    right = _vectors(train, tid, "tid", features, scale, F.col(target).cast("double").alias("z")).na.drop()
    n, width = right.count(), len(features)
    if not n or n * (width + 2) * 8 > BROADCAST_BYTES:
        return None
    table = right.toArrow()
    return train.sparkSession.sparkContext.broadcast(Blocks(_matrix(table["v"], width), table["tid"].to_numpy(), table["z"].to_numpy()))


def _vectors(df: DataFrame, key: str, name: str, features: list[str], scale: list[float] | None, *more: Column) -> DataFrame:
    """(name, v, more..): rows whose coordinates are all there, as an array."""
    vector = F.array(*(F.col(c).cast("double") * s for c, s in zip(features, scale or [1.0] * len(features))))
    rows = df.select(F.col(key).cast("long").alias(name), vector.alias("v"), *more)
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def join(evaluation: DataFrame, train: DataFrame, k: int, features: list[str], *, eid: str = "eid", tid: str = "tid", target: str = "z", scale: list[float] | None = None) -> DataFrame:
    """(eid, rank, tid, distance, z): distance is the root of the sum of (scale * difference) ** 2."""
    width, left = len(features), _vectors(evaluation, eid, "eid", features, scale)
    sent = broadcast_blocks(train, features, tid=tid, target=target, scale=scale)
    if sent is None:
        right = _vectors(train, tid, "tid", features, scale, F.col(target).cast("double").alias("z")).na.drop()
        n = right.count()
        return _join_blocks(left, right, n, k, width) if n else evaluation.sparkSession.createDataFrame([], JOIN_SCHEMA)

    def run(batches):
        for b in batches:
            if len(b):
                row, *rest = sent.value.search(_matrix(b["v"], width), k)
                yield _batch(b["eid"].to_numpy()[row.astype(np.int64)], *rest)

    return left.mapInArrow(run, JOIN_SCHEMA)


def _join_blocks(left: DataFrame, right: DataFrame, n: int, k: int, width: int) -> DataFrame:
    spark = left.sparkSession
    share = min(1.0, 1.2 * SAMPLE / n)
    sample = _matrix(right.select("v").sample(share, 7).limit(SAMPLE).toArrow()["v"], width)
    tree = Tree(sample, -(-n // BLOCK_ROWS))

    def placed(df: DataFrame, name: str) -> DataFrame:
        def run(batches):
            for b in batches:
                yield b.append_column("block", pa.array(tree.leaf(_matrix(b["v"], width)))) if len(b) else b.append_column("block", pa.array([], pa.int32()))

        return stored(df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", block int"), name)

    right, left = placed(right, "train"), placed(left, "asked")
    ends = [f(F.col("v")[c]).alias(f"{name}{c}") for name, f in (("lo", F.min), ("hi", F.max)) for c in range(width)]
    boxes = right.groupBy("block").agg(F.count("*").alias("n"), *ends).orderBy("block").toArrow()  # a row for BLOCK_ROWS rows
    numbers = boxes["block"].to_numpy()
    low, high = (np.column_stack([boxes[f"{e}{c}"].to_numpy() for c in range(width)]) for e in ("lo", "hi"))

    def meet(asked: DataFrame) -> DataFrame:
        """(eid, tid, gap, z) of the k nearest within the block of each row (eid, v, block)."""
        chunk = F.pmod(F.xxhash64("eid"), F.col("parts")).cast("int")
        counts = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))  # a row a block
        dealt = asked.join(F.broadcast(counts), "block").withColumn("chunk", chunk)
        copies = right.join(F.broadcast(counts), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def run(key, a, b):
            import pandas as pd

            if not len(a) or not len(b):
                return pd.DataFrame({"eid": [], "tid": [], "gap": [], "z": []})
            row, tid, gap, z = _nearest(np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy()), b.tid.to_numpy(), b.z.to_numpy(), k)
            return pd.DataFrame({"eid": a.eid.to_numpy()[row], "tid": tid, "gap": gap, "z": z})

        return dealt.select("eid", "v", "block", "chunk").groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk")).applyInPandas(run, "eid long, tid long, gap double, z double")

    def elsewhere(batches):
        """Rows (eid, v, block) of the other blocks that a row's bound reaches; all of them where it has none."""
        for b in batches:
            if not len(b):
                continue
            gaps = _gaps(_matrix(b["v"], width), low, high)
            bound = b["bound"].to_numpy(zero_copy_only=False)
            reach = gaps <= np.where(np.isnan(bound), np.inf, bound)[:, None]
            reach &= numbers[None, :] != b["block"].to_numpy()[:, None]
            row, block = np.nonzero(reach)
            yield pa.RecordBatch.from_arrays([b["eid"].take(pa.array(row)), b["v"].take(pa.array(row)), pa.array(numbers[block].astype(np.int32))], ["eid", "v", "block"])

    first = stored(meet(left), "near")
    bounds = first.groupBy("eid").agg(F.max("gap").alias("bound"), F.count("*").alias("m")).select("eid", F.when(F.col("m") >= k, F.col("bound")).alias("bound"))
    others = left.join(bounds, "eid", "left").select("eid", "v", "block", "bound").mapInArrow(elsewhere, "eid long, v array<double>, block int")
    near = first.unionByName(meet(stored(others, "reach")))
    rank = F.row_number().over(Window.partitionBy("eid").orderBy("gap", "tid"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("eid", "rank", "tid", F.sqrt("gap").alias("distance"), "z")


def mean(neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """(eid, sm): the plain mean of the first k."""
    near = neighbours if k is None else neighbours.where(F.col("rank") <= k)
    return near.groupBy("eid").agg(F.avg("z").alias("sm"))


def weighted(neighbours: DataFrame, weights: str = "distance", sigma: float = 4.0) -> DataFrame:
    """Weights: uniform, distance (inverse; neighbours at distance 0 take all), gaussian."""
    d = F.col("distance")
    if weights == "uniform":
        return mean(neighbours)
    if weights == "gaussian":
        w = gaussian(d, sigma)
        return neighbours.groupBy("eid").agg((F.sum(F.col("z") * w) / F.sum(w)).alias("sm"))
    exact = F.avg(F.when(d == 0, F.col("z")))
    w = F.try_divide(F.lit(1.0), d)
    return neighbours.groupBy("eid").agg(F.coalesce(exact, F.sum(F.col("z") * w) / F.sum(w)).alias("sm"))


def search(train: DataFrame, features: list[str], max_k: int, folds: int = 10, tid: str = "tid", target: str = "z") -> DataFrame:
    """(k, weights, rmse) of cross-validation over every k from 2 to max_k and every weighting, from one join a fold.

    A row's fold is the first four digits of its id's md5, by the number of folds.
    """
    fold = F.pmod(F.conv(F.substring(F.md5(F.col(tid).cast("string")), 1, 4), 16, 10).cast("int"), F.lit(folds))
    parts = None
    for f in range(folds):
        near = join(train.where(fold == f), train.where(fold != f), max_k, features, eid=tid, tid=tid, target=target)
        parts = near if parts is None else parts.union(near)
    running = Window.partitionBy("eid").orderBy("rank")
    d, z = F.col("distance"), F.col("z")

    def estimate(w: Column) -> Column:
        return F.sum(z * w).over(running) / F.sum(w).over(running)

    zero = F.avg(F.when(d == 0, z)).over(running)
    tried = parts.select("eid", "rank", estimate(F.lit(1.0)).alias("uniform"), F.coalesce(zero, F.sum(z * F.try_divide(F.lit(1.0), d)).over(running) / F.sum(F.try_divide(F.lit(1.0), d)).over(running)).alias("distance"), estimate(gaussian(d)).alias("gaussian"))
    long = tried.where("rank >= 2").unpivot(["eid", "rank"], ["uniform", "distance", "gaussian"], "weights", "sm")
    truth = train.select(F.col(tid).alias("eid"), F.col(target).alias("truth"))
    return long.join(truth, "eid").groupBy(F.col("rank").alias("k"), "weights").agg(F.sqrt(F.avg(F.pow(F.col("sm") - F.col("truth"), 2))).alias("rmse"))

"""Statistics over columns: each is one pass of aggregates over the table."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import knn

#: Statistics of one column, and of a pair, by name.
ONE = {
    "count": lambda c: F.count(c).cast("double"),
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "range": lambda c: F.max(c) - F.min(c),
}
#: Statistics of one column that take more than one pass.
QUANTILES = {"qnt25": 0.25, "qnt75": 0.75}
#: Parts that each pass of `quantiles` divides an interval into.
PARTS = 1024
#: Points of a run of the variogram, and runs of a group.
RUN = 16
TWO = {
    "corr": F.corr,
    "count": lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).cast("double"),
}


def describe(df: DataFrame, columns: list[str], stats: list[str] | None = None) -> DataFrame:
    """(stat, column, value), long."""
    names = [(s, c) for s in stats or (*ONE, *QUANTILES) for c in columns]
    known = quantiles(df, columns, [QUANTILES[s] for s in dict(names) if s in QUANTILES])
    row = df.agg(F.count("*").alias("_n"), *(ONE[s](c).cast("double").alias(f"{s}|{c}") for s, c in names if s in ONE))
    row = row.withColumns({f"{s}|{c}": F.lit(known[c, QUANTILES[s]]).cast("double") for s, c in names if s in QUANTILES})
    return row.unpivot([], [f"`{s}|{c}`" for s, c in names], "key", "value").select(F.substring_index("key", "|", 1).alias("stat"), F.substring_index("key", "|", -1).alias("column"), "value")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[tuple[str, float], float | None]:
    """Exact quantiles, interpolated between neighbours, by (column, share); None of a column without values.

    Each pass counts the rows of PARTS equal parts of every interval in which a wanted rank lies, and goes on with the
    part that holds it, until that is a single value: a few passes, and never more in one task or on the driver than
    PARTS counts for each rank. Null and NaN do not count.
    """
    if not shares or not columns:
        return {}
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    ends = df.agg(*(f(value[c]).alias(f"{n}|{c}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    found: dict[tuple[str, int], float] = {}
    wanted = {(c, r): (r, ends[f"lo|{c}"], ends[f"hi|{c}"]) for c in columns for q in shares if ends[f"n|{c}"] for r in (int(np.floor(q * (ends[f"n|{c}"] - 1))), int(np.ceil(q * (ends[f"n|{c}"] - 1))))}
    while wanted:
        found |= {key: lo for key, (_, lo, hi) in wanted.items() if lo == hi}
        wanted = {key: w for key, w in wanted.items() if key not in found}
        spans = sorted({(key[0], lo, hi) for key, (_, lo, hi) in wanted.items()})
        if not spans:
            break
        parts = [F.when(value[c].between(lo, hi), F.struct(F.lit(k).alias("span"), F.least(F.floor((value[c] - lo) / (hi - lo) * PARTS), F.lit(PARTS - 1)).alias("part"), value[c].alias("v"))) for k, (c, lo, hi) in enumerate(spans)]
        rows = df.select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s")).groupBy("s.span", "s.part").agg(F.count("*").alias("n"), F.min("s.v").alias("lo"), F.max("s.v").alias("hi")).collect()
        by = {k: sorted((r for r in rows if r.span == k), key=lambda r: r.part) for k in range(len(spans))}
        for key, (rank, lo, hi) in wanted.items():
            for r in by[spans.index((key[0], lo, hi))]:
                if rank < r.n:
                    wanted[key] = rank, r.lo, r.hi
                    break
                rank -= r.n
    out = {}
    for c in columns:
        for q in shares:
            at = q * (ends[f"n|{c}"] - 1)
            low, high = int(np.floor(at)), int(np.ceil(at))
            out[c, q] = found[c, low] + (found[c, high] - found[c, low]) * (at - low) if ends[f"n|{c}"] else None
    return out


def pairs(df: DataFrame, columns: list[str], stat: str = "corr") -> DataFrame:
    """(a, b, value) of a statistic of every pair, in both orders and with itself."""
    found = df.agg(*(TWO[stat](a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)), *(TWO[stat](a, a).alias(f"{a}|{a}") for a in columns))
    long = found.unpivot([], [f"`{c}`" for c in found.columns], "key", "value").select(F.substring_index("key", "|", 1).alias("a"), F.substring_index("key", "|", -1).alias("b"), "value")
    return long.union(long.where("a != b").select("b", "a", "value"))


def rmse(predicted: str, observed: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(observed), 2)))


def r_squared(predicted: str, observed: str) -> Column:
    """Squared Pearson correlation."""
    return F.pow(F.corr(predicted, observed), 2)


def taylor(df: DataFrame, reference: str, predicted: str, group: list[str] = [], normalize: bool = False) -> DataFrame:  # noqa: B006
    """Standard deviations, centred root mean square difference and correlation, in one pass of moments.

    normalize: deviations and difference as shares of the reference's deviation (null where that is 0).
    """
    p, r = F.col(predicted), F.col(reference)
    centred = F.sqrt(F.greatest(F.var_pop(p - r), F.lit(0.0)))
    if normalize:
        by = F.nullif(F.stddev_pop(r), F.lit(0.0))
        return df.where(p.isNotNull() & r.isNotNull()).groupBy(*group).agg((F.stddev_pop(r) / by).alias("ref_sdev"), (F.stddev_pop(p) / by).alias("sdev"), (centred / by).alias("crmsd"), F.corr(p, r).alias("corr"))
    return df.where(p.isNotNull() & r.isNotNull()).groupBy(*group).agg(F.stddev_pop(r).alias("ref_sdev"), F.stddev_pop(p).alias("sdev"), centred.alias("crmsd"), F.corr(p, r).alias("corr"))


def histogram(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0, bins: int = 100) -> DataFrame:
    """(bin, n) of bins that hold values; the last is closed on the right; values outside are dropped."""
    inside = df.where(F.col(column).between(low, high))
    return inside.groupBy(F.least(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def discrete_bounds(df: DataFrame, column: str) -> DataFrame:
    """(low, high, steps): whole numbers that hold all values, and all whole numbers between them."""
    ends = df.agg(F.min(column).cast("long").alias("low"), F.ceil(F.max(column)).cast("long").alias("high"))
    return ends.withColumn("steps", F.when(F.col("low").isNotNull(), F.sequence("low", "high")))


def series_range(images: DataFrame, band: str) -> DataFrame:
    """(low, high): smallest and largest value of a whole series of images."""
    return images.agg(F.min(band).alias("low"), F.max(band).alias("high"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values that occur, null aside."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def range_intersection(df: DataFrame, group: list[str], by: str, column: str) -> DataFrame:
    """The part of [0, 1] that the values of every `by` of a group reach."""
    each = df.groupBy(*group, by).agg(F.min(column).alias("mn"), F.max(column).alias("mx"))
    return each.groupBy(*group).agg(F.greatest(F.lit(0.0), F.max("mn")).alias("low"), F.least(F.lit(1.0), F.min("mx")).alias("high"))


def above_percentile(df: DataFrame, column: str, q: float = 0.7) -> DataFrame:
    """Rows above the percentile of the whole column."""
    bound = quantiles(df, [column], [q])[column, q]
    return df.where(F.col(column) > F.lit(bound))


def variogram(points: DataFrame, x: str, y: str, z: str, width: float, bins: int) -> DataFrame:
    """(bin, n, gamma): half the mean squared difference of pairs by distance.

    While the points fit knn.BROADCAST_BYTES they are broadcast in runs of near ones: pairs of runs whose boxes lie
    within one bin of each other count at once by the moments of their values, and only those that a bin's edge may
    divide are compared point by point. Beyond it points meet by squares as wide as the largest distance, each with its
    own and half of the neighbouring ones. Either way every pair meets once.
    """
    whole = points.select(*(F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z")))).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    if whole.count() * 24 <= knn.BROADCAST_BYTES:
        return _variogram_in_place(whole, width, bins)
    far = width * bins
    own = points.select(F.monotonically_increasing_id().alias("i"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")).withColumns({"gx": F.floor(F.col("x") / far), "gy": F.floor(F.col("y") / far)})
    ways = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1), (-1, 1))))
    other = own.withColumn("way", F.explode(ways)).withColumns({"gx": F.col("gx") - F.col("way.dx"), "gy": F.col("gy") - F.col("way.dy")})
    a, b = own.alias("a"), other.alias("b")
    gap = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    once = (F.col("b.way.dx") != 0) | (F.col("b.way.dy") != 0) | (F.col("a.i") < F.col("b.i"))
    both = a.join(b, (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & once)
    return both.select(F.floor(gap / width).alias("bin"), F.pow(F.col("a.z") - F.col("b.z"), 2).alias("sq")).where(F.col("bin") < bins).groupBy("bin").agg(F.count("*").alias("n"), (F.avg("sq") / 2).alias("gamma"))


def _variogram_in_place(whole: DataFrame, width: float, bins: int) -> DataFrame:
    spark, table = whole.sparkSession, whole.toArrow()
    sent = spark.sparkContext.broadcast(Runs(np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()]), table["z"].to_numpy(), table["z"].is_valid().to_numpy()))
    groups = sent.value.groups

    def run(batches):
        total = np.zeros((3, bins))
        for b in batches:
            for g in b["id"].to_pylist():
                total += sent.value.sums(g, width, bins)
        yield pa.RecordBatch.from_arrays([pa.array(range(bins)), *(pa.array(t) for t in total)], ["bin", "n", "m", "sq"])

    # the later a group, the fewer it meets: they are dealt in turn
    tasks = max(1, min(groups, 8 * spark.sparkContext.defaultParallelism))
    dealt = spark.range(0, tasks, 1, tasks).select(F.explode(F.sequence(F.col("id"), F.lit(max(groups, tasks) - 1), F.lit(tasks))).alias("id")).where(F.col("id") < groups)
    found = dealt.mapInArrow(run, "bin long, n double, m double, sq double").groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("n", "m", "sq")))
    return found.where("n > 0").select("bin", F.col("n").cast("long").alias("n"), (F.try_divide("sq", "m") / 2).alias("gamma"))


class Runs:
    """Points in runs of RUN near ones, and these in groups of as many runs, with their boxes and moments."""

    def __init__(self, points: np.ndarray, z: np.ndarray, known: np.ndarray):
        leaf = knn.Tree(points, max(1, len(points) // RUN)).leaf(points)
        order, short = np.argsort(leaf, kind="stable"), -len(points) % (RUN * RUN)
        z = np.where(known, z - (z[known & np.isfinite(z)].mean() if (known & np.isfinite(z)).any() else 0.0), 0.0)
        pad = lambda v, last: np.concatenate([v[order], np.repeat(last, short, 0)]).reshape(-1, RUN, *v.shape[1:])
        self.points = pad(points, points[order[-1:]]) if len(points) else np.empty((0, RUN, 2))
        self.z, self.known, self.real = pad(z, [0.0]), pad(known.astype(float), [0.0]), pad(np.ones(len(points)), [0.0])
        self.xs, self.ys = (np.ascontiguousarray(self.points[..., c]) for c in (0, 1))
        self.full = (self.known.sum(1) == RUN) & (self.real.sum(1) == RUN)
        self.low, self.high = self.points.min(1), self.points.max(1)
        self.moments = np.stack([v.sum(1) for v in (self.real, self.known, self.z, self.z**2)])
        self.groups = len(self.points) // RUN

    def _bins(self, low, high, low_, high_, width: float):
        """The bins of the least and the largest distance between boxes, a little wider than they are."""
        near, far = (np.sqrt((d**2).sum(-1)) for d in (np.maximum(np.maximum(low_ - high, low - high_), 0), np.maximum(high_ - low, high - low_)))
        return np.floor(near * (1 - 1e-9) / width), np.floor(far * (1 + 1e-9) / width)

    def sums(self, g: int, width: float, bins: int) -> np.ndarray:
        """Pairs, pairs of known values and summed squares, by bin, of a group with itself and those after it."""
        out, mine = np.zeros((3, bins)), slice(g * RUN, (g + 1) * RUN)
        low, high = (v.reshape(-1, RUN, 2) for v in (self.low[mine.start :], self.high[mine.start :]))
        near, far = self._bins(low[0].min(0), high[0].max(0), low.min(1), high.max(1), width)
        at_once = self.moments[:, mine.start :].reshape(4, -1, RUN).sum(2)
        one = (near == far) & (np.arange(len(near)) > 0)
        self._add(out, near[one], at_once[:, :1], at_once[:, one])
        for other in np.flatnonzero(~one & (near < bins)).tolist():
            theirs = slice(mine.start + other * RUN, mine.start + (other + 1) * RUN)
            near_, far_ = self._bins(self.low[mine, None], self.high[mine, None], self.low[None, theirs], self.high[None, theirs], width)
            first, second = np.indices(near_.shape)
            met = near_ < bins if other else (near_ < bins) & (first <= second)
            one_ = met & (near_ == far_) & ((other > 0) | (first < second))
            i, j = first[one_] + mine.start, second[one_] + theirs.start
            self._add(out, near_[one_], self.moments[:, i], self.moments[:, j])
            i, j = first[met & ~one_] + mine.start, second[met & ~one_] + theirs.start
            gap = (self.xs[i, :, None] - self.xs[j, None]) ** 2
            gap += (self.ys[i, :, None] - self.ys[j, None]) ** 2
            bin_ = np.minimum(np.sqrt(gap, out=gap) / width, bins).astype(np.int64)
            if other and self.full[i].all() and self.full[j].all():
                n = np.bincount(bin_.ravel(), minlength=bins + 1)[:bins]
                out += np.stack([n, n, np.bincount(bin_.ravel(), ((self.z[i, :, None] - self.z[j, None]) ** 2).ravel(), bins + 1)[:bins]])
                continue
            both = self.real[i, :, None] * self.real[j, None]
            both[i == j] *= np.triu(np.ones((RUN, RUN)), 1)
            known = both * self.known[i, :, None] * self.known[j, None]
            sq = (self.z[i, :, None] - self.z[j, None]) ** 2
            for row, v in zip(out, (both, known, np.where(known > 0, sq, 0.0))):
                row += np.bincount(bin_.ravel(), v.ravel(), bins + 1)[:bins]
        return out

    @staticmethod
    def _add(out: np.ndarray, bin_: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        inside = bin_ < out.shape[1]
        for row, v in zip(out, (a[0] * b[0], a[1] * b[1], a[1] * b[3] + b[1] * a[3] - 2 * a[2] * b[2])):
            row += np.bincount(bin_[inside].astype(np.int64), v[inside], out.shape[1])


def _shape(model: str, gap: np.ndarray, reach: float) -> np.ndarray:
    t = gap / reach
    if model == "spherical":
        return np.where(t < 1, 1.5 * t - 0.5 * t**3, 1.0)
    return 1 - np.exp(-3 * t) if model == "exponential" else 1 - np.exp(-3 * t**2)


def _reaches(bins: list[int], width: float, steps: int) -> tuple[list[float], list[float]]:
    """Middles of bins, and ranges up to twice the largest, of the width as it is written: 0.05 is 1/20."""
    mids = [(2 * b + 1) * Fraction(str(width)) / 2 for b in bins]
    return [float(m) for m in mids], [float(2 * max(mids) * i) / steps for i in range(1, steps + 1)]


def fit_variogram(binned: DataFrame, width: float, model: str = "spherical", steps: int = 200) -> dict[str, float] | None:
    """Nugget, partial sill and range that fit the rows of `variogram` best, weighted by their pairs.

    For each of `steps` ranges up to twice the largest distance, nugget and sill are the solution of least squares,
    neither negative; of ranges that fit equally well (to a millionth) the shortest. Ranges within which no distances
    differ tell nugget and sill apart by nothing and are left out; None if all are. The rows are as many as there are bins.
    """
    if model not in ("spherical", "exponential", "gaussian"):
        raise ValueError(f"unknown model {model}")
    rows = binned.orderBy("bin").collect()
    if not rows:
        return None
    gamma, weight = (np.array([r[c] for r in rows], float) for c in ("gamma", "n"))
    gap, reaches = _reaches([r["bin"] for r in rows], width, steps)
    tried = []
    for reach in reaches:
        f = _shape(model, np.array(gap), reach)
        sw, sf, sff, sg, sfg = (float((weight * v).sum()) for v in (np.ones(len(f)), f, f * f, gamma, f * gamma))
        apart = sw * sff - sf * sf
        if apart <= 1e-9 * sw * sff:
            continue
        nugget, sill = (sff * sg - sf * sfg) / apart, (sw * sfg - sf * sg) / apart
        if nugget < 0:
            nugget, sill = 0.0, sfg / sff
        elif sill < 0:
            nugget, sill = sg / sw, 0.0
        error = (weight * (nugget + sill * f - gamma) ** 2).sum() / weight.sum()
        tried.append({"nugget": float(nugget), "sill": float(sill), "range": reach, "error": float(error)})
    least = min((t["error"] for t in tried), default=None)
    return next((t for t in tried if t["error"] <= least * (1 + 1e-6)), None)

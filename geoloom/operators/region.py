"""Regions: codes, hierarchy, boxes, and points in polygons.

Polygons are rows (region, ring: array of struct<px, py>, closed or not). Points meet them by degree-sized squares
of the polygons' bounding boxes, an equi-join, so no point is compared with every region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parent_region

EARTH = 6_371_000.0


def boxes(spark, x1: float, x2: float, y1: float, y2: float, nx: int, ny: int) -> DataFrame:
    """nx by ny boxes of a rectangle, labelled x1_x2_y1_y2; whole numbers are written without a point."""
    if not (-180 <= x1 < x2 <= 180 and -90 <= y1 < y2 <= 90):
        raise ValueError("-180 <= x1 < x2 <= 180 and -90 <= y1 < y2 <= 90 are needed")
    w, h = (x2 - x1) / nx, (y2 - y1) / ny
    cells = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("j"))
    ends = {"x1": x1 + F.col("i") * w, "x2": x1 + (F.col("i") + 1) * w, "y1": y1 + F.col("j") * h, "y2": y1 + (F.col("j") + 1) * h}
    out = cells.select("i", "j", *(c.cast("double").alias(n) for n, c in ends.items()))
    shown = [F.when(F.col(n) == F.floor(n), F.floor(n).cast("string")).otherwise(F.col(n).cast("string")) for n in ends]
    return out.withColumn("label", F.concat_ws("_", *shown))


def box_ring(label: Column) -> Column:
    """The five corners of a box label."""
    p = F.transform(F.split(label, "_"), lambda s: s.cast("double"))
    corner = lambda i, j: F.struct(p[i].alias("px"), p[j].alias("py"))
    return F.array(corner(0, 2), corner(1, 2), corner(1, 3), corner(0, 3), corner(0, 2))


def edges(ring: Column) -> Column:
    """Consecutive pairs of corners, the last with the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), turned.alias("b"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the ring an odd number of times."""
    def crosses(e):
        a, b = e["a"], e["b"]
        spans = (a["py"] > y) != (b["py"] > y)
        at = F.try_divide((b["px"] - a["px"]) * (y - a["py"]), b["py"] - a["py"]) + a["px"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1


def edge_distance(ring: Column, x: Column, y: Column) -> Column:
    """Metres to the nearest edge, in the azimuthal equidistant plane about the point."""
    def plane(p):
        lon, lat, lat0 = F.radians(p["px"] - x), F.radians(p["py"]), F.radians(y)
        cosine = F.sin(lat0) * F.sin(lat) + F.cos(lat0) * F.cos(lat) * F.cos(lon)
        c = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))
        k = F.when(c == 0, 1.0).otherwise(c / F.sin(c)) * EARTH
        return F.struct((k * F.cos(lat) * F.sin(lon)).alias("px"), (k * (F.cos(lat0) * F.sin(lat) - F.sin(lat0) * F.cos(lat) * F.cos(lon))).alias("py"))

    def to_edge(e):
        a, b = e["a"], e["b"]
        dx, dy = b["px"] - a["px"], b["py"] - a["py"]
        t = F.coalesce(F.try_divide(-(a["px"] * dx + a["py"] * dy), dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
        return F.sqrt(F.pow(a["px"] + t * dx, 2) + F.pow(a["py"] + t * dy, 2))

    return F.array_min(F.transform(edges(F.transform(ring, plane)), to_edge))


def in_regions(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", square: float = 1.0, buffer_m: float = 0.0) -> DataFrame:
    """Points with each region that holds them, or that is within buffer_m metres."""
    reach = buffer_m / 111_000.0
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    wide = F.try_divide(F.lit(reach), F.greatest(F.cos(F.radians(F.greatest(F.abs(side(F.array_min, "py")), F.abs(side(F.array_max, "py"))))), F.lit(0.01)))
    pad = {"px": wide, "py": F.lit(reach)}
    span = lambda c: F.sequence(F.floor((side(F.array_min, c) - pad[c]) / square), F.floor((side(F.array_max, c) + pad[c]) / square))
    keyed = polygons.select("region", "ring", F.explode(span("px")).alias("_sx"), span("py").alias("_ys")).select("region", "ring", "_sx", F.explode("_ys").alias("_sy"))
    marked = points.withColumns({"_sx": F.floor(F.col(x) / square), "_sy": F.floor(F.col(y) / square)})
    hit = contains(F.col("ring"), F.col(x), F.col(y))
    if buffer_m:
        hit = hit | (edge_distance(F.col("ring"), F.col(x), F.col(y)) <= buffer_m)
    return marked.join(keyed, ["_sx", "_sy"]).where(hit).drop("_sx", "_sy", "ring")


def lookup(regions: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (kind, code): regions by id, or else by name, as two equi-joins."""
    by_id = wanted.join(regions, (wanted.kind == regions.kind) & (wanted.code == regions.id)).select(wanted.kind, wanted.code, regions.id, regions.name)
    by_name = wanted.join(regions, (wanted.kind == regions.kind) & (wanted.code == regions.name)).select(wanted.kind, wanted.code, regions.id, regions.name)
    return by_id.union(by_name).distinct()


def with_parent(regions: DataFrame, code: str = "code") -> DataFrame:
    """One level up, for training on the surrounding region."""
    return regions.withColumn("parent", parent_region(F.col(code)))


def boundaries(shapes: DataFrame, attributes: DataFrame, field: str, names: list[str] | None = None, column: str = "state") -> DataFrame:
    """Vertices of shapes with the name that a field of their attributes gives them, those of some names only.

    shapes and attributes: of the readers of shapefiles; files belong together by their paths without ending.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    named = attributes.select(stem("file").alias("_stem"), "record", F.col("fields")[field].alias(column))
    if names is not None:
        named = named.where(F.col(column).isin(names))
    return shapes.withColumn("_stem", stem("file")).join(named, ["_stem", "record"]).drop("_stem")

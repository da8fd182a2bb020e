"""Further registered queries: rasters with gaps, flow, models and their validation, files, scalars and small operators.

Roles are those of `queries`, whose tables of queries and SQL twins these are added to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import accuracy, forest, grid, knn, local_polynomial, models, points, prep, profile, projection, region, stats, terrain
from ..sources import binary, config, files, geotiff, netcdf, sinks, text
from ..storage import new_path
from .queries import _HELD, CELLS, FEATURES, NUMBERS, ORACLE_SQL, PTS, QUERIES, WIDE, cells, fine, pts, query, r6, rows_of, sides, table

__all__ = ["ORACLE_SQL", "QUERIES"]

#: The raster without the cells of every seventh second band.
GAPPY = f"(SELECT * FROM {CELLS} WHERE s % 7 <> 0)"
AROUND = [(n, dr, dc) for n, (dr, dc) in zip("abcdfghi", terrain.AROUND)]


def _long(df, *columns):
    return r6(df.withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")}), *columns)


def _window(raster: str, z: str = "z") -> str:
    joins = " ".join(f"LEFT JOIN {raster} {n} ON {n}.row = e.row + {dr} AND {n}.col = e.col + {dc}" for n, dr, dc in AROUND)
    return f"(SELECT e.row, e.col, e.{z} AS e, " + ", ".join(f"{n}.{z} AS {n}" for n, *_ in AROUND) + f" FROM {raster} e {joins})"


def _horn(raster: str) -> str:
    return f"(SELECT *, ((c + 2 * f + i) - (a + 2 * d + g)) / 8 AS dx, ((g + 2 * h + i) - (a + 2 * b + c)) / 8 AS dy FROM {_window(raster)})"


SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"
ASPECT = "CASE WHEN dx IS NULL OR dy IS NULL THEN NULL WHEN dx = 0 AND dy = 0 THEN 0 ELSE fmod(90 - degrees(atan2(dy, -dx)) + 360, 360) END"
LIGHT = "(sin(radians(45)) - cos(radians(45)) * (dx * sin(radians(315)) - dy * cos(radians(315)))) / sqrt(1 + dx * dx + dy * dy)"


def gappy(spark, sf_dir):
    return cells(spark, sf_dir).where("s % 7 <> 0")


# -- terrain ------------------------------------------------------------------------------------------------------


@query(f"SELECT row, col, round({SLOPE}, 6) AS slope, round({ASPECT}, 6) AS aspect, round(CASE WHEN {LIGHT} <= 0 THEN 1 ELSE 1 + 254 * {LIGHT} END, 6) AS hillshade FROM {_horn(GAPPY)}")
def terrain_with_gaps(spark, sf_dir):
    """Three parameters of a raster with missing cells, in one plan."""
    return _long(terrain.parameters(gappy(spark, sf_dir), "z", ["slope", "aspect", "hillshade"]), "slope", "aspect", "hillshade")


@query(f"SELECT row, col, round({SLOPE}, 6) AS slope FROM {_horn(CELLS)}")
def slope_by_tile(spark, sf_dir):
    """Tiles with a halo, each computed by itself, without the halo again: as over the whole raster."""
    c = cells(spark, sf_dir)
    n = rows_of(c)
    found = terrain.parameters(grid.tiles(c, n, WIDE, 4, 1), "z", ["slope"], keep=("tile_row", "tile_col"))
    own = found.where(f"tile_row = least(row div {-(-n // 4)}, 3) and tile_col = least(col div 13, 3)")
    return _long(own.select("row", "col", "slope"), "slope")


def _convergence_sql():
    aspects = f"(SELECT row, col, {ASPECT} AS aspect FROM {_horn(CELLS)})"
    off = lambda n, dr, dc: f"least(fmod(abs({n} - degrees(atan2({-dc}::DOUBLE, {dr}::DOUBLE))), 360), 360 - fmod(abs({n} - degrees(atan2({-dc}::DOUBLE, {dr}::DOUBLE))), 360))"
    total = " + ".join(f"CASE WHEN {n} IS NULL THEN NULL ELSE {off(n, dr, dc)} END" for n, dr, dc in AROUND)
    return f"WITH t AS {aspects} SELECT row, col, round(({total}) / 8 - 90, 6) AS convergence FROM {_window('t', 'aspect')}"


@query(_convergence_sql())
def convergence_index(spark, sf_dir):
    return _long(terrain.convergence(cells(spark, sf_dir), "z"), "convergence")


_FALLS = " UNION ALL ".join(f"SELECT row, col, {k} AS k, row + {dr} AS to_row, col + {dc} AS to_col, (e - {n}) / {2**0.5 if dr and dc else 1.0!r}::DOUBLE AS fall FROM w" for k, (n, dr, dc) in enumerate(AROUND))
#: With the way down from every cell: of the steepest falls the first.
_WAY = f"w AS {_window(GAPPY)}, falls AS ({_FALLS}), way AS (SELECT w.row, w.col, f.to_row, f.to_col, f.fall FROM w LEFT JOIN (SELECT * FROM falls WHERE fall > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY fall DESC, k) = 1) f ON f.row = w.row AND f.col = w.col)"
_FLOW = f"WITH RECURSIVE {_WAY}, walk AS (SELECT row AS r, col AS c FROM way UNION ALL SELECT to_row, to_col FROM walk JOIN way ON r = way.row AND c = way.col WHERE to_row IS NOT NULL), flow AS (SELECT way.row, way.col, fall, n FROM way JOIN (SELECT r, c, count(*) AS n FROM walk GROUP BY ALL) ON r = way.row AND c = way.col)"


@query(f"WITH {_WAY} SELECT row, col, to_row, to_col, round(fall, 6) AS drop FROM way")
def flow_direction(spark, sf_dir):
    out = terrain.flow_direction(gappy(spark, sf_dir), "z")
    return _long(out.withColumns({c: F.col(c).cast("long") for c in ("to_row", "to_col")}), "drop")


@query(_FLOW + " SELECT row, col, n AS cells, round(fall, 6) AS drop FROM flow")
def flow_accumulation(spark, sf_dir):
    return _long(terrain.flow_accumulation(gappy(spark, sf_dir), "z"), "drop")


@query(_FLOW + " SELECT row, col, round(ln(n / greatest(coalesce(fall, 0), 0.001)), 6) AS twi FROM flow")
def wetness_index(spark, sf_dir):
    return _long(terrain.wetness(gappy(spark, sf_dir), "z"), "twi")


@query(_FLOW + " SELECT row, col, round((n / 22.13::DOUBLE) ** 0.4 * (sin(atan(coalesce(fall, 0))) / 0.0896::DOUBLE) ** 1.3, 4) AS ls FROM flow")
def length_slope_factor(spark, sf_dir):
    return _long(terrain.slope_length(gappy(spark, sf_dir), "z")).withColumn("ls", F.round("ls", 4))


# -- rasters ------------------------------------------------------------------------------------------------------


@query(f"SELECT row, col, least(row // ((SELECT max(row) + 4 FROM {CELLS}) // 4), 3) AS tile_row, least(col // 13, 3) AS tile_col FROM {CELLS}")
def tiles_without_halo(spark, sf_dir):
    c = cells(spark, sf_dir)
    return grid.tiles(c, rows_of(c), WIDE, 4).selectExpr(*(f"cast({x} as bigint) {x}" for x in ("row", "col", "tile_row", "tile_col")))


@query(f"SELECT row, col, z FROM {CELLS} WHERE row BETWEEN 3 AND 12 AND col BETWEEN 7 AND 26")
def crop_pixels(spark, sf_dir):
    return _long(grid.crop_pixels(cells(spark, sf_dir), 3, 7, 10, 20).select("row", "col", "z"), "z")


@query(f"SELECT row, col, z FROM {CELLS} WHERE col + 0.5 BETWEEN 10 AND 30 AND (SELECT max(row) + 1 FROM {CELLS}) - row - 0.5 BETWEEN 5 AND 25")
def crop_window(spark, sf_dir):
    c = cells(spark, sf_dir)
    return _long(grid.crop_window(c, fine(rows_of(c)), 10, 25, 30, 5).select("row", "col", "z"), "z")


@query(f"SELECT round(min(x), 6) AS ulx, round(max(y), 6) AS uly, round(max(x), 6) AS lrx, round(min(y), 6) AS lry FROM {PTS}")
def extent(spark, sf_dir):
    return r6(grid.extent(pts(spark, sf_dir), "x", "y"), "ulx", "uly", "lrx", "lry")


@query(f"SELECT floor(row * (n * 20 // 50) / n)::BIGINT AS row, floor(col * 20 / 50)::BIGINT AS col, round(avg(z), 6) AS z FROM {CELLS}, (SELECT max(row) + 1 AS n FROM {CELLS}) GROUP BY 1, 2")
def downsample_to_width(spark, sf_dir):
    c = cells(spark, sf_dir)
    return _long(grid.downsample(c, rows_of(c), WIDE, 20, "z"), "z")


@query(f"SELECT row, col, round(avg(v), 6) AS z FROM (SELECT row, col, z::DOUBLE AS v FROM {CELLS} UNION ALL SELECT row, col, nullif(s, 9)::DOUBLE FROM {CELLS} UNION ALL SELECT row, col, nullif(s, 9) * 2::DOUBLE FROM {CELLS} WHERE s % 2 = 0) GROUP BY ALL")
def mean_of_rasters(spark, sf_dir):
    """Three files of one grid: whole, with nodata, with nodata and missing cells."""
    c = cells(spark, sf_dir).withColumn("s", F.col("s").cast("double"))
    files = [c.select("row", "col", "z"), c.select("row", "col", F.col("s").alias("z")), c.where("s % 2 = 0").select("row", "col", F.expr("if(s = 9, 9, s * 2)").cast("double").alias("z"))]
    return _long(grid.mean_of(files, "z", 9.0), "z")


@query(f"SELECT row, col, round(median(z + 10 * tr + tc), 6) AS z FROM (SELECT row, col, z, tr, tc FROM {CELLS}, (SELECT (max(row) + 4) // 4 AS h FROM {CELLS}), (SELECT unnest(range(4)) AS tr), (SELECT unnest(range(4)) AS tc) WHERE row BETWEEN tr * h - 2 AND tr * h + h + 1 AND col BETWEEN tc * 13 - 2 AND tc * 13 + 14) GROUP BY ALL")
def mosaic_median(spark, sf_dir):
    c = cells(spark, sf_dir)
    tiled = grid.tiles(c, rows_of(c), WIDE, 4, 2).withColumn("z", F.expr("z + 10 * tile_row + tile_col"))
    return _long(grid.combine(tiled, "z", "median"), "z")


_EARTH = 6371007.181


@query(f"SELECT r.row, k.col, c.z FROM (SELECT unnest(range(30)) AS row) r, (SELECT unnest(range(30)) AS col) k LEFT JOIN {CELLS} c ON c.col = floor((degrees((k.col + 0.5) * 100000 / {_EARTH}::DOUBLE) + 12) / 0.5)::BIGINT AND c.row = floor((12 - degrees((15 - r.row - 0.5) * 100000 / {_EARTH}::DOUBLE)) / 0.5)::BIGINT")
def reproject_grid(spark, sf_dir):
    """From longitude and latitude to metres on the sphere (equidistant cylinder), by the nearest cell."""
    back = lambda x, y: (F.degrees(x / _EARTH), F.degrees(y / _EARTH))
    c = cells(spark, sf_dir)
    source = grid.Grid(-12.0, 0.5, 12.0, 0.5, rows_of(c), WIDE)
    return _long(grid.reproject(c, source, grid.Grid(0.0, 100000.0, 1500000.0, 100000.0, 30, 30), back, ["z"]), "z")


@query(f"SELECT row, col, round(col * 0.25 - 100 + 0.125, 6) AS x, round(50 - row * 0.25 - 0.125, 6) AS y, z, nullif(s, 7)::DOUBLE AS s FROM {CELLS}")
def geotiff_round_trip(spark, sf_dir):
    """The raster written as GeoTIFF tiles and read back: cells by their coordinates."""
    c = cells(spark, sf_dir).withColumn("s", F.nullif(F.col("s"), F.lit(7)))
    g, path = grid.Grid(-100.0, 0.25, 50.0, 0.25, rows_of(c), WIDE), new_path(spark, "geotiff")
    sinks.write_raster(c, g, ["z", "s"], path, size=16, nodata=-1.0, epsg=4326)
    back = geotiff.cells(spark, path).where("z is not null")
    return back.select(F.floor((F.lit(50.0) - F.col("y")) / 0.25).alias("row"), F.floor((F.col("x") + 100) / 0.25).alias("col"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z", "s")


@query("SELECT l_linenumber::BIGINT AS day, l_suppkey AS cell, round(avg(l_quantity), 6) AS sm FROM lineitem GROUP BY ALL")
def netcdf_daily_stack(spark, sf_dir):
    """Daily grids written as NetCDF files, one a line number, and read back by name pattern."""
    daily = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.avg("l_quantity").alias("sm"))
    path, wide = new_path(spark, "netcdf"), daily.agg(F.max("l_suppkey")).first()[0] + 1

    def make(key, rows):
        import numpy as np
        import pandas as pd

        plane = np.full((1, 1, wide), -1.0)
        plane[0, 0, rows.l_suppkey.to_numpy()] = rows.sm.to_numpy()
        axes = {"lat": (["lat"], np.zeros(1), {}), "lon": (["lon"], np.arange(wide, dtype=float), {})}
        content = netcdf.encode(axes | {"sm": (["time", "lat", "lon"], plane, {"_FillValue": -1.0})}, {"time": 1, "lat": 1, "lon": wide})
        return pd.DataFrame({"name": [f"SM_199501{int(key[0]):02d}_v1.nc"], "content": [content]})

    geotiff.save(daily.groupBy("l_linenumber").applyInPandas(make, "name string, content binary"), path)
    back = netcdf.daily(spark, path, "sm", netcdf.month_pattern(1995, 1)).where("value is not null")
    return back.select(F.dayofmonth("date").cast("long").alias("day"), F.col("x").cast("long").alias("cell"), F.round("value", 6).alias("sm"))


@query(f"SELECT row, col, z FROM {CELLS} WHERE row = 3 AND col = 49")
def pixel_lookup(spark, sf_dir):
    c = cells(spark, sf_dir)
    return _long(profile.pixel(c, 3, 77, rows_of(c), WIDE).select("row", "col", "z"), "z")


@query(f"SELECT b::INT AS bin, round(coalesce(avg(z), 0), 6) AS z FROM range(8) g(b) LEFT JOIN (SELECT least((col - 5) * 8 // 32, 7) AS k, z FROM {CELLS} WHERE col BETWEEN 5 AND 37 AND abs(row - 6) <= 2) p ON k = b GROUP BY b")
def horizontal_band(spark, sf_dir):
    return r6(profile.horizontal_band(cells(spark, sf_dir), "z", 37, 5, 6, 4, 8), "z")


@query(f"SELECT b::INT AS bin, round(coalesce(avg(z), 0), 6) AS z FROM range(4) g(b) LEFT JOIN (SELECT least((row - 1) * 4 // 16, 3) AS k, z FROM {CELLS} WHERE row BETWEEN 1 AND 17 AND abs(col - 20) <= 3) p ON k = b GROUP BY b")
def vertical_band(spark, sf_dir):
    return r6(profile.vertical_band(cells(spark, sf_dir), "z", 1, 17, 20, 6, 4), "z")


# -- statistics ---------------------------------------------------------------------------------------------------


@query("SELECT min(l_quantity)::BIGINT AS low, ceil(max(l_quantity))::BIGINT AS high, len(range(min(l_quantity)::BIGINT, ceil(max(l_quantity))::BIGINT + 1))::INT AS steps FROM lineitem")
def discrete_bounds(spark, sf_dir):
    return stats.discrete_bounds(table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("steps", F.size("steps"))


@query("SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def series_min_max(spark, sf_dir):
    return stats.series_range(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_values(spark, sf_dir):
    return stats.distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT l_returnflag AS flag, 1.0::DOUBLE AS ref_sdev, round(stddev_pop(l_extendedprice / 1000) / stddev_pop(l_quantity), 6) AS sdev, round(sqrt(var_pop(l_extendedprice / 1000 - l_quantity)) / stddev_pop(l_quantity), 6) AS crmsd, round(corr(l_extendedprice / 1000, l_quantity), 6) AS corr FROM lineitem GROUP BY 1")
def taylor_normalized(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag flag", "l_extendedprice / 1000 p", "l_quantity r")
    return r6(stats.taylor(df, "r", "p", ["flag"], normalize=True), "ref_sdev", "sdev", "crmsd", "corr")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS share, round(quantile_cont({c}, {q}), 6) AS value FROM lineitem" for c in NUMBERS for q in (0.05, 0.5, 0.95)))
def quantile_range(spark, sf_dir):
    found = stats.quantiles(table(spark, sf_dir, "lineitem"), NUMBERS, [0.05, 0.5, 0.95])
    return r6(spark.createDataFrame([(c, q, v) for (c, q), v in found.items()], "column string, share double, value double"), "value")


# -- models -------------------------------------------------------------------------------------------------------

_GAP = "((e.x - t.x) ** 2 + (e.y - t.y) ** 2 + (e.c1 - t.c1) ** 2 + (e.c2 - t.c2) ** 2 + (e.c3 - t.c3) ** 2)"


def _search_sql(max_k: int, folds: int) -> str:
    train = f"(SELECT *, ('0x' || substr(md5(id::VARCHAR), 1, 4))::INT % {folds} AS fold FROM {PTS} WHERE id % 5 <> 0)"
    near = f"SELECT e.id AS eid, e.z AS truth, sqrt({_GAP}) AS d, t.z, row_number() OVER (PARTITION BY e.id ORDER BY {_GAP}, t.id) AS k FROM {train} e JOIN {train} t ON e.fold <> t.fold QUALIFY k <= {max_k}"
    run = "OVER (PARTITION BY eid ORDER BY k)"
    each = {"uniform": f"avg(z) {run}", "distance": f"sum(z / d) {run} / sum(1 / d) {run}", "gaussian": f"sum(z * exp(-d * d / 32)) {run} / sum(exp(-d * d / 32)) {run}"}
    tried = " UNION ALL ".join(f"SELECT eid, truth, k, '{w}' AS weights, {e} AS sm FROM near" for w, e in each.items())
    return f"WITH near AS ({near}), tried AS ({tried}) SELECT k::INT AS k, weights, round(sqrt(avg((sm - truth) ** 2)), 6) AS rmse FROM tried WHERE k >= 2 GROUP BY ALL"


@query(_search_sql(12, 5))
def kknn_search(spark, sf_dir):
    _, tr = sides(spark, sf_dir)
    return r6(knn.search(tr, FEATURES, 12, 5), "rmse")


def _fit_sql(width: float, bins: int, steps: int) -> str:
    """The grid search over ranges with nugget and sill in closed form."""
    binned = f"SELECT (bin + 0.5) * {width} AS gap, count(*)::DOUBLE AS w, avg(sq) / 2 AS g FROM (SELECT floor(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / {width})::BIGINT AS bin, (a.z - b.z) ** 2 AS sq FROM {PTS} a JOIN {PTS} b ON a.id < b.id) WHERE bin < {bins} GROUP BY bin"
    return f"""WITH binned AS ({binned}), reaches AS (SELECT 2 * (SELECT max(gap) FROM binned) * (i + 1) / {steps} AS reach FROM range({steps}) t(i)),
        shaped AS (SELECT reach, w, g, CASE WHEN gap < reach THEN 1.5 * gap / reach - 0.5 * (gap / reach) ** 3 ELSE 1 END AS f FROM binned, reaches),
        sums AS (SELECT reach, sum(w) AS sw, sum(w * f) AS sf, sum(w * f * f) AS sff, sum(w * g) AS sg, sum(w * f * g) AS sfg FROM shaped GROUP BY reach),
        solved AS (SELECT *, CASE WHEN sw * sff - sf * sf > 1e-9 * sw * sff THEN (sff * sg - sf * sfg) / (sw * sff - sf * sf) END AS n0, CASE WHEN sw * sff - sf * sf > 1e-9 * sw * sff THEN (sw * sfg - sf * sg) / (sw * sff - sf * sf) END AS s0 FROM sums),
        pairs AS (SELECT reach, CASE WHEN n0 < 0 THEN 0 WHEN s0 < 0 THEN sg / sw ELSE n0 END AS nugget, CASE WHEN n0 < 0 THEN sfg / sff WHEN s0 < 0 THEN 0 ELSE s0 END AS sill FROM solved WHERE n0 IS NOT NULL),
        judged AS (SELECT p.reach, nugget, sill, sum(w * (nugget + sill * f - g) ** 2) / sum(w) AS error FROM pairs p JOIN shaped s ON s.reach = p.reach GROUP BY ALL)
        SELECT round(nugget, 4) AS nugget, round(sill, 4) AS sill, round(reach, 4) AS "range", round(error, 6) AS error FROM judged WHERE error <= (SELECT min(error) FROM judged) * (1 + 1e-6) ORDER BY reach LIMIT 1"""


def _rounded(c, digits: int):
    """As DuckDB rounds a double, by its multiple: ranges of many steps are ties in decimals, which F.round takes up."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


@query(_fit_sql(0.05, 6, 200))
def variogram_fit(spark, sf_dir):
    """Bins are counted first; the three numbers of the model are one row, or none where no model can be told."""
    fit = stats.fit_variogram(stats.variogram(pts(spark, sf_dir), "x", "y", "z", 0.05, 6), 0.05)
    names = ("nugget", "sill", "range", "error")
    out = spark.createDataFrame([tuple(fit[k] for k in names)] if fit else [], ", ".join(f"`{k}` double" for k in names))
    return out.withColumns({c: _rounded(c, 6 if c == "error" else 4) for c in out.columns})


def _linear_sql() -> str:
    """Coefficients of a regression: of each feature what the others leave, one after another, against the target."""
    parts = []
    for f in FEATURES:
        columns, chain = [c for c in FEATURES if c != f] + [f], f"SELECT {', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in FEATURES)}, z FROM {PTS}"
        for k, c in enumerate(columns[:-1]):
            later = columns[k + 1 :]
            chain = f"SELECT z, {', '.join(f'{x} - sum({x} * {c}) OVER () / sum({c} * {c}) OVER () * {c} AS {x}' for x in later)} FROM ({chain})"
        parts.append(f"SELECT '{f}' AS feature, round(abs(sum({f} * z) / sum({f} * {f})), 5) AS score FROM ({chain})")
    return " UNION ALL ".join(parts)


@query(_linear_sql())
def lr_scores(spark, sf_dir):
    return forest.linear_scores(pts(spark, sf_dir), FEATURES).withColumn("score", F.round("score", 5))


def _information_sql(k: int) -> str:
    parts = []
    for f in FEATURES:
        scaled = f"(SELECT id, {f} / stddev_pop({f}) OVER () AS x, z / stddev_pop(z) OVER () AS z FROM {PTS})"
        gaps = f"(SELECT a.id, abs(a.x - b.x) AS dx, abs(a.z - b.z) AS dz, greatest(abs(a.x - b.x), abs(a.z - b.z)) AS d FROM {scaled} a, {scaled} b)"
        reach = f"(SELECT id, d AS r FROM {gaps} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = {k + 1})"
        counts = f"SELECT id, count(*) FILTER (dx < greatest(r - 1e-9, 1e-9)) AS nx, count(*) FILTER (dz < greatest(r - 1e-9, 1e-9)) AS nz FROM {gaps} JOIN {reach} USING (id) GROUP BY id"
        parts.append(f"SELECT '{f}' AS feature, round(greatest(0, (SELECT h FROM h WHERE m = (SELECT count(*) FROM {PTS}) - 1) + (SELECT h FROM h WHERE m = {k - 1}) - avg(a.h + b.h)), 5) AS score FROM ({counts}) c JOIN h a ON a.m = nx - 1 JOIN h b ON b.m = nz - 1")
    return f"WITH h AS (SELECT 0 AS m, 0::DOUBLE AS h UNION ALL SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) FROM range(1, (SELECT count(*) + 1 FROM embeddings)) t(i)) " + " UNION ALL ".join(parts)


@query(_information_sql(3))
def mi_neighbour_scores(spark, sf_dir):
    """Mutual information by the three nearest neighbours."""
    return forest.neighbour_information(pts(spark, sf_dir), FEATURES).withColumn("score", F.round("score", 5))


@query()
def sbm(spark, sf_dir):
    """One polynomial for each farthest row left out, from sums over all others."""
    ev, tr = sides(spark, sf_dir)
    return local_polynomial.predict_global(ev, tr, ["x", "y"], degree=2, few=0)


@query(f"SELECT e.id AS eid, round((s - arg_max(t.z, [(e.x - t.x) ** 2 + (e.y - t.y) ** 2, t.id])) / (n - 1), 6) AS sm, 0 AS degree FROM {PTS} e, {PTS} t, (SELECT sum(z) AS s, count(*) AS n FROM {PTS} WHERE id % 5 <> 0) WHERE e.id % 5 = 0 AND t.id % 5 <> 0 GROUP BY e.id, s, n")
def sbm_of_degree_0(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return r6(local_polynomial.predict_global(ev, tr, ["x", "y"], degree=0, few=0), "sm")


@query()
def local_polynomial_terms(spark, sf_dir):
    """Terms chosen by the lasso, with every degree's error and the model's monomials by degree."""
    ev, tr = sides(spark, sf_dir)
    return local_polynomial.predict(ev, tr, ["x", "y", "c1"], k=8, degree=2, terms=local_polynomial.Terms("lasso"), details=True)


@query()
def local_polynomial_folds(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return local_polynomial.predict(ev, tr, ["x", "y"], k=12, degree=2, folds=4, terms=local_polynomial.Terms("random", 5))


def _validation_sql() -> str:
    marked = f"(SELECT *, row_number() OVER (ORDER BY md5('17' || id), id) <= round_even(count(*) OVER () * 0.3, 0) AS held FROM {PTS} WHERE id % 5 <> 0)"
    near = f"SELECT e.id, e.z AS old, t.z, row_number() OVER (PARTITION BY e.id ORDER BY {_GAP}, t.id) AS rk FROM {marked} e, {marked} t WHERE e.held AND NOT t.held QUALIFY rk <= 10"
    return f"SELECT round(sqrt(avg((new - old) ** 2)), 6) AS rmse, round(corr(new, old) ** 2, 6) AS r2, count(*) AS n FROM (SELECT old, avg(z) AS new FROM ({near}) GROUP BY id, old)"


@query(_validation_sql())
def validate_holdout(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return r6(models.validated("KNN", tr, ev, FEATURES, validate=1.3, seed=17)[1], "rmse", "r2")


@query(f"SELECT e.id AS eid, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta, round((new - old) / nullif(old, 0), 6) AS relative FROM (SELECT e.id, e.z AS old, t.z AS new, row_number() OVER (PARTITION BY e.id ORDER BY {_GAP}, t.id) AS rk FROM {PTS} e, {PTS} t WHERE e.id % 5 = 0 AND t.id % 5 <> 0 QUALIFY rk = 1) e")
def validate_deltas(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return r6(models.validated("1NN", tr, ev, FEATURES, validate=2)[1], "old", "new", "delta", "relative")


_SCALED = "(SELECT p.id, z, " + ", ".join(f"({c} - avg({c}) FILTER (id % 5 <> 0) OVER ()) / stddev_pop({c}) FILTER (id % 5 <> 0) OVER () AS {c}" for c in FEATURES) + f" FROM {PTS} p)"


@query(f"WITH scaled AS {_SCALED} SELECT e.id AS eid, e.id // 100 AS tile, round(avg(e.tz), 6) AS sm FROM (SELECT e.id, t.z AS tz, row_number() OVER (PARTITION BY e.id ORDER BY {_GAP}, t.id) AS rk FROM scaled e, scaled t WHERE e.id % 5 = 0 AND t.id % 5 <> 0 QUALIFY rk <= 10) e GROUP BY ALL")
def stored_model_by_tile(spark, sf_dir):
    """A model stored with its scaling, read back, applied, and written by tile."""
    ev, tr = sides(spark, sf_dir)
    path = new_path(spark, "model")
    models.store("KNN", tr, FEATURES, path)
    out = models.apply(spark, path, ev.withColumn("tile", F.expr("eid div 100")))
    out.select("tile", "eid", "sm").write.partitionBy("tile").parquet(f"{path}/out")
    back = spark.read.parquet(f"{path}/out")
    return r6(back.select("eid", F.col("tile").cast("long").alias("tile"), "sm"), "sm")


@query()
def stored_forest(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    path = new_path(spark, "model")
    models.store("RF", tr, FEATURES, path, trees=10, depth=6)
    return models.apply(spark, path, ev).select("eid", "sm")


@query()
def kknn_best(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return models.knn_search(tr, ev, FEATURES, max_k=10, folds=5)[0]


@query()
def rf_best(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return models.forest_search(tr, ev, FEATURES, trees=(5, 10), depths=(4, 6), tries=3, folds=2)[0]


# -- points, regions, accuracy ------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer")
def drop_by_place(spark, sf_dir):
    return points.drop_columns(table(spark, sf_dir, "customer"), [1, 2, 4])


@query(f"SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM {PTS} WHERE x > 0 AND y < x")
def mask_by_function(spark, sf_dir):
    return r6(points.mask(pts(spark, sf_dir), lambda c: (c["x"] > 0) & (c["y"] < c["x"])).select("id", "x", "y"), "x", "y")


@query("SELECT s_suppkey AS x, s_nationkey AS y, s_acctbal AS bal, s_name AS name FROM supplier")
def name_layers(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", "s_name")
    return points.name_layers(df, ["x", "y", "bal", "name"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 17")
def rows_by_place(spark, sf_dir):
    """A slice by place, the feature itself."""
    return points.rows_between(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 17, 67)


@query("SELECT a.s_suppkey, b.c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) a FULL JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS k FROM customer) b USING (k)")
def side_by_side(spark, sf_dir):
    return points.side_by_side(table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_custkey")).alias("o")), ["s_suppkey"], ["o"]).drop("o")


@query("SELECT c.nation, n_train, n_evaluation FROM (SELECT c_nationkey AS nation, count(*) AS n_train FROM customer GROUP BY 1) c JOIN (SELECT s_nationkey AS nation, count(*) AS n_evaluation FROM supplier GROUP BY 1) s USING (nation) WHERE least(n_train, n_evaluation) >= 3")
def feasible_regions(spark, sf_dir):
    return points.feasible_regions(table(spark, sf_dir, "customer").selectExpr("c_nationkey nation"), table(spark, sf_dir, "supplier").selectExpr("s_nationkey nation"), ["nation"], parameters=3)


@query("SELECT c_mktsegment AS name, n_name AS state, count(*) AS places FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def region_boundaries(spark, sf_dir):
    """Shapes of the regions that carry one of some names, by their attributes."""
    shapes = table(spark, sf_dir, "customer").selectExpr("'f.shp' file", "c_nationkey record", "0 part", "cast(c_custkey as int) place", "c_acctbal px", "c_acctbal py", "c_mktsegment name")
    fields = table(spark, sf_dir, "nation").selectExpr("'f.dbf' file", "n_nationkey record", "map('NAME_1', n_name) fields")
    wanted = [r[0] for r in table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name").collect()]
    return region.boundaries(shapes, fields, "NAME_1", wanted).groupBy("name", "state").agg(F.count("*").alias("places"))


@query(f"SELECT id, region FROM (SELECT id, CASE WHEN x < 0.1 THEN 'west' ELSE 'east' END AS region, x, y FROM {PTS}) WHERE y BETWEEN -0.1 AND 0.2 AND x BETWEEN -0.2 AND 0.3 AND x <> 0.1")
def point_in_polygon_by_lookup(spark, sf_dir):
    polygons = spark.createDataFrame([("w", "-0.2_0.1_-0.1_0.2"), ("e", "0.1_0.3_-0.1_0.2")], "id string, label string").select("id", region.box_ring(F.col("label")).alias("ring"))
    names = spark.createDataFrame([("BOX", "w", "west"), ("BOX", "e", "east")], "kind string, id string, name string")
    wanted = spark.createDataFrame([("BOX", "w"), ("BOX", "east")], "kind string, code string")
    found = region.lookup(names, wanted).select("id", F.col("name").alias("region"))
    rings = polygons.join(found, "id").select("region", "ring")
    return region.in_regions(pts(spark, sf_dir), rings, square=0.1).select("id", "region")


_METRIC = "format_string('%s,/data/%d/month%d-PCA/CEC_%s/predictions/KKNN.csv', cast({v} as string), 1995 + l_linenumber, l_linenumber, l_returnflag) value"


@query("SELECT (1995 + l_linenumber)::INT AS year, l_linenumber::INT AS month, 'CEC' AS reg_type, l_returnflag AS region, 'KKNN' AS method, round(avg(l_quantity), 4) AS rmse, CASE WHEN l_linenumber < 5 THEN round(avg(l_discount), 4) END AS r2 FROM lineitem GROUP BY l_linenumber, l_returnflag")
def accuracy_gather(spark, sf_dir):
    """Metric lines of two kinds, parsed and brought together; some have no partner."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("a"), F.round(F.avg("l_discount"), 4).alias("b"))
    return accuracy.gather(each.selectExpr(_METRIC.format(v="a")), each.where("l_linenumber < 5").selectExpr(_METRIC.format(v="b")))


# -- files --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey::DOUBLE AS ccustkey, round(c_acctbal, 6) AS x, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey::DOUBLE END AS y FROM customer")
def csv_round_trip(spark, sf_dir):
    """A point table written with a header and NA for missing values, read back, with plain headers."""
    path = new_path(spark, "csv")
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("y"))
    sinks.write_csv(df, path, missing="NA")
    return r6(points.normalise_headers(files.read(spark, "points", path)), "x")


@query("SELECT s_suppkey::DOUBLE AS a, s_nationkey::DOUBLE AS b, round(s_acctbal, 2) AS c FROM supplier")
def delimited_scan(spark, sf_dir):
    """Lines divided by commas and tabs alike, under a header."""
    path = new_path(spark, "lines")
    lines = table(spark, sf_dir, "supplier").select(F.format_string("%d,%d\t%.2f", "s_suppkey", "s_nationkey", "s_acctbal").alias("value"))
    spark.createDataFrame([("a\tb,c",)], "value string").unionByName(lines).repartition(1).sortWithinPartitions(F.col("value") != "a\tb,c").write.text(path)
    return text.delimited(spark, path)


@query(f"SELECT round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS sm FROM {PTS}")
def predictions_round_trip(spark, sf_dir):
    """Predictions without a header at nine decimals, with a degree behind, and the first three columns of them."""
    path = new_path(spark, "predictions")
    sinks.write_predictions(pts(spark, sf_dir).selectExpr("x", "y", "z", "cast(id % 4 as int) degree"), path)
    return text.predictions(spark, path)


@query("SELECT s_suppkey::DOUBLE AS c0, s_nationkey::DOUBLE AS c1 FROM supplier")
def matrix_scan(spark, sf_dir):
    """Numbers divided by blanks below two lines of header."""
    path = new_path(spark, "matrix")
    body = table(spark, sf_dir, "supplier").select(F.format_string("%d   %d", "s_suppkey", "s_nationkey").alias("value"), F.lit(1).alias("k"))
    spark.createDataFrame([("one two", 0), ("3 4", 0)], "value string, k int").unionByName(body).repartition(1).sortWithinPartitions("k", F.desc("value")).select("value").write.text(path)
    return text.matrix(spark, path, 2, header_rows=2, separator="\\s+")


@query(f"SELECT row, col, round(10 + col * 0.5, 6) AS x, round(20 + (n - 1 - row) * 0.5, 6) AS y, nullif(z, -99) AS z FROM {CELLS}, (SELECT max(row) + 1 AS n FROM {CELLS})")
def saga_grid_scan(spark, sf_dir):
    """A grid of a text header and raw numbers, the lowest row first."""
    import numpy as np

    c, path = cells(spark, sf_dir), new_path(spark, "saga")
    n = rows_of(c)
    z = np.full((n, WIDE), -99.0)
    for r in c.select("row", "col", "z").toLocalIterator():
        z[r.row, r.col] = r.z
    head = f"DATAFORMAT\t= DOUBLE\nBYTEORDER_BIG\t= FALSE\nPOSITION_XMIN\t= 10\nPOSITION_YMIN\t= 20\nCELLCOUNT_X\t= {WIDE}\nCELLCOUNT_Y\t= {n}\nCELLSIZE\t= 0.5\nNODATA_VALUE\t= -99\nTOPTOBOTTOM\t= FALSE\n"
    geotiff.save(spark.createDataFrame([("g.sgrd", bytearray(head.encode())), ("g.sdat", bytearray(z[::-1].astype("<f8").tobytes()))], "name string, content binary"), path)
    return _long(binary.saga_grids(spark, path).drop("file"), "x", "y")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'rmse' ELSE 'r2' END AS kind, round(z + id, 4) AS value, (1990 + id % 20)::INT AS year FROM {PTS}")
def metric_lines_appended(spark, sf_dir):
    """Lines of two runs appended to one file set, and parsed again."""
    path = new_path(spark, "metrics")
    lines = pts(spark, sf_dir).select("id", F.round(F.col("z") + F.col("id"), 4).alias("value"), F.format_string("/data/%d/month3-x/CEC_%d/predictions/%s.csv", 1990 + F.col("id") % 20, F.col("id"), F.when(F.col("id") % 2 == 0, "rmse").otherwise("r2")).alias("path"))
    for k in (0, 1):
        sinks.append_metrics(lines.where(F.col("id") % 2 == k), path)
    parsed = spark.read.text(path).select(*scalars.metric_line(F.col("value")))
    return parsed.select(F.col("region").cast("long").alias("id"), F.col("method").alias("kind"), "value", "year")


@query("SELECT reg_type, region FROM (VALUES ('CEC', '10'), ('CEC', '6.2.10'), ('STATE', 'Iowa'), ('STATE', 'Ohio')) t(reg_type, region) UNION ALL SELECT 'BOX', '-100_' || n_nationkey || '_30_40' FROM nation")
def region_catalog_scan(spark, sf_dir):
    """The catalog's file, and a list of regions as a setting has it."""
    path = new_path(spark, "catalog")
    geotiff.save(spark.createDataFrame([("regions.csv", bytearray(b"CEC.lvl1,CEC.lvl3,STATE\nlevel one,level three,a state\n10,6.2.10,Ohio\n,,Iowa\n"))], "name string, content binary"), path)
    settings = config.read_config(config.write_config({"job": {"regions": repr([("BOX", f"-100_{r[0]}_30_40") for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()])}}))
    listed = text.region_list(spark, repr(settings["job"]["regions"]))
    return text.region_catalog(spark, path).unionByName(listed.drop("place"))


@query("SELECT 'KKNN' AS model, k::VARCHAR AS k, w AS weights FROM (SELECT unnest([5, 10]) AS k), (SELECT unnest(['uniform', 'distance']) AS w) UNION ALL SELECT 'HYPPO', d::VARCHAR, NULL FROM (SELECT unnest([1, 2, 3]) AS d)")
def parameter_grid(spark, sf_dir):
    found = config.parameter_grid(spark, {"KKNN": {"k": [5, 10], "weights": ["uniform", "distance"]}, "HYPPO": {"k": [1, 2, 3]}})
    return found.select("model", F.col("flags")["k"].alias("k"), F.col("flags")["weights"].alias("weights"))


@query(f"SELECT round(col + 0.5, 7) AS x, round(n - row - 0.5, 7) AS y, round(z, 7) AS z, row_number() OVER (ORDER BY row, col) AS place FROM {CELLS}, (SELECT max(row) + 1 AS n FROM {CELLS})")
def xyz_in_raster_order(spark, sf_dir):
    """Points written north to south and west to east, in files whose names keep that order."""
    c, path = cells(spark, sf_dir), new_path(spark, "xyz")
    sinks.write_raster(c, fine(rows_of(c)), ["z"], path, "XYZ")
    from pyspark.sql import Window

    back = spark.read.schema("x double, y double, z double").option("header", True).csv(path)
    order = Window.partitionBy(F.lit(0)).orderBy("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())  # the order is what is read here
    return r6(back.withColumn("place", F.row_number().over(order).cast("long")), "x", "y", "z")


# -- scalars ------------------------------------------------------------------------------------------------------


def _features_sql() -> str:
    rows = ", ".join("('%s', '%s', '%s')" % (k, v, scalars.FEATURE_SHORT[v]) for k, v in scalars.FEATURE_NAMES.items())
    return f"SELECT p_partkey, name, short, short || ' : ' || name AS label FROM (SELECT p_partkey, p_partkey % {len(scalars.FEATURE_NAMES) + 1} AS k FROM part) LEFT JOIN (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {rows}) t(raw, name, short)) USING (k)"


@query(_features_sql())
def feature_label_lookup(spark, sf_dir):
    raw = F.try_element_at(F.array(*map(F.lit, scalars.FEATURE_NAMES)), F.expr(f"cast(p_partkey % {len(scalars.FEATURE_NAMES) + 1} + 1 as int)"))
    found = table(spark, sf_dir, "part").select("p_partkey", scalars.feature_name(raw).alias("name"), scalars.feature_short(raw).alias("short"))
    return found.withColumn("label", F.when(F.col("name").isNotNull(), scalars.label_with_abbreviation(F.col("short"), F.col("name"))))


@query("SELECT o_orderkey, day(last_day(o_orderdate))::INT AS days, len(generate_series(date_trunc('month', o_orderdate)::DATE, o_orderdate::DATE, INTERVAL 1 DAY))::INT AS so_far, strftime(o_orderdate, '%b') AS month, lpad((o_orderkey % 1000)::VARCHAR, 4, '0') AS name FROM orders")
def scalar_dates(spark, sf_dir):
    date = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.last_day(F.year(date), F.month(date)).alias("days"), F.size(scalars.date_sequence(F.trunc(date, "month"), date)).alias("so_far"), scalars.month_name(F.month(date)).alias("month"), scalars.zero_padded(F.col("o_orderkey") % 1000).alias("name"))


@query("SELECT event_id, CASE WHEN value <= 10 THEN 10 WHEN value <= 20 THEN 20 ELSE 40 END::DOUBLE AS first, 20::DOUBLE AS second, ceil(value)::DOUBLE AS whole FROM events")
def scalar_round_lists(spark, sf_dir):
    v = F.col("value")
    up = scalars.round_list_to(F.array(v, F.lit(15.0)), [10, 20, 40], "up")
    return table(spark, sf_dir, "events").select("event_id", up[0].alias("first"), up[1].alias("second"), scalars.round_to_scale(v, [], "up").alias("whole"))


@query("SELECT event_id, round(least(greatest(1 + 2 * v - 3 * w + 0.5 * v * v + v * w - w * w, 0), 1), 4) AS p FROM (SELECT event_id, value / 100 AS v, (user_id % 10) / 10 AS w FROM events)")
def scalar_polynomial(spark, sf_dir):
    v, w = F.col("value") / 100, (F.col("user_id") % 10) / 10
    p = scalars.evaluate_polynomial(F.array(*map(F.lit, (1.0, 2.0, -3.0, 0.5, 1.0, -1.0))), [v, w], 2)
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.clamp(p), 4).alias("p"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN TRUE ELSE FALSE END AS flag, c_custkey % 4 <> 0 AS whole, 'part_' || c_custkey || '_done' AS path, 'month' || (c_custkey % 12 + 1) || CASE WHEN c_custkey % 2 = 0 THEN '-LvlUp' ELSE '' END || CASE WHEN c_custkey % 5 > 0 THEN '-' || (c_custkey % 5) || 'meter' ELSE '' END || '-PCA-0.30_7' AS suffix FROM customer")
def scalar_texts(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        scalars.str_to_bool(F.when(k % 3 == 0, " Yes ").otherwise("f")).alias("flag"),
        scalars.is_int(F.when(k % 4 != 0, k.cast("string")).otherwise("4.5")).alias("whole"),
        scalars.with_suffix(F.concat(F.lit("part_"), k.cast("string"), F.lit("/")), "_done").alias("path"),
        scalars.run_suffix((k % 12 + 1).cast("int"), k % 2 == 0, (k % 5).cast("int"), F.lit(True), F.lit(1.3), F.lit(7)).alias("suffix"),
    )


@query("SELECT p_partkey, CASE WHEN p_name LIKE '% %' THEN list_aggregate(list_transform(string_split(p_name, ' '), lambda w: left(w, 2)), 'string_agg', '. ') ELSE p_name END AS short, rtrim(split_part(p_brand || '  | ' || p_type, '|', 1)) AS label FROM part")
def scalar_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.abbreviation(F.col("p_name")).alias("short"), scalars.strip_label(F.concat_ws("  | ", "p_brand", "p_type")).alias("label"))


@query(f"SELECT c_custkey, round((c_acctbal - m) / d, 6) AS z FROM {_HELD}, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM {_HELD} WHERE NOT held_out) WHERE held_out")
def scaled_hold_out(spark, sf_dir):
    """Held-out rows on the scale of the others."""
    marked = prep.hold_out(table(spark, sf_dir, "customer"), "c_custkey", 0.3, 17)
    known, held = marked.where("not held_out"), marked.where("held_out")
    return r6(prep.standardise(known, held, ["c_acctbal"]).select("c_custkey", F.col("c_acctbal").alias("z")), "z")


@query(f"SELECT id, round(6371007.181::DOUBLE * c / sin(c) * cos(phi) * sin(lam), 3) AS x FROM (SELECT id, radians(37.5 + y * 40) AS phi, radians(x * 100) AS lam, acos(greatest(-1, least(1, sin(radians(37.5)) * sin(radians(37.5 + y * 40)) + cos(radians(37.5)) * cos(radians(37.5 + y * 40)) * cos(radians(x * 100))))) AS c FROM {PTS})")
def azimuthal_forward(spark, sf_dir):
    x, y = projection.azimuthal_equidistant(F.lit(-96) + F.col("x") * 100, F.lit(37.5) + F.col("y") * 40, -96.0, 37.5)
    return pts(spark, sf_dir).select("id", F.round(x, 3).alias("x"))

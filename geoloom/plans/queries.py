"""Registered queries of the library's own operators, each with its SQL twin where SQL can express it.

Roles: the raster is `part` (row and column of p_partkey, band p_retailprice), the daily series is `lineitem` (cell
l_partkey, day l_shipdate), points are `embeddings` (x and y its first two numbers, covariates the next, target
label), regions are `nation` within `region`. Doubles are rounded on both sides, half away from zero.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import accuracy, forest, grid, knn, local_polynomial, points, prep, profile, projection, region, stats, terrain
from ..sources import sinks
from ..streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WIDE = 50
CELLS = f"(SELECT p_partkey // {WIDE} AS row, p_partkey % {WIDE} AS col, p_retailprice AS z, p_size AS s FROM part)"
PTS = "(SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS c1, embedding[4]::DOUBLE AS c2, embedding[5]::DOUBLE AS c3, label::DOUBLE / 10 AS z FROM embeddings)"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(f"cast(p_partkey div {WIDE} as int) row", f"cast(p_partkey % {WIDE} as int) col", "p_retailprice z", "p_size s")


def pts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id id", *(f"cast(embedding[{i}] as double) {n}" for i, n in enumerate(("x", "y", "c1", "c2", "c3"))), "cast(label as double) / 10 z")


def r6(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def sides(spark, sf_dir):
    p = pts(spark, sf_dir)
    return p.where("id % 5 = 0").withColumnRenamed("id", "eid"), p.where("id % 5 != 0").withColumnRenamed("id", "tid")


# -- points and filters -------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS custkey, c_name AS cname, c_acctbal AS z FROM customer")
def points_project_rename(spark, sf_dir):
    df = points.keep_columns(table(spark, sf_dir, "customer"), [0, 1, 3]).withColumnsRenamed({"c_custkey": "cust_key", "c_name": "c_name", "c_acctbal": "z"})
    return points.normalise_headers(df)


@query("SELECT event_id, value FROM events WHERE value > 10 AND value < 60")
def range_filter_strict(spark, sf_dir):
    return points.clear_outliers(table(spark, sf_dir, "events"), "value", 10, 60, strict=True).select("event_id", "value")


@query(f"SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM {PTS} WHERE x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.2 AND 0.1")
def bbox_crop(spark, sf_dir):
    return r6(points.crop_box(pts(spark, sf_dir), "x", "y", (0.15, -0.1), (-0.2, 0.1)).select("id", "x", "y"), "x", "y")


@query(f"SELECT row, col, s FROM {CELLS} WHERE s <> 7")
def sentinel_filter(spark, sf_dir):
    return points.drop_sentinel(cells(spark, sf_dir), ["s"], 7).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "s")


@query(f"SELECT row, col, coalesce(nullif(s, 7), 0)::DOUBLE AS s FROM {CELLS} WHERE nullif(s, 9) IS NOT NULL")
def fill_drop_nulls(spark, sf_dir):
    c = cells(spark, sf_dir).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("s").cast("double").alias("s"))
    c = points.nan_to_null(c, 9.0).na.drop()
    return points.nan_to_null(c, 7.0).na.fill(0.0)


# -- months -------------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS cell, month(l_shipdate)::INT AS month, round(avg(l_discount), 6) AS sm FROM lineitem GROUP BY ALL")
def month_mean_by_cell(spark, sf_dir):
    return r6(table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell"), F.month("l_shipdate").alias("month")).agg(F.avg("l_discount").alias("sm")), "sm")


@query("SELECT l_partkey AS cell, " + ", ".join(f'round(avg(l_discount) FILTER (month(l_shipdate) = {m}), 6) AS "m{m}"' for m in range(1, 13)) + " FROM lineitem GROUP BY 1")
def monthly_pivot_wide(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), F.month("l_shipdate").alias("month"), "l_discount")
    wide = df.groupBy("cell").pivot("month", list(range(1, 13))).avg("l_discount").withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})
    return r6(wide, *(f"m{m}" for m in range(1, 13)))


@query('SELECT l_partkey AS cell, round(avg(l_discount) FILTER (month(l_shipdate) = 4), 6) AS z FROM lineitem GROUP BY 1')
def keep_month(spark, sf_dir):
    wide = monthly_pivot_wide(spark, sf_dir)
    return points.rename_target(points.keep_month(points.monthify(wide), 4), 1)


# -- statistics ---------------------------------------------------------------------------------------------------


def _column_stats_sql():
    each = {"count": "count({c})::DOUBLE", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "range": "max({c}) - min({c})", "qnt25": "quantile_cont({c}, 0.25)", "qnt75": "quantile_cont({c}, 0.75)"}
    return " UNION ALL ".join(f"SELECT '{s}' AS stat, '{c}' AS \"column\", round({e.format(c=c)}, 4) AS value FROM lineitem" for c in NUMBERS for s, e in each.items())


@query(_column_stats_sql())
def column_stats(spark, sf_dir):
    return stats.describe(table(spark, sf_dir, "lineitem"), NUMBERS).withColumn("value", F.round("value", 4))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM lineitem" for a in NUMBERS for b in NUMBERS))
def corr_matrix(spark, sf_dir):
    return r6(stats.pairs(table(spark, sf_dir, "lineitem"), NUMBERS), "value")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*)::DOUBLE AS value FROM (SELECT nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem) WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in ("l_tax", "l_discount") for b in ("l_tax", "l_discount")))
def pair_counts(spark, sf_dir):
    df = points.nan_to_null(table(spark, sf_dir, "lineitem").select("l_tax", "l_discount"), 0.0)
    return stats.pairs(df, ["l_tax", "l_discount"], "count")


@query("SELECT l_returnflag AS flag, round(sqrt(avg((l_extendedprice / 1000 - l_quantity) ** 2)), 6) AS rmse, round(corr(l_extendedprice / 1000, l_quantity) ** 2, 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def rmse_r2(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag flag", "l_extendedprice / 1000 new", "l_quantity old")
    return r6(accuracy.metrics(df, ["flag"]), "rmse", "r2")


@query("SELECT l_returnflag AS flag, round(stddev_pop(l_quantity), 6) AS ref_sdev, round(stddev_pop(l_extendedprice / 1000), 6) AS sdev, round(sqrt(var_pop(l_extendedprice / 1000 - l_quantity)), 6) AS crmsd, round(corr(l_extendedprice / 1000, l_quantity), 6) AS corr FROM lineitem GROUP BY 1")
def taylor_stats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag flag", "l_extendedprice / 1000 p", "l_quantity r")
    return r6(stats.taylor(df, "r", "p", ["flag"]), "ref_sdev", "sdev", "crmsd", "corr")


@query("SELECT least(floor(v * 100)::BIGINT + 1, 100) AS bin, count(*) AS n FROM (SELECT value / 128 AS v FROM events) WHERE v BETWEEN 0 AND 1 GROUP BY 1")
def histogram_100(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events").selectExpr("value / 128 v"), "v")


@query("SELECT grp, greatest(0.0::DOUBLE, max(mn)) AS low, least(1.0::DOUBLE, min(mx)) AS high FROM (SELECT l_returnflag AS grp, l_linestatus AS m, min(l_discount) AS mn, max(l_discount) AS mx FROM lineitem GROUP BY ALL) GROUP BY 1")
def range_intersection(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag grp", "l_linestatus m", "l_discount v")
    return stats.range_intersection(df, ["grp"], "m", "v")


@query("SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS low FROM lineitem")
def rowwise_min(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.least("l_discount", "l_tax").alias("low"))


@query("SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.7) FROM events)")
def percentile_threshold(spark, sf_dir):
    return stats.above_percentile(table(spark, sf_dir, "events").select("event_id", "value"), "value", 0.7)


@query(f"SELECT bin, count(*) AS n, round(avg(sq) / 2, 6) AS gamma FROM (SELECT floor(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 0.05)::BIGINT AS bin, (a.z - b.z) ** 2 AS sq FROM {PTS} a JOIN {PTS} b ON a.id < b.id) WHERE bin < 4 GROUP BY 1")
def variogram_bins(spark, sf_dir):
    return r6(stats.variogram(pts(spark, sf_dir), "x", "y", "z", 0.05, 4), "gamma")


# -- grids --------------------------------------------------------------------------------------------------------


@query(f"SELECT row // 3 AS row, col // 3 AS col, round(avg(z), 6) AS z FROM {CELLS} GROUP BY ALL")
def coarsify_block_mean(spark, sf_dir):
    return r6(grid.coarsen(cells(spark, sf_dir), 3, "z"), "z")


#: Tiles of the whole raster, 4 x 4 with a halo of 2.
TILED = f"(SELECT row, col, z, tr, tc FROM {CELLS}, (SELECT (max(row) + 4) // 4 AS h FROM {CELLS}), (SELECT unnest(range(4)) AS tr), (SELECT unnest(range(4)) AS tc) WHERE row BETWEEN tr * h - 2 AND tr * h + h + 1 AND col BETWEEN tc * 13 - 2 AND tc * 13 + 14)"


def rows_of(c):
    """Rows of a raster: one number."""
    return (c.agg(F.max("row")).first()[0] or 0) + 1


@query(f"SELECT row, col, tr AS tile_row, tc AS tile_col FROM {TILED}")
def tile_halo_explode(spark, sf_dir):
    c = cells(spark, sf_dir)
    out = grid.tiles(c, rows_of(c), WIDE, 4, 2)
    return out.selectExpr("cast(row as bigint) row", "cast(col as bigint) col", "cast(tile_row as bigint) tile_row", "cast(tile_col as bigint) tile_col")


@query(f"SELECT row, col, round(avg(z + 10 * tr + tc), 6) AS z FROM {TILED} GROUP BY ALL")
def mosaic_overlap_avg(spark, sf_dir):
    """Tiles that differ where they overlap."""
    c = cells(spark, sf_dir)
    tiled = grid.tiles(c, rows_of(c), WIDE, 4, 2).withColumn("z", F.expr("z + 10 * tile_row + tile_col"))
    return grid.mosaic(tiled, "z").selectExpr("cast(row as bigint) row", "cast(col as bigint) col", "round(z, 6) z")


@query("SELECT l_suppkey AS row, l_linenumber::BIGINT AS col, max_by(l_quantity, l_orderkey * 10000.0::DOUBLE + l_linenumber * 100 + l_quantity) AS z FROM lineitem GROUP BY ALL")
def merge_last_wins(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey row", "cast(l_linenumber as bigint) col", "l_quantity z", "l_orderkey * 10000.0D + l_linenumber * 100 + l_quantity at")
    return grid.merge_last(df, "z", "at")


@query(f"SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, z, s FROM (SELECT row, col, z FROM {CELLS} WHERE s % 3 <> 0) a FULL JOIN (SELECT row, col, s FROM {CELLS} WHERE s % 5 <> 0) b ON a.row = b.row AND a.col = b.col")
def band_stack(spark, sf_dir):
    c = cells(spark, sf_dir).selectExpr("cast(row as bigint) row", "cast(col as bigint) col", "z", "s")
    return grid.stack(c.where("s % 3 <> 0").select("row", "col", "z"), c.where("s % 5 <> 0").select("row", "col", "s"))


FINE = grid.Grid(0.0, 1.0, 40.0, 1.0, 40, WIDE)


def fine(nrow: int) -> grid.Grid:
    return grid.Grid(0.0, 1.0, float(nrow), 1.0, nrow, WIDE)


@query(f"SELECT r.row, k.col, z FROM (SELECT unnest(range((SELECT (max(row) + 5) // 5 FROM {CELLS}))) AS row) r, (SELECT unnest(range(10)) AS col) k LEFT JOIN {CELLS} c ON c.row = r.row * 5 + 2 AND c.col = k.col * 5 + 2")
def resample_nearest(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = rows_of(c)
    out = grid.resample_nearest(grid.Grid(0.0, 5.0, float(n), 5.0, -(-n // 5), 10), fine(n), c, "z")
    return out.selectExpr("cast(row as bigint) row", "cast(col as bigint) col", "z")


@query(f"SELECT col + 0.5::DOUBLE AS x, 39.5::DOUBLE - row AS y, z FROM {CELLS} WHERE s <> 7")
def raster_to_points(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("s", F.col("s").cast("double"))
    return grid.to_points(c, FINE, ["z", "s"], 7.0).drop("s")


@query("SELECT g.row, g.col, round(m.v, 6) AS v FROM (SELECT i // 20 AS row, i % 20 AS col FROM range(400) t(i)) g LEFT JOIN (SELECT floor((0.5 - y) / 0.05)::BIGINT AS row, floor((x + 0.5) / 0.05)::BIGINT AS col, avg(z) AS v FROM " + PTS + " GROUP BY ALL) m ON g.row = m.row AND g.col = m.col")
def points_to_raster_gaps(spark, sf_dir):
    out = grid.to_raster(pts(spark, sf_dir).withColumnRenamed("z", "v"), grid.Grid(-0.5, 0.05, 0.5, 0.05, 20, 20), "v")
    return r6(out.selectExpr("cast(row as bigint) row", "cast(col as bigint) col", "v"), "v")


@query(f"SELECT e.event_id, c.z, c.s FROM (SELECT event_id, value, (SELECT max(row) FROM {CELLS}) - event_id % (SELECT max(row) + 1 FROM {CELLS}) AS at FROM events) e LEFT JOIN {CELLS} c ON c.col = floor(e.value)::BIGINT AND c.row = e.at")
def extract_at_points(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = rows_of(c)
    p = table(spark, sf_dir, "events").selectExpr("event_id", "value x", f"event_id % {n} + 0.5D y")
    return grid.extract(p, c, fine(n), ["z", "s"]).select("event_id", "z", "s")


_WINDOW = f"""(SELECT e.row, e.col, a.z AS a, b.z AS b, c.z AS c, d.z AS d, e.z AS e, f.z AS f, g.z AS g, h.z AS h, i.z AS i FROM {CELLS} e
 """ + " ".join(f"LEFT JOIN {CELLS} {n} ON {n}.row = e.row + {dr} AND {n}.col = e.col + {dc}" for n, dr, dc in zip("abcdfghi", (-1, -1, -1, 0, 0, 1, 1, 1), (-1, 0, 1, -1, 1, -1, 0, 1))) + ")"
_HORN = f"(SELECT row, col, ((c + 2 * f + i) - (a + 2 * d + g)) / 8 AS dx, ((g + 2 * h + i) - (a + 2 * b + c)) / 8 AS dy FROM {_WINDOW})"


def _long(df, *columns):
    return r6(df.withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")}), *columns)


@query(f"SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM {_HORN}")
def slope(spark, sf_dir):
    return _long(terrain.slope(cells(spark, sf_dir), "z"), "slope")


@query(f"SELECT row, col, round(CASE WHEN dx IS NULL OR dy IS NULL THEN NULL WHEN dx = 0 AND dy = 0 THEN 0 ELSE fmod(90 - degrees(atan2(dy, -dx)) + 360, 360) END, 6) AS aspect FROM {_HORN}")
def aspect(spark, sf_dir):
    return _long(terrain.aspect(cells(spark, sf_dir), "z"), "aspect")


@query(f"SELECT row, col, round(CASE WHEN l <= 0 THEN 1 ELSE 1 + 254 * l END, 6) AS hillshade FROM (SELECT row, col, (sin(radians(45)) - cos(radians(45)) * (dx * sin(radians(315)) - dy * cos(radians(315)))) / sqrt(1 + dx * dx + dy * dy) AS l FROM {_HORN})")
def hillshade(spark, sf_dir):
    return _long(terrain.hillshade(cells(spark, sf_dir), "z"), "hillshade")


@query(f"SELECT row, col, round(CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE -2 * (dd * gg * gg + ee * hh * hh + ff * gg * hh) / s END, 6) AS profile, round(CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE 2 * (dd * hh * hh + ee * gg * gg - ff * gg * hh) / s END, 6) AS plan FROM (SELECT *, gg * gg + hh * hh AS s FROM (SELECT row, col, (d + f) / 2 - e AS dd, (b + h) / 2 - e AS ee, (c + g - a - i) / 4 AS ff, (f - d) / 2 AS gg, (b - h) / 2 AS hh FROM {_WINDOW}))")
def curvature(spark, sf_dir):
    return _long(terrain.curvature(cells(spark, sf_dir), "z"), "profile", "plan")


# -- regions ------------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey || '.' || n_nationkey AS code, 2 AS level, n_regionkey::VARCHAR AS parent FROM nation")
def region_rollup_superlevel(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").selectExpr("concat(n_regionkey, '.', n_nationkey) code")
    return region.with_parent(codes.withColumn("level", scalars.region_level(F.col("code"))))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)")
def region_min_points(spark, sf_dir):
    return points.large_groups(table(spark, sf_dir, "customer"), ["c_nationkey"], 60).select("c_custkey", "c_nationkey")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def region_train_eval_intersect(spark, sf_dir):
    return points.groups_in_both(table(spark, sf_dir, "customer").selectExpr("c_nationkey nation"), table(spark, sf_dir, "supplier").selectExpr("s_nationkey nation"), ["nation"])


@query("SELECT i::INT AS i, j::INT AS j, (-100 + i * 5)::DOUBLE AS x1, (-95 + i * 5)::DOUBLE AS x2, (30 + j * 2)::DOUBLE AS y1, (32 + j * 2)::DOUBLE AS y2, (-100 + i * 5) || '_' || (-95 + i * 5) || '_' || (30 + j * 2) || '_' || (32 + j * 2) AS label FROM range(4) a(i), range(3) b(j)")
def box_grid(spark, sf_dir):
    return region.boxes(spark, -100, -80, 30, 36, 4, 3)


@query(f"SELECT id, CASE WHEN x < 0.1 THEN 'west' ELSE 'east' END AS region FROM {PTS} WHERE y > -0.1 AND y < 0.2 AND x > -0.2 AND x < 0.3")
def point_in_polygon(spark, sf_dir):
    polygons = spark.createDataFrame([("west", "-0.2_0.1_-0.1_0.2"), ("east", "0.1_0.3_-0.1_0.2")], "region string, label string").select("region", region.box_ring(F.col("label")).alias("ring"))
    return region.in_regions(pts(spark, sf_dir), polygons, square=0.1).select("id", "region")


# -- preparation --------------------------------------------------------------------------------------------------

_HELD = "(SELECT *, row_number() OVER (ORDER BY md5('17' || c_custkey), c_custkey) <= round_even(count(*) OVER () * 0.3, 0) AS held_out FROM customer)"


@query(f"SELECT c_custkey, held_out FROM {_HELD}")
def holdout_split(spark, sf_dir):
    return prep.hold_out(table(spark, sf_dir, "customer"), "c_custkey", 0.3, 17).select("c_custkey", "held_out")


@query(f"SELECT c_custkey, c_acctbal FROM {_HELD} WHERE NOT held_out")
def holdout_anti_join(spark, sf_dir):
    return prep.hold_out(table(spark, sf_dir, "customer"), "c_custkey", 0.3, 17).where("not held_out").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size FROM part")
def standardize(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return r6(prep.standardise(df, df, ["p_retailprice", "p_size"]), "p_retailprice", "p_size")


@query("SELECT p_partkey, round(((p_size - min(p_size) OVER ()) / stddev_pop(p_size) OVER ()) ** 2, 6) AS p_size FROM part")
def shift_scale_flatten(spark, sf_dir):
    return r6(prep.shift_scale(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_size"], 2.0, True), "p_size")


@query()
def pca_components(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    _, out = prep.joint_pca(tr, ev, ["x", "y", "c1", "c2", "c3"])
    return out


# -- neighbours and models ----------------------------------------------------------------------------------------


def _near_sql(k, scale="1, 1, 1, 1, 1"):
    a, b, c, d, e = scale.split(", ")
    gap = f"({a} * (e.x - t.x)) ** 2 + ({b} * (e.y - t.y)) ** 2 + ({c} * (e.c1 - t.c1)) ** 2 + ({d} * (e.c2 - t.c2)) ** 2 + ({e} * (e.c3 - t.c3)) ** 2"
    return f"(SELECT e.id AS eid, t.id AS tid, sqrt({gap}) AS d, t.z, row_number() OVER (PARTITION BY e.id ORDER BY {gap}, t.id) AS rk FROM {PTS} e, {PTS} t WHERE e.id % 5 = 0 AND t.id % 5 <> 0 QUALIFY rk <= {k})"


FEATURES = ["x", "y", "c1", "c2", "c3"]


@query(f"SELECT eid, round(avg(z), 6) AS sm FROM {_near_sql(10)} GROUP BY 1")
def knn_mean(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return r6(knn.mean(knn.join(ev, tr, 10, FEATURES)), "sm")


@query(f"SELECT round(sqrt(avg((n.z - p.z) ** 2)), 6) AS rmse, round(corr(n.z, p.z) ** 2, 6) AS r2, count(*) AS n FROM {_near_sql(1, '1, 2, 0, 0, 0')} n JOIN {PTS} p ON n.eid = p.id")
def nn1_downscale(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    near = knn.mean(knn.join(ev, tr, 1, ["x", "y"], scale=[1.0, 2.0]))
    pairs = near.join(ev.select("eid", F.col("z").alias("old")), "eid").withColumnRenamed("sm", "new")
    return r6(accuracy.metrics(pairs, []), "rmse", "r2")


@query(f"SELECT eid, round(sum(z / d) / sum(1 / d), 6) AS sm FROM {_near_sql(10)} GROUP BY 1")
def knn_distance_weight(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return r6(knn.weighted(knn.join(ev, tr, 10, FEATURES), "distance"), "sm")


@query(f"SELECT eid, round(sum(z * exp(-d * d / 32)) / sum(exp(-d * d / 32)), 6) AS sm FROM {_near_sql(10)} GROUP BY 1")
def knn_gaussian_weight(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return r6(knn.weighted(knn.join(ev, tr, 10, FEATURES), "gaussian"), "sm")


@query()
def local_polynomial_10(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return local_polynomial.predict(ev, tr, ["x", "y", "c1"], k=10, degree=2)


@query()
def rf_predict(spark, sf_dir):
    ev, tr = sides(spark, sf_dir)
    return forest.predict(ev, tr, FEATURES, trees=20, depth=8).select("eid", "sm")


@query(f"SELECT feature, round(r * r * (n - 2) / (1 - r * r), 4) AS score, row_number() OVER (ORDER BY r * r DESC, feature)::INT AS rank FROM ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, corr({c}, z) AS r, count(*) AS n FROM {PTS}''' for c in FEATURES)})")
def feature_fscore_rank(spark, sf_dir):
    out = forest.ranked(forest.univariate_scores(pts(spark, sf_dir).withColumn("g", F.lit(1)), FEATURES, group=["g"]), ["g"])
    return out.select("feature", F.round("score", 4).alias("score"), "rank")


@query(f"SELECT feature, round(sum(n / t * ln(n * t / (na * nb))), 6) AS score FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, a) AS na, sum(n) OVER (PARTITION BY feature, b) AS nb FROM ({' UNION ALL '.join(f'''SELECT feature, a, b, count(*)::DOUBLE AS n FROM (SELECT '{c}' AS feature, least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 16), 15) AS a, least(floor((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 16), 15) AS b FROM {PTS}) GROUP BY ALL''' for c in FEATURES)})) GROUP BY 1")
def mi_scores(spark, sf_dir):
    return r6(forest.information_scores(pts(spark, sf_dir), FEATURES), "score")


@query()
def rf_scores(spark, sf_dir):
    return forest.forest_scores(pts(spark, sf_dir), FEATURES, trees=20)


# -- accuracy, profiles, scalars ----------------------------------------------------------------------------------


@query("SELECT round(o_orderkey, 0)::DOUBLE AS x, o_custkey::DOUBLE AS y, round(o_totalprice, 6) AS old, round(l.s, 6) AS new, round(l.s - o_totalprice, 4) AS delta, round((l.s - o_totalprice) / nullif(o_totalprice, 0), 6) AS relative FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def residual_join(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    observed = orders.selectExpr("cast(o_orderkey as double) x", "cast(o_custkey as double) y", "o_totalprice z")
    predicted = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("sm")).join(orders, "o_orderkey").selectExpr("cast(o_orderkey as double) x", "cast(o_custkey as double) y", "sm")
    return r6(accuracy.residuals(observed, predicted).withColumn("delta", F.round("delta", 4)), "old", "new", "relative")


@query("SELECT n.n_name AS region, m AS month, k, w AS weights FROM nation n, range(1, 13) a(m), (SELECT unnest([5, 10, 20]) AS k), (SELECT unnest(['uniform', 'distance']) AS w)")
def param_grid_cross(spark, sf_dir):
    months = spark.range(1, 13).selectExpr("id month")
    grid_ = spark.range(1).select(F.explode(F.array(*map(F.lit, (5, 10, 20)))).alias("k")).withColumn("weights", F.explode(F.array(F.lit("uniform"), F.lit("distance"))))
    return table(spark, sf_dir, "nation").selectExpr("n_name region").crossJoin(months).crossJoin(grid_)


@query("SELECT l_orderkey * 1.5 AS value, 1995 + l_linenumber AS year, l_linenumber AS month, 'CEC' AS reg_type, l_returnflag || '_' || l_linestatus AS region, 'KKNN' AS method FROM lineitem")
def suffix_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("format_string('%.1f,/data/%d/month%d-PCA/CEC_%s_%s/predictions/KKNN.csv', l_orderkey * 1.5D, 1995 + l_linenumber, l_linenumber, l_returnflag, l_linestatus) line")
    return lines.select(*scalars.metric_line(F.col("line")))


ORACLE_SQL["suffix_parse"] = "SELECT (l_orderkey * 1.5)::DOUBLE AS value, (1995 + l_linenumber)::INT AS year, l_linenumber::INT AS month, 'CEC' AS reg_type, l_returnflag || '_' || l_linestatus AS region, 'KKNN' AS method FROM lineitem"


@query(f"SELECT i::INT AS step, sqrt((i * 2)::DOUBLE ** 2 * 0 + (c.col - 2) ** 2 + (c.row - 3) ** 2) AS distance, c.z FROM range(31) t(i) JOIN {CELLS} c ON c.col = 2 + i AND c.row = round_even(3 + i * 0.5, 0)")
def line_profile(spark, sf_dir):
    return r6(profile.line(cells(spark, sf_dir), "z", 2, 3, 32, 18), "distance")


ORACLE_SQL["line_profile"] = f"SELECT i::INT AS step, round(sqrt(i::DOUBLE ** 2 + (round_even(3 + i * 0.5::DOUBLE, 0) - 3) ** 2), 6) AS distance, c.z FROM range(31) t(i) LEFT JOIN {CELLS} c ON c.col = 2 + i AND c.row = round_even(3 + i * 0.5::DOUBLE, 0)"


@query(f"SELECT b::INT AS bin, round(coalesce(avg(z), 0), 6) AS z FROM range(10) g(b) LEFT JOIN (SELECT least(floor(((col - 5) * 0.8 + (row - 5) * 0.6) * 10 / 25), 9) AS k, z FROM (SELECT col::DOUBLE AS col, row::DOUBLE AS row, z FROM {CELLS}) WHERE abs((col - 5) * 15 - (row - 5) * 20) / 25 <= 3 AND ((col - 5) * 20 + (row - 5) * 15) / 25 BETWEEN 0 AND 25) p ON k = b GROUP BY b")
def band_profile(spark, sf_dir):
    return r6(profile.band(cells(spark, sf_dir), "z", 5, 5, 25, 20, 6, 10), "z")


ORACLE_SQL["band_profile"] = ORACLE_SQL["band_profile"].replace("((col - 5) * 0.8 + (row - 5) * 0.6) * 10 / 25", "((col - 5) * 20 + (row - 5) * 15) / 25 * 10 / 25")


@query("SELECT event_id, trunc(255 * (least(greatest(value, 10), 60) - 10) / 50)::INT AS shade FROM events")
def intensity_scale(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.intensity(F.col("value"), 10.0, 60.0).alias("shade"))


@query(f"SELECT i // 12 AS row, i % 12 AS col, coalesce(z, 1) AS z FROM range(144) t(i) LEFT JOIN {CELLS} c ON c.row = i // 12 + 4 AND c.col = i % 12 + 6 AND i // 12 < 8")
def roi_pad(spark, sf_dir):
    return profile.region_of_interest(cells(spark, sf_dir), "z", 4, 6, 8, 12).selectExpr("cast(row as bigint) row", "cast(col as bigint) col", "z")


@query("SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}]+', '', 'g') AS plain FROM part")
def scalar_alphanumeric(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.alphanumeric(F.col("p_name")).alias("plain"))


@query("SELECT h, m::INT AS m FROM (VALUES ('X1', 1), ('c12', 12), ('Mar.mean', 3), ('m13', 0), ('Cross-Sectional_Curvature', 0), ('september', 9), ('7', 7), ('x', 0)) t(h, m)")
def scalar_month_to_int(spark, sf_dir):
    rows = spark.createDataFrame([(h,) for h in ("X1", "c12", "Mar.mean", "m13", "Cross-Sectional_Curvature", "september", "7", "x")], "h string")
    return rows.select("h", scalars.month_to_int(F.col("h")).alias("m"))


@query("SELECT event_id, CASE WHEN value <= 15 THEN 10 WHEN value <= 25 THEN 20 WHEN value <= 40 THEN 30 ELSE 50 END::DOUBLE AS snapped FROM events")
def scalar_round_to_scale(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.round_to_scale(F.col("value"), [10, 20, 30, 50]).alias("snapped"))


# -- projections, streams and sinks -------------------------------------------------------------------------------

ALBERS = projection.Albers()
LONLAT = f"(SELECT id, -96 + x * 100 AS lon, 37.5 + y * 40 AS lat FROM {PTS})"


def _lonlat(spark, sf_dir):
    return pts(spark, sf_dir).selectExpr("id", "-96 + x * 100 lon", "37.5 + y * 40 lat")


def _albers_sql():
    a, e = ALBERS, ALBERS.e
    q = f"{1 - e * e!r} * (sin(radians(lat)) / (1 - {e * e!r} * sin(radians(lat)) ** 2) - ln((1 - {e!r} * sin(radians(lat))) / (1 + {e!r} * sin(radians(lat)))) / {2 * e!r})"
    rho, theta = f"{a.a!r} * sqrt({a.c!r} - {a.n!r} * ({q})) / {a.n!r}", f"{a.n!r} * radians(lon - {a.lon0!r})"
    return f"SELECT id, round(({rho}) * sin({theta}), 3) AS x, round({a.rho0!r} - ({rho}) * cos({theta}), 3) AS y FROM {LONLAT}"


@query(_albers_sql())
def albers_forward(spark, sf_dir):
    x, y = ALBERS.forward(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {LONLAT}")
def albers_round_trip(spark, sf_dir):
    x, y = ALBERS.forward(F.col("lon"), F.col("lat"))
    lon, lat = ALBERS.inverse(F.col("px"), F.col("py"))
    return _lonlat(spark, sf_dir).select("id", x.alias("px"), y.alias("py")).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_daily_mean(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = windows.file_stream(spark, path, table(spark, sf_dir, "events").schema)
    means = windows.window_means(stream, "ts", ["event_type"], "value")
    return r6(windows.run_to_end(means, ["event_type", "start"]), "mean")


@query(f"SELECT id, printf('%.9f', x) || ',' || printf('%.9f', y) || ',' || printf('%.9f', z) AS line FROM {PTS}")
def fixed_precision_lines(spark, sf_dir):
    return pts(spark, sf_dir).select("id", F.concat_ws(",", *(sinks.fixed(F.col(c), 9) for c in ("x", "y", "z"))).alias("line"))



import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import scalars
from geoloom.operators import grid, knn, local_polynomial, points, prep, region


def test_header_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, `Mar.mean` double")
    assert points.monthify(df).columns == ["x", "y", "3"]
    assert points.normalise_headers(df).columns == ["x", "y", "Marmean"]
    assert [points.month_of(h) for h in ("X1", "c12", "m13", "SEPx", "Slope")] == [1, 12, 0, 9, 0]


def test_booleans_and_levels(spark):
    row = spark.createDataFrame([(" Yes ", "6.2.10")], "b string, r string").select(scalars.str_to_bool(F.col("b")), scalars.region_level(F.col("r")), scalars.parent_region(F.col("r"))).first()
    assert tuple(row) == (True, 3, "6.2")


def test_mosaic_of_tiles_is_the_raster(spark):
    cells = spark.range(7 * 5).selectExpr("cast(id div 5 as int) row", "cast(id % 5 as int) col", "id * 1.5D z")
    out = grid.mosaic(grid.tiles(cells, 7, 5, 3, 1), "z")
    assert out.exceptAll(cells).isEmpty() and out.count() == 35
    assert grid.coarsen(cells, 0.5, "z").count() == 35


def test_neighbours_break_ties_by_id_and_take_all(spark):
    train = spark.createDataFrame([(3, 0.0, 1.0), (1, 2.0, 2.0), (2, 0.0, 4.0)], "tid long, x double, z double")
    ev = spark.createDataFrame([(9, 1.0), (8, 0.0)], "eid long, x double")
    near = knn.join(ev, train, 2, ["x"]).orderBy("eid", "rank").select("eid", "tid").collect()
    assert [tuple(r) for r in near] == [(8, 2), (8, 3), (9, 1), (9, 2)]
    assert knn.mean(knn.join(ev, train, 99, ["x"])).where(F.abs(F.col("sm") - 7 / 3) < 1e-12).count() == 2
    assert dict(knn.weighted(knn.join(ev, train, 3, ["x"])).collect())[8] == 2.5


def test_neighbours_by_blocks_agree(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, *map(float, r.random(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "tid long, x double, y double, z double")
    ev = df.where("tid % 5 = 0").withColumnRenamed("tid", "eid")
    one = knn.join(ev, df.where("tid % 5 != 0"), 4, ["x", "y"]).select("eid", "rank", "tid")
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 50)
    two = knn.join(ev, df.where("tid % 5 != 0"), 4, ["x", "y"]).select("eid", "rank", "tid")
    assert one.exceptAll(two).isEmpty() and one.count() == two.count() == 160


def test_local_polynomial_finds_a_plane(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(0.3 + 0.2 * a - 0.1 * b)) for i, (a, b) in enumerate(r.random((60, 2)))]
    df = spark.createDataFrame(rows, "tid long, x double, y double, z double")
    out = local_polynomial.predict(df.where("tid < 10").withColumnRenamed("tid", "eid"), df.where("tid >= 10"), ["x", "y"], k=8, degree=1).join(df, F.col("eid") == F.col("tid"))
    assert out.agg(F.max(F.abs(F.col("sm") - F.col("z")))).first()[0] < 1e-9
    assert {x.degree for x in out.collect()} == {1}


def test_hold_out_counts(spark):
    df = spark.range(101).selectExpr("id", "id % 2 g")
    out = prep.hold_out(df, "id", 0.3, 1)
    assert out.where("held_out").count() == 30 and out.count() == 101
    by = {r.g: r.n for r in prep.hold_out(df, "id", 0.5, 1, ["g"]).where("held_out").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert by == {0: 26, 1: 25}


def test_joint_components_are_uncorrelated(spark):
    r = np.random.default_rng(2)
    rows = [(float(a), float(a + 0.1 * b), float(b)) for a, b in r.normal(size=(100, 2))]
    df = spark.createDataFrame(rows, "p double, q double, s double")
    out, _ = prep.joint_pca(df, df, ["p", "q", "s"])
    x = np.array([tuple(t) for t in out.collect()])
    assert x.shape[1] >= 1 and np.allclose(x.mean(0), 0, atol=1e-9)


def test_polygon_with_buffer(spark):
    poly = spark.createDataFrame([("a", "0_1_0_1")], "region string, label string").select("region", region.box_ring(F.col("label")).alias("ring"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.005, 0.5), (3, 2.0, 2.0)], "id long, x double, y double")
    assert [r.id for r in region.in_regions(pts, poly).collect()] == [1]
    assert sorted(r.id for r in region.in_regions(pts, poly, buffer_m=1000).collect()) == [1, 2]
    with pytest.raises(ValueError):
        region.boxes(spark, 10, 0, 0, 1, 2, 2)

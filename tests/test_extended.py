"""Files, flow, models and neighbour search against brute force on small tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import forest, grid, knn, local_polynomial, models, points, prep, stats, terrain
from geoloom.sources import files, geotiff, netcdf, sinks
from geoloom.storage import discard, new_path, shared_dir, stored

PLANE = [(i, float(a), float(b), float(0.3 + 0.2 * a - 0.1 * b + 0.2 * a * b + 0.01 * e)) for i, (a, b, e) in enumerate(np.random.default_rng(0).random((60, 3)))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(PLANE, "tid long, x double, y double, z double")


def halves(rows):
    return rows.where("tid < 10").withColumnRenamed("tid", "eid"), rows.where("tid >= 10")


def test_stored_tables_can_be_discarded(spark):
    df = stored(spark.range(3), "three")
    assert df.count() == 3 and shared_dir(spark) in df.stored_at
    discard(df)
    assert files.names(spark, df.stored_at) == []


@pytest.mark.parametrize("compression", [geotiff.NONE, geotiff.LZW, geotiff.DEFLATE])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind", ["f8", "f4", "i2", "u1"])
def test_geotiff_keeps_everything(compression, big, kind):
    g = grid.Grid(-100.0, 0.5, 40.0, 0.25, 70, 90)
    bands = (np.random.default_rng(1).random((2, 70, 90)) * 9).astype(kind)
    image = geotiff.GeoTiff(geotiff.encode(bands, g, ["dem", "slope"], -9999.0, 4326, compression, 32, big))
    back = np.zeros_like(bands)
    for top, part in image.rows():
        back[:, top : top + part.shape[1]] = part
    assert (back == bands).all() and image.grid == g
    assert (image.names, image.nodata, image.epsg) == (["dem", "slope"], -9999.0, 4326)


def test_lzw_tables_fill_up():
    r = np.random.default_rng(2)
    for n in (0, 1, 7000, 60000):
        raw = r.integers(0, 256, n).astype(np.uint8).tobytes()
        assert geotiff._lzw(geotiff._to_lzw(raw), n) == raw


def test_strips_and_predictor():
    """A file made by hand: big-endian, two strips, planes together, horizontal differences."""
    import struct

    image = np.array([[[1, 10], [3, 20], [6, 30]], [[2, 5], [2, 6], [9, 7]]], ">u2")
    flat = image.copy()
    flat[:, 1:] -= image[:, :-1]
    tags = [(256, 3, 3), (257, 3, 2), (259, 3, 1), (277, 3, 2), (278, 3, 1), (284, 3, 1), (317, 3, 2), (339, 3, 1)]
    data = flat.tobytes()
    at = 8 + 2 + 12 * (len(tags) + 3) + 4
    tags = sorted([*((t, k, 1, struct.pack(">HH", v, 0)) for t, k, v in tags), (258, 3, 2, struct.pack(">HH", 16, 16)), (273, 4, 2, struct.pack(">I", at + len(data))), (279, 3, 2, struct.pack(">HH", 12, 12))])
    raw = b"MM" + struct.pack(">HI", 42, 8) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in tags) + b"\0" * 4
    raw += data + struct.pack(">II", at, at + 12)
    found = np.concatenate([part for _, part in geotiff.GeoTiff(raw).rows()], 1)
    assert (found == image.transpose(2, 0, 1)).all()


def test_rasters_as_files(spark):
    g = grid.Grid(0.0, 1.0, 30.0, 1.0, 30, 20)
    cells = spark.range(600).selectExpr("cast(id div 20 as int) row", "cast(id % 20 as int) col", "id * 0.5D z").where("(row + col) % 5 != 0")
    path = new_path(spark, "tiles")
    assert geotiff.save(geotiff.tiles(cells, g, ["z"], 8, epsg=5070, compression=geotiff.DEFLATE), path) == 12
    back = geotiff.cells(spark, path).where("z is not null").select(F.floor(30 - F.col("y")).cast("int").alias("row"), F.floor("x").cast("int").alias("col"), "z")
    assert back.exceptAll(cells).isEmpty() and back.count() == cells.count()
    heads = geotiff.headers(spark, path).collect()
    assert {h.epsg for h in heads} == {5070} and sum(h.nrow * h.ncol for h in heads) == 600 and {tuple(h.names) for h in heads} == {("z",)}
    assert files.latest(spark, path).endswith("tile_0003_0002.tif") and len(files.names(spark, f"{path}/*.tif", "_0001.")) == 4
    path = new_path(spark, "nc")
    sinks.write_raster(cells, g, ["z"], path, "NC")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/raster.nc"), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/d_20010203.nc"))
    got = files.read(spark, "netcdf", path, variable="z").where("value is not null")
    assert got.count() == cells.count() and got.agg(F.sum("value")).first()[0] == cells.agg(F.sum("z")).first()[0]
    assert str(got.first().date) == "2001-02-03"
    with pytest.raises(ValueError):
        files.read(spark, "points", "x{year}.csv", 1900)


def test_netcdf_scale_and_fill():
    raw = netcdf.encode({"lat": (["lat"], np.array([1.0, 2.0]), {}), "sm": (["time", "lat"], np.array([[3, 7]], "i2"), {"_FillValue": 7.0, "scale_factor": 0.5, "units": "m"})}, {"time": 1, "lat": 2})
    found = netcdf.NetCdf(raw)
    assert found.shape("sm") == [1, 2] and found.plane("sm", 0).tolist() == [3, 7] and found.variables["sm"]["attributes"]["units"] == "m"


def test_slope_beside_a_missing_cell(spark):
    cells = spark.createDataFrame([(r, c, 10.0 * c + r) for r in range(5) for c in range(5) if (r, c) != (2, 3)], "row int, col int, z double")
    got = {(r.row, r.col): r.slope for r in terrain.slope(cells, "z").collect()}
    whole = np.degrees(np.arctan(np.hypot(10, 1)))
    assert got[2, 2] is None and got[1, 2] is None and got[3, 3] is None and abs(got[2, 1] - whole) < 1e-9
    assert len(got) == 24 and got[0, 0] is None


def test_flow_runs_down_a_valley(spark):
    cells = spark.createDataFrame([(r, c, float(abs(c - 3) * 10 + (40 - r))) for r in range(40) for c in range(7)], "row int, col int, z double")
    got = {(r.row, r.col): r.cells for r in terrain.flow_accumulation(cells, "z").collect()}
    assert got[39, 3] == 280 and got[0, 0] == 1 and got[0, 3] == 7
    index = {(r.row, r.col): r.convergence for r in terrain.convergence(cells, "z").collect()}
    assert index[20, 3] < -20 and index[0, 0] is None


def brute(points_, ids, z, q, k):
    gap = np.zeros(len(ids))
    for c in range(points_.shape[1]):
        gap += (q[c] - points_[:, c]) ** 2
    return [(int(ids[i]), float(z[i])) for i in np.lexsort((ids, gap))[:k]]


def test_blocks_find_the_nearest(monkeypatch):
    monkeypatch.setattr(knn, "LEAF_ROWS", 16)
    r = np.random.default_rng(3)
    for trial in range(20):
        n, d, k = r.integers(1, 300), r.integers(1, 4), int(r.integers(1, 9))
        train, ask = np.round(r.random((n, d)), 2 if trial % 2 else 6), np.round(r.random((20, d)), 2)
        z, ids = r.random(n), r.permutation(n)
        row, rank, tid, _, found = knn.Blocks(train, ids, z).search(ask, k)
        for i in range(20):
            assert list(zip(tid[row == i].tolist(), found[row == i].tolist())) == brute(train, ids, z, ask[i], k)


def test_neighbours_need_whole_coordinates(spark):
    train = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 2.0), (3, float("nan"), 3.0)], "tid long, x double, z double")
    ev = spark.createDataFrame([(7, 1.0), (8, None)], "eid long, x double")
    assert [tuple(r)[:3] for r in knn.join(ev, train, 5, ["x"]).collect()] == [(7, 1, 1)]
    assert knn.join(ev, train.where("tid > 1"), 5, ["x"]).count() == 0


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(4)
    values = np.concatenate([r.normal(size=500) * 1e6, np.zeros(700), r.random(300)])
    df = spark.createDataFrame([(float(v), None) for v in values] + [(float("nan"), None)], "v double, w double")
    got = stats.quantiles(df, ["v", "w"], [0.0, 0.1, 0.5, 0.77, 1.0])
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        assert abs(got["v", q] - np.quantile(values, q)) <= 1e-9 * max(1, abs(np.quantile(values, q))) and got["w", q] is None


def test_global_polynomial_from_sums(rows):
    ev, tr = halves(rows)
    few, many = (local_polynomial.predict_global(ev, tr, ["x", "y"], degree=3, few=n).orderBy("eid").collect() for n in (99, 0))
    assert all(a.degree == b.degree and abs(a.sm - b.sm) < 1e-9 for a, b in zip(few, many)) and len(many) == 10


def test_local_polynomial_is_brute_force(rows):
    ev, tr = halves(rows)
    train = np.array([t[1:] for t in PLANE[10:]])
    got = {r.eid: (r.sm, r.degree) for r in local_polynomial.predict(ev, tr, ["x", "y"], k=9, degree=2).collect()}
    for i, x, y, _ in PLANE[:10]:
        near = np.sort(np.argsort(((train[:, :2] - [x, y]) ** 2).sum(1), kind="stable")[:9])
        p, z = train[near, :2], train[near, 2]
        shift, scale = p.mean(0), p.std(0)
        p, ask = (p - shift) / scale, (np.array([[x, y]]) - shift) / scale
        errors = []
        for d in range(3):
            total = 0.0
            for k in range(9):
                o = np.arange(9) != k
                w = np.linalg.lstsq(local_polynomial.design(p[o], d), z[o], rcond=None)[0]
                total += min((float(local_polynomial.design(p[k : k + 1], d)[0] @ w) - z[k]) ** 2, 9999)
            errors.append(total)
        d = int(np.argmin(errors))
        w = np.linalg.lstsq(local_polynomial.design(p, d), z, rcond=None)[0]
        assert got[i][1] == d and abs(got[i][0] - np.clip(local_polynomial.design(ask, d)[0] @ w, 0, 1)) < 1e-6


def test_neighbourhoods_are_fitted_together_as_alone():
    r = np.random.default_rng(6)
    x, z = r.random((40, 9, 3)), r.random((40, 9))
    x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    degrees, fits = local_polynomial.fit_together(x, z, 3)
    for h in range(40):
        chosen, tried, _ = local_polynomial.choose_degree(x[h], z[h], 3)
        assert chosen == degrees[h] and np.allclose(local_polynomial.solve(x[h], z[h], chosen, tried), fits[h], atol=1e-6)
    assert len(set(degrees.tolist())) > 2 and local_polynomial.fit_together(x[:, :1], z[:, :1], 2)[0].tolist() == [0] * 40


def test_lasso_of_many_neighbourhoods_together():
    """Together as one by one, in a small part of the time."""
    rng, terms = np.random.default_rng(4), local_polynomial.Terms("lasso")
    x, z = rng.normal(size=(120, 8, 3)), rng.integers(0, 10, (120, 8)) / 10
    x[0], x[1, :, 2], z[2] = 0.0, x[1, :, 1], 0.3
    for folds in (None, 3):
        began = time.perf_counter()
        got = local_polynomial.choose_together(x, z, 2, folds, terms)
        mid = time.perf_counter()
        for (degree, model, errors), p, v in zip(got, x, z):
            chosen, fits, summed = local_polynomial.choose_degree(p, v, 2, folds, terms)
            assert chosen == degree and np.allclose(errors, summed, rtol=1e-9, atol=1e-9)
            assert np.allclose(model, local_polynomial.solve(p, v, chosen, fits, terms), rtol=1e-6, atol=1e-9)
        assert mid - began < (time.perf_counter() - mid) / 2


def test_few_neighbourhoods_are_fitted_in_many_tasks(spark):
    rows = spark.range(60).selectExpr("id tid", "id eid", "cast(id * id % 17 as double) x", "cast(id % 7 as double) y", "id % 10 / 10D z")
    out = local_polynomial.predict(rows, rows, ["x", "y"], k=6, degree=2, terms=local_polynomial.Terms("lasso"), details=True)
    where = out.withColumn("task", F.spark_partition_id()).collect()
    assert len(where) == 60 and len({r.task for r in where}) > 1


def test_terms_of_the_lasso():
    r = np.random.default_rng(5)
    a = np.column_stack([np.ones(40), r.normal(size=(40, 8))])
    z = 3 + 4 * a[:, 2] - 2 * a[:, 5] + 0.01 * r.normal(size=40)
    assert local_polynomial.lasso_terms(a, z, 2).tolist() == [2, 5]
    assert local_polynomial.degree_counts(np.array([1, 0, 2, 3, 0, 0]), 2, 2) == [1, 1, 1]
    w = local_polynomial.lasso(a[:, 1:] - a[:, 1:].mean(0), z - z.mean(), 0.5)
    left = (a[:, 1:] - a[:, 1:].mean(0)).T @ (z - z.mean() - (a[:, 1:] - a[:, 1:].mean(0)) @ w) / 40
    assert (abs(left) <= 0.5 + 1e-3).all() and np.allclose(left[w != 0], 0.5 * np.sign(w[w != 0]), atol=1e-3)


def test_principal_axes_are_those_of_numpy(rows):
    x = np.array([t[1:3] for t in PLANE])
    values, axes, _ = prep.principal_axes(rows, ["x", "y"])
    want, vectors = np.linalg.eigh(np.cov(((x - x.mean(0)) / x.std(0)).T))
    assert np.allclose(values, [v for v in want[::-1] if v >= 1]) and np.allclose(abs(axes[:, 0]), abs(vectors[:, -1]))


def test_models_are_run_stored_and_validated(spark, rows):
    ev, tr = halves(rows)
    for name, how in {"1NN": {}, "KNN": {"k": 3}, "KKNN": {"max_k": 5, "folds": 3}, "RF": {"trees": 5, "depth": 4}, "HYPPO": {"k": 8, "degree": 1}, "SBM": {"degree": 2}}.items():
        found, metrics = models.validated(name, tr, ev, ["x", "y"], validate=1.3, **how)
        assert found.count() == 10 and metrics.first().n == 15 and metrics.first().rmse < 0.2
    assert models.validated("1NN", tr, ev, ["x", "y"], validate=1)[1].first().rmse == 0
    assert models.validated("1NN", tr, ev, ["x", "y"])[1] is None
    with pytest.raises(ValueError):
        models.run("none", tr, ev, ["x", "y"])
    for name, how in {"RF": {"trees": 5, "depth": 4}, "KNN": {"k": 3}}.items():
        path = new_path(spark, "model")
        models.store(name, tr, ["x", "y"], path, **how)
        out = models.apply(spark, path, ev.withColumn("tile", F.lit("a")))
        assert out.columns == [*ev.columns, "tile", "sm"] and out.where("sm is null").count() == 0
    found, best = models.forest_search(tr, ev, ["x", "y"], trees=(3, 5), depths=(3,), tries=2, folds=2)
    assert found.count() == 10 and best["trees"] in (3, 5)


def test_forest_scores_add_up(rows):
    noise = rows.withColumn("n", F.lit(0.5))
    got = {r.feature: r.score for r in forest.forest_scores(noise, ["x", "y", "n"], trees=10).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["n"] == 0 and got["x"] > 0


def test_places_and_layers(spark):
    df = spark.range(50).selectExpr("id", "id % 7 k")
    assert [r.id for r in points.rows_between(df, ["id"], 3, 6).orderBy("id").collect()] == [3, 4, 5]
    both = points.side_by_side(df.select("id"), df.selectExpr("-id o").limit(20), ["id"], ["o"])
    assert both.count() == 50 and both.where("o is null").count() == 30
    assert points.layer_names(points.name_layers(df, ["a"], 1), 1) == ["a"] and points.layer_count(df) == 2
    assert points.model_columns(df.withColumn("z", F.lit(1)), 2, (0,)) == ("z", ["k"])
    with pytest.raises(ValueError):
        points.model_columns(df.withColumn("z", F.lit(1)), 2, variables=["q"])


def test_sinks(spark):
    base = new_path(spark, "sinks")
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 7)], "x double, y double, delta double, tile int")
    sinks.write_residuals(df, f"{base}/r")
    assert spark.read.text(f"{base}/r").first()[0] == "1.000000000,2.000000000,0.500000000"
    shapes = spark.createDataFrame([("f", 1, 0, k, float(k), -float(k)) for k in range(5)], "file string, record int, part int, place int, px double, py double")
    sinks.write_vertices(shapes, f"{base}/v", 1)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{base}/v").collect()][:2] == [("0.0", "-0.0"), ("1.0", "-1.0")]
    assert [r.place for r in points.preview(shapes, ["px"]).collect()] == [0, 1, 2]
    sinks.write_tiles(df, f"{base}/t", ["tile"])
    assert spark.read.option("header", True).csv(f"{base}/t").first().tile == 7
    sinks.write_manifest(spark, f"{base}/m", {"year": 2001}, spark.createDataFrame([("CEC", "6.2.10")], "reg_type string, region string"))
    assert sinks.read_manifest(spark, f"{base}/m") == {"parameters": {"year": 2001}, "regions": [{"reg_type": "CEC", "region": "6.2.10"}]}
    sinks.write_stats(stats.describe(df, ["x"], ["mean", "max"]), f"{base}/s")
    assert [r.value for r in spark.read.text(f"{base}/s/keys").collect()] == ["max,x", "mean,x"]

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import projection, stats
from geoloom.sources import binary, config, sinks, text
from geoloom.streaming import windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_point_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,NA\n 3,4 ,0.5\n")
    assert rows(text.points(spark, str(tmp_path / "a.csv")), "x") == [(1, 2, None), (3, 4, 0.5)]
    (tmp_path / "b.csv").write_text("1,2,0.5,7\n")
    assert rows(text.predictions(spark, str(tmp_path / "b.csv")), "x") == [(1, 2, 0.5)]
    (tmp_path / "c.txt").write_text("x,y\tz\n1,2\t3\n4\t5,NA\n6\n\n")
    assert rows(text.delimited(spark, str(tmp_path / "c.txt")), "x") == [(1, 2, 3), (4, 5, None), (6, None, None)]


def test_matrix_leaves_out_the_headers_of_every_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("1 1\n1 1\n" + "".join(f"{k} {i}\n" for i in range(4)))
    got = text.matrix(spark, str(tmp_path), 2, header_rows=2, separator=r"\s+")
    assert rows(got, "c0", "c1") == [(k, i) for k in range(3) for i in range(4)]


def test_regions(spark, tmp_path):
    (tmp_path / "r.csv").write_text("CEC.lvl1,STATE\nlevel one,a state\n10,Ohio\n,Iowa\n")
    assert rows(text.region_catalog(spark, str(tmp_path / "r.csv")), "region") == [("CEC", "10"), ("STATE", "Iowa"), ("STATE", "Ohio")]
    assert rows(text.region_list(spark, "[('CEC', '8.5.1'), ('STATE', 'Ohio')]\n"), "place") == [(0, "CEC", "8.5.1"), (1, "STATE", "Ohio")]
    with pytest.raises(ValueError):
        text.region_list(spark, "[('TOWN', 'x')]")


def test_grids(spark, tmp_path):
    z = np.array([[1, 2, 3], [4, -99, 6]], "<f4")  # the lower row first
    (tmp_path / "g.sdat").write_bytes(z.tobytes())
    (tmp_path / "g.sgrd").write_text("DATAFORMAT\t= FLOAT\nBYTEORDER_BIG\t= FALSE\nPOSITION_XMIN\t= 10\nPOSITION_YMIN\t= 20\nCELLCOUNT_X\t= 3\nCELLCOUNT_Y\t= 2\nCELLSIZE\t= 0.5\nNODATA_VALUE\t= -99\nTOPTOBOTTOM\t= FALSE\n")
    got = rows(binary.saga_grids(spark, str(tmp_path)).drop("file"), "row", "col")
    assert got == [(0, 0, 10, 20.5, 4), (0, 1, 10.5, 20.5, None), (0, 2, 11, 20.5, 6), (1, 0, 10, 20, 1), (1, 1, 10.5, 20, 2), (1, 2, 11, 20, 3)]


def test_shapefiles(spark, tmp_path):
    xy = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0), (5.0, 5.0), (6.0, 5.0), (5.0, 5.0)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 6, 5, 2, 7, 0, 4) + b"".join(struct.pack("<2d", *p) for p in xy)
    records = struct.pack(">2i", 1, len(body) // 2) + body + struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    shp = struct.pack(">i20xi", 9994, (100 + len(records)) // 2) + struct.pack("<2i64x", 1000, 5) + records
    field = b"NAME\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    dbf = struct.pack("<B3xIHH20x", 3, 2, 65, 6) + field + b"\r" + b" Ohio *gone "
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("s.shp", shp)
        z.writestr("s.dbf", dbf)
    got = rows(binary.shapes(spark, str(tmp_path)).drop("file"), "part", "place")
    assert got == [(1, k // 4, k % 4 if k < 4 else k - 4, *p) for k, p in enumerate(xy)]
    assert rows(binary.attributes(spark, str(tmp_path)).drop("file"), "record") == [(1, {"NAME": "Ohio"})]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (0.0, 3.0, None), (0.0, 2.0, float("nan"))], "x double, y double, z double").coalesce(1)
    sinks.write_xyz(df, str(tmp_path / "xyz"), 2)
    lines = [line for f in sorted((tmp_path / "xyz").glob("part*")) for line in f.read_text().splitlines() if line[0] != "x"]
    assert lines == ["0.00,3.00,NA", "0.00,2.00,NA", "1.00,2.00,0.50"]
    sinks.write_csv(df, str(tmp_path / "plain"), header=False, missing="NA")
    assert sorted(next((tmp_path / "plain").glob("part*")).read_text().split()) == ["0.0,2.0,NA", "0.0,3.0,NA", "1.0,2.0,0.5"]
    sinks.write_predictions(df.where("x = 1"), str(tmp_path / "p"), 3)
    assert rows(text.predictions(spark, str(tmp_path / "p")), "x") == [(1, 2, 0.5)]
    for _ in range(2):
        sinks.append_metrics(spark.createDataFrame([(0.25, "a/b")], "value double, path string"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["0.25,a/b"] * 2


def test_fixed_prints_ties_and_long_numbers_as_sql_does(spark):
    import duckdb

    numbers = [k / 1024 for k in range(-15, 16, 2)] + [1.5e-9, 0.9999999995, -0.0, 1e9 / 7, 1e15 / 7]
    got = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", sinks.fixed(F.col("v"), 9).alias("text")).collect()
    assert {r.v: r.text for r in got} == {v: duckdb.execute("SELECT printf('%.9f', ?::DOUBLE)", [v]).fetchone()[0] for v in numbers}
    both = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(sinks.fixed(F.col("v"), 1, "-"))
    assert [r[0] for r in both.collect()] == ["-", "-"]


def test_config(spark):
    settings = {"Job": {"YEAR": 2010, "regions": [("CEC", "8.5.1")], "name": "first try"}}
    assert config.read_config(config.write_config(settings)) == settings
    assert config.parameter_grid(spark, {"knn": {"k": [1, 2], "w": ["a"]}, "rf": {}}).count() == 3
    with pytest.raises(ValueError):
        config.valid_year(1978)


def test_projection_agrees_with_the_manual(spark):
    clarke = projection.Albers(a=6378206.4, e2=0.00676866)
    x, y = clarke.forward(F.lit(-75.0), F.lit(35.0))
    got = spark.range(1).select(x, y, *projection.azimuthal_equidistant(F.lit(10.0), F.lit(0.0), 0.0, 0.0, 1.0)).first()
    assert abs(got[0] - 1885472.7) < 0.1 and abs(got[1] - 1535925.0) < 0.1
    assert abs(got[2] - np.radians(10)) < 1e-12 and abs(got[3]) < 1e-12


def test_variogram_model_is_found_again(spark):
    gap = (np.arange(20) + 0.5) * 0.1
    gamma = 0.2 + 0.7 * np.where(gap < 1.2, 1.5 * gap / 1.2 - 0.5 * (gap / 1.2) ** 3, 1)
    fit = stats.fit_variogram(spark.createDataFrame([(i, 10, float(g)) for i, g in enumerate(gamma)], "bin long, n long, gamma double"), 0.1)
    assert abs(fit["nugget"] - 0.2) < 0.02 and abs(fit["sill"] - 0.7) < 0.02 and abs(fit["range"] - 1.2) < 0.03


@pytest.mark.parametrize("kind", ["falling", "rising", "one bin", "no pairs"])
def test_variogram_model_is_that_of_its_sql(spark, tmp_path, kind):
    import duckdb

    from geoloom.plans.extended import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.1, (200, 2)) if kind in ("falling", "rising") else np.array([[0.0, 0.0], [0.01, 0.0]] if kind == "one bin" else [[0.0, 0.0]])
    label = np.arange(len(x)) % 10 if kind != "rising" else np.digitize(x[:, 0], [-0.1, 0, 0.1])
    if kind == "falling":  # close pairs differ most
        x = np.repeat(x[::2], 2, 0) + np.tile([[0.0, 0.0], [0.01, 0.0]], (100, 1))
        label = np.arange(200) % 2 * 9
    table = [(i, [float(a), float(b), 0.0, 0.0, 0.0], int(c)) for i, ((a, b), c) in enumerate(zip(x, label))]
    spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["variogram_fit"]).fetchall()
    assert [tuple(r) for r in QUERIES["variogram_fit"](spark, str(tmp_path)).collect()] == want and len(want) == (kind in ("falling", "rising"))


def test_variogram_in_runs_equals_all_pairs(spark, monkeypatch):
    """Broadcast in runs as by squares, with equal points, missing values and distances at the edges; far fewer are compared."""
    rng = np.random.default_rng(1)
    table = [(float(a), float(b), None if i % 9 == 0 else i % 10 / 10) for i, (a, b) in enumerate([*rng.normal(0, 0.1, (900, 2)), *[(0.25, 0.0)] * 200, *[(0.05 * k, 0.0) for k in range(-5, 6)]])]
    df = spark.createDataFrame([*table, (None, 0.0, 1.0)], "x double, y double, z double")
    got = rows(stats.variogram(df, "x", "y", "z", 0.05, 4), "bin")
    monkeypatch.setattr(stats.knn, "BROADCAST_BYTES", 0)
    want = rows(stats.variogram(df, "x", "y", "z", 0.05, 4), "bin")
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-11)
    at = rng.random((8192, 2))
    counted, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda v, *a, **b: counted.append(v.size) or count(v, *a, **b))
    many = stats.Runs(at, at[:, 0], np.ones(len(at), bool))
    for g in range(many.groups):
        many.sums(g, 0.3, 4)
    assert sum(counted) < 8192**2 / 2


def test_variogram_ranges_round_as_in_sql(spark):
    import duckdb

    from geoloom.plans.extended import _rounded

    for b in range(6):
        want = duckdb.sql(f"SELECT round(2 * gap * (i + 1) / 200, 4) FROM (SELECT ({b}::BIGINT + 0.5) * 0.05 AS gap), range(200) t(i) ORDER BY i").fetchall()
        reaches = stats._reaches([b], 0.05, 200)[1]
        assert spark.createDataFrame([(r,) for r in reaches], "r double").coalesce(1).select(_rounded("r", 4)).collect() == want


def test_stream_equals_the_stored_table(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 3 k", "timestamp'2020-01-01' + make_interval(0,0,0,0,id) ts", "cast(id % 7 as double) v")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = windows.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=2)
    means = windows.window_means(stream, "ts", ["k"], "v", lateness="1000 days")
    got = windows.run_to_end(means, ["k", "start"], windows.new_folder(spark, "t"))
    want = windows.window_means(df, "ts", ["k"], "v")
    assert rows(got, "k", "start") == rows(want, "k", "start")

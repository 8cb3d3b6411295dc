"""From configurations to tracked features, on files and synthetic sources; published counts of curves."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmesh import __main__ as cli
from driftmesh.operators import curves as C
from driftmesh.operators import features as X
from driftmesh.operators import graph as G
from driftmesh.operators import unstructured as U
from driftmesh.sources import files, formats, sinks
from driftmesh.sources import synthetic as S
from driftmesh.sources.config import SourceConfig, load
from driftmesh.tracker import track, track_critical_points_2d_scalar


def n_curves(df):
    return df.select(*[c for c in ("id", "sub") if c in df.columns]).distinct().count()


@pytest.mark.parametrize(
    "name, steps, dims, post, want",
    [("merger_2d", 100, (32, 32), True, 9), ("double_gyre", 50, (64, 32), True, 2), ("moving_extremum_2d", 32, (21, 21), True, 1), ("moving_extremum_3d", 10, (21, 21, 21), True, 1)],
)
def test_published_counts(spark, name, steps, dims, post, want):
    found = track(spark, {"feature": "cp", "input": {"name": name, "n_timesteps": steps, "dimensions": dims}})
    assert n_curves(C.post_process(found.traced, compat=True)) == want


def test_woven_in_one_call_has_30_curves(spark):
    assert n_curves(track_critical_points_2d_scalar(spark, S.woven_grid(spark, 10, 10, 20, offset=1e-4))) == 30
    one = track_critical_points_2d_scalar(spark, S.moving_extremum(spark, (11, 13), 20, (5.0, 5.0), (0.1, 0.2)))
    assert n_curves(one) == 1
    off = one.withColumn("d", F.abs(F.col("x") - 5 - 0.1 * F.col("t")) + F.abs(F.col("y") - 5 - 0.2 * F.col("t"))).agg(F.max("d")).first()[0]
    assert off < 1e-6


def test_array_files(spark, tmp_path):
    field = S.moving_extremum(spark, (12, 9), 3, (5.3, 4.2))
    want = sorted(map(tuple, field.select("t", "j", "i", "f").collect()))
    for form, config in (
        ("vti", {"filenames": f"{tmp_path}/a-*.vti"}), ("nc", {"filenames": f"{tmp_path}/a-*.nc", "variables": ["f"], "dimensions": [12, 9]}),
        ("float64", {"filenames": f"{tmp_path}/a-*.float64", "format": "float64", "dimensions": [12, 9]}),
    ):
        sinks.write_arrays(field, f"{tmp_path}/a-%02d.{form}", form, (12, 9))
        df, c = load(spark, config)
        assert c.dimensions == (12, 9) and c.n_timesteps == 3 and c.type == "file"
        assert sorted(map(tuple, df.select("t", "j", "i", "f").collect())) == want
        assert SourceConfig.of(c.to_json()) == c
    found = track(spark, {"feature": "critical_point", "input": {"filenames": f"{tmp_path}/a-*.vti"}})
    assert found.discrete.count() > 0


def test_source_errors(spark):
    for bad in ({"name": "nothing"}, {}, {"filenames": "/nowhere/*.vti"}):
        with pytest.raises(Exception):
            load(spark, bad)
    with pytest.raises(ValueError):
        SourceConfig.of({"nmae": "woven"})
    with pytest.raises(ValueError):
        track(spark, {"feature": "unheard"})


def test_snapshots_are_transformed(spark):
    plain = S.woven_grid(spark, 10, 10, 6)
    got, _ = load(spark, {"name": "woven", "dimensions": [10, 10], "n_timesteps": 6, "clamp": [-0.25, 0.25]})
    assert got.join(plain.withColumnRenamed("f", "g"), ["t", "j", "i"]).where(F.abs(F.col("f") - F.greatest(F.least("g", F.lit(0.25)), F.lit(-0.25))) > 1e-12).isEmpty()
    rough, _ = load(spark, {"name": "woven", "dimensions": [10, 10], "n_timesteps": 6, "perturbation": 0.5})
    smooth, _ = load(spark, {"name": "woven", "dimensions": [10, 10], "n_timesteps": 6, "perturbation": 0.5, "temporal_smoothing_kernel": 1.5})
    spread = [x.agg(F.stddev("f")).first()[0] for x in (rough, smooth)]
    assert spread[1] < spread[0]


def test_vtk_files_in_all_codings():
    x = np.linspace(0, 1, 60).reshape(3, 4, 5)
    assert all((formats.parse_vti(formats.write_vti({"g": x, "f": -x}, z), "f") == -x).all() for z in (True, False))
    points, cells = np.random.default_rng(1).normal(size=(9, 3)), np.array([[0, 1, 2], [2, 5, 8]])
    for z in (True, False):
        p, c, data = formats.parse_vtu(formats.write_vtu(points, cells, {"f": points[:, 0], "v": points}, z))
        assert (p == points).all() and (c == cells).all() and (data["v"] == points).all() and (data["f"] == points[:, 0]).all()
    raw = points.astype("<f4").tobytes()
    head = b'<VTKFile type="UnstructuredGrid" byte_order="LittleEndian" header_type="UInt64"><UnstructuredGrid><Piece><Points><DataArray type="Float32" NumberOfComponents="3" format="appended" offset="0"/></Points><Cells>'
    cells_ = b'<DataArray type="Int64" Name="connectivity" format="ascii">2 1 0 8 5 2</DataArray><DataArray type="Int64" Name="offsets" format="ascii">3 6</DataArray><DataArray type="UInt8" Name="types" format="ascii">5 5</DataArray>'
    tail = b'</Cells></Piece></UnstructuredGrid><AppendedData encoding="raw">_' + len(raw).to_bytes(8, "little") + raw + b"</AppendedData></VTKFile>"
    p, c, _ = formats.parse_vtu(head + cells_ + tail)
    assert np.allclose(p, points, atol=1e-6) and (c == cells).all()


def test_netcdf_records(spark, tmp_path):
    x = np.arange(24, dtype=float).reshape(4, 6)
    for k in range(3):
        (tmp_path / f"r{k}.nc").write_bytes(formats.write_netcdf({"f": x + k, "g": x - k}, ("y", "x"), record=True))
    df, c = load(spark, {"filenames": f"{tmp_path}/r*.nc", "variables": ["g", "f"], "dimensions": [6, 4]})
    assert c.n_timesteps == 3 and df.columns == ["t", "j", "i", "u", "v"]
    assert sorted(map(tuple, df.collect())) == sorted((k, j, i, x[j, i] - k, x[j, i] + k) for k in range(3) for j in range(4) for i in range(6))
    with pytest.raises(ValueError):
        formats.NetCdf(b"\x89HDF")


def test_amira_and_png(spark, tmp_path):
    import struct
    import zlib

    x = np.arange(2 * 3 * 4 * 2, dtype="<f4").reshape(2, 3, 4, 2)
    head = b'# AmiraMesh BINARY-LITTLE-ENDIAN 2.1\ndefine Lattice 4 3 2\nParameters {\n BoundingBox 0 1 0 1 0 1,\n CoordType "uniform"\n}\nLattice { float[2] Data } @1\n\n# Data section follows\n@1\n'
    (tmp_path / "a.am").write_bytes(head + x.tobytes())
    df, c = load(spark, {"filenames": f"{tmp_path}/a.am"})
    assert c.dimensions == (4, 3) and c.n_timesteps == 2
    assert sorted(map(tuple, df.collect())) == sorted((t, j, i, *map(float, x[t, j, i])) for t in range(2) for j in range(3) for i in range(4))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = np.random.default_rng(2).integers(0, 256, (5, 7)).astype(int)
    rows = b""
    for y, f in enumerate((0, 1, 2, 3, 4)):
        line = []
        for i in range(7):
            left, up = (pixels[y, i - 1] if i else 0), (pixels[y - 1, i] if y else 0)
            corner = pixels[y - 1, i - 1] if i and y else 0
            p = left + up - corner
            guess = (0, left, up, (left + up) // 2, min((left, up, corner), key=lambda v: abs(p - v)))[f]
            line.append((pixels[y, i] - guess) % 256)
        rows += bytes([f, *line])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "p-004.png").write_bytes(png)
    got = files.read_png(spark, f"{tmp_path}/p-004.png").collect()
    assert sorted(map(tuple, got)) == sorted((4, j, i, float(pixels[j, i])) for j in range(5) for i in range(7))


def test_command_line_and_outputs(spark, tmp_path, capsys):
    base = ["-f", "cp", "--synthetic", "moving_extremum_2d", "-n", "6"]
    got = cli.main([*base, "-o", f"{tmp_path}/curves.vtp", "--archived-intersections", f"{tmp_path}/hits", "--archived-traced", f"{tmp_path}/traced", "--timing"])
    assert got["curves"] == 1 and json.loads(capsys.readouterr().out.splitlines()[-1]) == got
    f = formats.VtkFile((tmp_path / "curves.vtp").read_bytes())
    assert len(f.arrays("Lines")["offsets"]) == 1 and len(f.arrays("Points")["Points"]) == got["points"]
    again = cli.main([*base, "-o", f"{tmp_path}/curves.json", "--archived-intersections", f"{tmp_path}/hits", "--archived-traced", f"{tmp_path}/traced"])
    assert again["points"] == got["points"] and json.loads(spark.read.text(f"{tmp_path}/curves.json").first().value)["n"] == got["points"]
    cli.main([*base, "-o", f"{tmp_path}/s-%02d.vtp", "--output-type", "sliced"])
    assert [len(formats.VtkFile((tmp_path / f"s-{k:02}.vtp").read_bytes()).arrays("Points")["Points"]) for k in range(5)] == [1] * 5
    cli.main([*base, "-o", f"{tmp_path}/d.txt", "--output-type", "discrete"])
    assert spark.read.text(f"{tmp_path}/d.txt").count() == got["points"]
    cli.main([*base, "-o", f"{tmp_path}/i-%02d", "--output-type", "intercepted"])
    assert (tmp_path / "i-03").is_dir()
    ring = {"feature": "iso", "threshold": 12.3, "input": {"name": "moving_extremum_2d", "n_timesteps": 4}}
    for form in ("vtp", "ply", "stl", "vtk", "vtu"):
        found = track(spark, ring | {"output": {"pattern": f"{tmp_path}/iso.{form}"}})
        assert (tmp_path / f"iso.{form}").stat().st_size > 1000
    assert formats.parse_vtu((tmp_path / "iso.vtu").read_bytes())[1].shape == (found.cells.count(), 3)
    ball = {"feature": "iso", "threshold": 4.3, "input": {"name": "moving_extremum_3d", "n_timesteps": 2, "dimensions": [8, 8, 8], "options": {"x0": [3.4, 3.4, 3.4]}}}
    found = track(spark, ball | {"output": {"pattern": f"{tmp_path}/ball.vtu"}})
    assert formats.parse_vtu((tmp_path / "ball.vtu").read_bytes())[1].shape == (found.cells.count(), 4)
    with pytest.raises(ValueError):
        track(spark, ring | {"output": {"pattern": "x", "type": "sideways"}})


def test_other_features(spark):
    for name in ("cl", "sh", "lds"):
        found = track(spark, {"feature": name, "input": {"name": "tornado", "dimensions": [10, 10, 10], "n_timesteps": 2}})
        assert found.discrete.count() > 0 and found.cells.count() > 0
    found = track(spark, {"feature": "cc", "threshold": 0.5, "input": {"name": "woven", "dimensions": [16, 16], "n_timesteps": 4}})
    assert found.traced.count() == found.discrete.count() > 0


def test_mesh_from_a_file(spark, tmp_path):
    v, t = (x.toPandas().sort_values(c) for x, c in zip(U.structured_triangles(spark, 14, 14), ("vid", "tid")))
    points = np.stack((v["x"], v["y"], 0 * v["x"]), axis=1)
    for k in range(4):
        x, y = points[:, 0] - 0.41 - 0.02 * k, points[:, 1] - 0.43 - 0.02 * k
        (tmp_path / f"m-{k}.vtu").write_bytes(formats.write_vtu(points, t[["v0", "v1", "v2"]].to_numpy(), {"w": np.stack((-2 * x, -2 * y), axis=1), "f": x * x + y * y}))
    base = {"filenames": f"{tmp_path}/m-*.vtu", "mesh_filename": f"{tmp_path}/m-0.vtu"}
    found = track(spark, {"feature": "cp", "input": base | {"variables": ["w"]}})
    assert n_curves(found.traced) == 1
    off = found.traced.agg(F.max(F.abs(F.col("x") - 0.41 - 0.02 * F.col("t")))).first()[0]
    assert off < 1e-9
    found = track(spark, {"feature": "cp", "input": base | {"variables": ["f"]}, "smoothing_kernel_size": 0.08, "type_filter": "min"})
    near = found.traced.where("abs(x - 0.45) < 0.1 and abs(y - 0.47) < 0.1")
    assert near.select("id").distinct().count() == 1


def test_ocean_files(spark, tmp_path):
    layers = np.arange(12, dtype=float).reshape(3, 4)
    for k in range(2):
        (tmp_path / f"o{k}.nc").write_bytes(formats.write_netcdf({"velocityX": layers + k, "salinity": layers}, ("nCells", "nVertLevels"), record=True))
    got = files.read_mpas(spark, f"{tmp_path}/o*.nc", ["velocityX", "salinity"])
    assert got.columns == ["t", "cell", "layer", "velocityX", "salinity"] and got.where("t = 1 and cell = 2 and layer = 3").first().velocityX == 12.0
    mesh = {"xCell": [0, 1, 2], "yCell": [0, 0, 1], "zCell": [0, 0, 0]}
    assert files.read_units("a = 1.5;\n b=2e3;") == {"a": 1.5, "b": 2000.0} and len(mesh) == 3


def test_slice_volume_of_kept_corners(spark):
    points = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "tag long, k boolean")
    tets = spark.createDataFrame([(0, 1, 2, 3, 4), (1, 1, 2, 3, 5), (2, 1, 4, 4, 2)], "cell long, p0 long, p1 long, p2 long, p3 long")
    assert sorted(map(tuple, G.slice_volume(points, tets, F.col("k")).collect())) == [(1, 2, 3), (1, 2, 5), (1, 3, 5), (2, 3, 5)]


def test_lookups_at_the_edges(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 1.0), (3, None, 1.0), (4, 0.5, 0.2), (5, -9e6, 3.0)], "pid long, px double, py double")
    targets = spark.createDataFrame([(7, 50000.0, 0.0), (8, 1.0, 0.0), (9, -1.0, 0.0), (10, float("nan"), 0.0)], "vid long, x double, y double")
    assert sorted((r.pid, r.vid) for r in U.nearest(points, targets, 10.0).collect()) == [(1, 8), (2, 8), (4, 8), (5, 9)]
    assert U.nearest(points, targets.where("vid < 0"), 10.0).count() == 0
    keys = spark.createDataFrame([(1, -5.0), (2, 0.0), (3, 0.5), (4, 1.0), (5, 9.0), (6, None), (7, 2.5), (8, 3.0)], "key long, xi double")
    knots = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (2.0, 30.0), (3.0, 0.0), (3.0, -1.0)], "x double, y double")
    got = {r.key: r.yi for r in U.lerp_lookup(keys, knots).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 5.0, 4: 10.0, 5: 0.0, 6: None, 7: 15.0, 8: 0.0}
    assert {r.yi for r in U.lerp_lookup(keys, knots.where("x < 0")).collect()} == {None}
    plan = U.lerp_lookup(keys, knots)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_of_sorted_rows(spark):
    from driftmesh.operators.order import numbered_by

    df = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)], "a long, b long")
    assert sorted((r.a, r.n) for r in numbered_by(df, "a").collect()) == [(k, k) for k in range(101)]
    assert numbered_by(df.where("a < 0"), "a").count() == 0


def test_contour_trees(spark):
    """A path with two peaks, and the ring that joins its ends: around that the lowest way leads from the valley down to both ends."""
    f = [0.0, 5.0, 1.0, 4.0, -1.0]
    values = spark.createDataFrame([(0, k, x) for k, x in enumerate(f)], "t long, node long, f double")
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(4)], "t long, a long, b long")
    arcs = sorted((r.upper, r.lower) for r in G.contour_trees(values, edges).collect())
    assert arcs == [(1, 0), (1, 2), (3, 2), (3, 4)]  # a path is its own contour tree
    ring = edges.unionByName(spark.createDataFrame([(0, 0, 4)], "t long, a long, b long"))
    assert sorted((r.upper, r.lower) for r in G.contour_trees(values, ring).collect()) == [(0, 4), (1, 2), (2, 0), (3, 2)]


def test_contracted_surface(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, True), (1, 1.0, 0.0, False), (2, 0.0, 1.0, False), (3, 1.1, 0.1, True), (4, 2.0, 2.0, False)], "tag long, x double, y double, gone boolean")
    tri = spark.createDataFrame([(1, 2, 3), (2, 3, 4), (0, 1, 2)], "p0 long, p1 long, p2 long")
    got = {tuple(sorted(r)) for r in G.contract(points, tri, F.col("gone")).collect()}
    assert got == {(1, 2, 4)}


def test_critical_point_types(spark):
    f = S.woven_grid(spark, 24, 24, 3)
    every = X.critical_points_2d(f, (24, 24), 3, compat=False)
    kinds = {r.type: r.n for r in every.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) <= {1, 2, 4, 8} and X.critical_points_2d(f, (24, 24), 3, compat=False, types=4).count() == kinds.get(4, 0)

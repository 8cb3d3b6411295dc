import json

import numpy as np
from pyspark.sql import functions as F

from driftmesh.sources import files, sinks
from driftmesh.streaming.tracking import StepPairs, window_counts
from tests.conftest import DATA


def test_file_sources_agree(spark, tmp_path):
    x = np.arange(24, dtype=float).reshape(2, 3, 4)
    for t in range(2):
        x[t].astype("<f4").tofile(tmp_path / f"a-{t:03}.raw")
        np.save(tmp_path / f"b-{t:03}.npy", x[t])
        text = " ".join(map(str, x[t].ravel()))
        (tmp_path / f"c-{t:03}.vti").write_text(
            f'<VTKFile><ImageData WholeExtent="0 3 0 2 0 0"><Piece><PointData><DataArray Name="f" format="ascii">{text}</DataArray></PointData></Piece></ImageData></VTKFile>'
        )
    want = sorted((t, j, i, x[t, j, i]) for t in range(2) for j in range(3) for i in range(4))
    for df in (
        files.read_raw(spark, f"{tmp_path}/*.raw", (4, 3)),
        files.read_numpy(spark, f"{tmp_path}/*.npy"),
        files.read_vti(spark, f"{tmp_path}/*.vti", "f"),
    ):
        assert sorted(map(tuple, df.select("t", "j", "i", "f").collect())) == want
    assert files.series("a-%03d.raw", 2) == ["a-000.raw", "a-001.raw"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, s, float(s), 3 - s) for s in range(3)], "root long, piece int, seq int, x double, timestep int")
    for kind in ("json", "text", "binary"):
        sinks.write_points(df, f"{tmp_path}/p-{kind}", kind)
        sinks.write_curves(df, f"{tmp_path}/c-{kind}", kind)
    got = json.loads(spark.read.text(f"{tmp_path}/c-json").first().value)
    assert got["n"] == 3 and [p["x"] for p in got["points"]] == [0.0, 1.0, 2.0]
    assert spark.read.parquet(f"{tmp_path}/p-binary").count() == 3
    sinks.write_slices(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("timestep = 2").count() == 1
    assert 'NumberOfLines="1"' in sinks.polydata([(0, 0, 0), (1, 1, 1)], [[0, 1]])


def test_window_counts(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    got = window_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    run = got.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    want = events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start")).count()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_step_pairs(spark):
    field = spark.createDataFrame([(t, i, t * i) for t in range(5) for i in range(3)], "t long, i int, f long")

    def pair(rows):
        b = rows.select((F.col("t") - 1).alias("t"), "i", F.col("f").alias("g"))
        return rows.join(b, ["t", "i"]).select("t", "i", (F.col("g") - F.col("f")).alias("df"))

    steps = StepPairs(spark, pair)
    for n, cond in enumerate(("t < 2", "t = 99", "t = 2", "t > 2")):
        steps(field.where(cond), n)
    steps(field.where("t > 2"), 3)  # a batch that is tried again
    assert sorted(map(tuple, steps.results(spark).collect())) == [(t, i, i) for t in range(4) for i in range(3)]


def test_curves_that_grow(spark, tmp_path):
    """A streamed field gives the components of the whole field's points, whatever the batches."""
    from driftmesh.operators import fields as D
    from driftmesh.operators import graph as G
    from driftmesh.operators.features import critical_points_2d, domain
    from driftmesh.sources import synthetic as S
    from driftmesh.streaming.tracking import track_stream

    field = S.woven_grid(spark, 10, 10, 7)
    change = lambda df: D.clamp(df, -0.8, 0.8)
    for n, (lo, hi) in enumerate(((0, 2), (3, 3), (4, 6))):
        part = field.where(F.col("t").between(lo, hi)).coalesce(1)
        part.write.parquet(f"{tmp_path}/steps/part={n}")
    kinds = "t long, j int, i int, f double, part int"
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/steps").drop("part")
    run, curves = track_stream(stream, (10, 10), 7, f"{tmp_path}/base", f"{tmp_path}/check", change)
    run.awaitTermination()
    got = {r.tag: (r.root, r.complete) for r in curves.curves(spark).collect()}
    lattice = domain((10, 10), 7, 2)
    hits = critical_points_2d(change(field), (10, 10), 7, bits=21)
    want = {r.node: r.root for r in G.components(G.point_graph(hits, lattice, 2), hits.select(F.col("tag").alias("node"))).collect()}
    assert set(got) == set(want) and {t: r for t, (r, _) in got.items()} == want
    assert {c for _, c in got.values()} <= {True, False}
    assert spark.read.parquet(f"{tmp_path}/base/sliced").count() == hits.where("ordinal").count()

"""From a configuration to tracked features: one call that loads a field, extracts, traces, post-processes and writes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.mesh import Lattice
from .operators import curves as C
from .operators import features as X
from .operators import graph as G
from .operators import tracking as K
from .operators import unstructured as U
from .sources import files, sinks
from .sources.config import SourceConfig, load
from .sources.storage import materialize

#: Names of features, with their short forms.
FEATURES = {
    "critical_point": "critical_point", "cp": "critical_point", "critical_line": "critical_line", "cl": "critical_line", "isosurface": "isosurface", "iso": "isosurface",
    "tdgl_vortex": "tdgl_vortex", "tdgl": "tdgl_vortex", "sujudi_haimes": "sujudi_haimes", "sh": "sujudi_haimes", "levy_degani_seginer": "levy_degani_seginer",
    "lds": "levy_degani_seginer", "ridge_valley": "ridge_valley", "rv": "ridge_valley", "connected_component": "connected_component", "cc": "connected_component",
}


@dataclass(frozen=True)
class TrackerConfig:
    """``feature``, its ``input`` and ``output`` (type, format, pattern), and options of single features."""

    feature: str
    input: SourceConfig
    output: dict = field(default_factory=dict)
    archive: dict = field(default_factory=dict)
    threshold: float = 0.0
    post_processing_options: str = ""
    type_filter: str = ""
    duration_pruning_threshold: float = 0.0
    smoothing_kernel_size: float = 0.0

    @classmethod
    def of(cls, given: str | dict | TrackerConfig) -> TrackerConfig:
        """From a dictionary or JSON text; unknown keys, features and outputs are errors."""
        if isinstance(given, cls):
            return given
        given = json.loads(given) if isinstance(given, str) else dict(given)
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown tracker keys {sorted(unknown)}")
        if given.get("feature") not in FEATURES:
            raise ValueError(f"no feature {given.get('feature')!r}; there are {', '.join(FEATURES)}")
        given["feature"] = FEATURES[given["feature"]]
        given["input"] = SourceConfig.of(given.get("input", {}))
        sinks.output_kind(given.get("output", {}))
        return cls(**given)


def _types(names: str) -> int | None:
    """Bitmask of critical point types by their names, separated by |."""
    from .functions.numeric import TYPE_NAMES

    codes = {v: k for k, v in TYPE_NAMES.items()} | {"min": 2, "max": 8, "repelling": 2, "attracting": 8}
    return sum(codes[n.strip()] for n in names.split("|")) if names else None


def type_name(code: int, scalar: bool = True) -> str:
    from .functions.numeric import TYPE_NAMES, VECTOR_TYPE_NAMES

    return (TYPE_NAMES if scalar else VECTOR_TYPE_NAMES)[code]


@dataclass
class Tracked:
    """What a tracker has found: ``discrete`` points (a row each), ``traced`` points in curves, or ``cells`` of surfaces and volumes."""

    discrete: DataFrame
    traced: DataFrame | None = None
    cells: DataFrame | None = None

    def curves(self) -> DataFrame:
        return sinks.curves(self.traced, ("id",) if "sub" not in self.traced.columns else ("id", "sub"))


def track(spark: SparkSession, config: str | dict | TrackerConfig) -> Tracked:
    """Extract and track the configured feature; results are written if the configuration has an output.

    ``archive`` may name Parquet folders for ``discrete`` and ``traced`` points: they are read where they are, else written.
    """
    c = TrackerConfig.of(config)
    found = _archived(spark, c) or _track(spark, c)
    if c.output:
        sinks.write(found, c.output)
    return found


def _archived(spark: SparkSession, c: TrackerConfig) -> Tracked | None:
    def there(path: str | None) -> bool:
        if not path:
            return False
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    if not there(c.archive.get("traced")):
        return None
    traced = spark.read.parquet(c.archive["traced"])
    return Tracked(spark.read.parquet(c.archive["discrete"]) if there(c.archive.get("discrete")) else traced, traced)


def _kept(df: DataFrame, path: str | None) -> DataFrame:
    """A table in its archive, if it has one, else among the intermediate tables."""
    if not path:
        return materialize(df, "tracked")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _track(spark: SparkSession, c: TrackerConfig) -> Tracked:
    df, source = load(spark, c.input)
    steps, shape, archive = source.n_timesteps, source.dimensions, c.archive
    if source.mesh_filename:
        return _on_mesh(spark, c, df, source)
    d, scalar = len(shape), "f" in df.columns
    if c.feature == "critical_point":
        kind = "scalar" if scalar else "vector"
        found = (X.critical_points_2d if d == 2 else X.critical_points_3d)(df, shape, steps, kind=kind, types=_types(c.type_filter))
        points = _kept(found, archive.get("discrete"))
        traced = G.trace(points, X.domain(shape, steps, 2 if scalar else 1), d)
        return Tracked(points, _kept(_post(traced, c), archive.get("traced")))
    if c.feature == "isosurface":
        lattice = Lattice((0,) * (d + 1), (*shape, steps))
        points = _kept(X.contour_points(df, shape, steps, c.threshold), archive.get("discrete"))
        return Tracked(points, cells=materialize(G.level_triangles(points, lattice) if d == 2 else G.volumes(points, lattice), "cells"))
    if c.feature == "connected_component":
        labels = _kept(K.label_components(df, shape, c.threshold), archive.get("discrete"))
        edges = materialize(K.overlap(labels), "overlap")
        named = K.global_labels(edges, labels.select("t", "label").distinct())
        return Tracked(labels, labels.join(named, ["t", "label"]).withColumnRenamed("global", "id"), cells=edges)
    if d != 3:
        raise ValueError(f"{c.feature} needs a field in three dimensions")
    lines = {
        "critical_line": X.critical_lines, "sujudi_haimes": X.sujudi_haimes, "levy_degani_seginer": X.levy_degani_seginer, "ridge_valley": X.ridge_valley, "tdgl_vortex": X.phase_vortices,
    }[c.feature]
    if c.feature == "tdgl_vortex" and "re" not in df.columns:
        df = df.withColumnsRenamed({"u": "re", "v": "im"})
    points = _kept(lines(df, shape, steps), archive.get("discrete"))
    return Tracked(points, cells=materialize(G.line_surfaces(points, Lattice((0, 0, 0, 0), (*shape, steps))), "cells"))


def _on_mesh(spark: SparkSession, c: TrackerConfig, df: DataFrame, source: SourceConfig) -> Tracked:
    """Critical points on a triangle mesh: a scalar is smoothed and differentiated by a kernel, a vector is taken as it is."""
    if c.feature != "critical_point":
        raise ValueError("meshes carry critical points only")
    vertices, cells = files.read_mesh(spark, source.mesh_filename)
    n, axes = vertices.count(), ("x", "y") if "v3" not in cells.columns else ("x", "y", "z")
    jac: tuple[str, ...] = ()
    if "f" in df.columns:
        sigma = c.smoothing_kernel_size
        if not sigma:
            raise ValueError("a scalar on a mesh needs smoothing_kernel_size")
        df = U.smooth_with_derivatives(df, U.smoothing_kernel(vertices.select("vid", *axes), sigma), sigma)
        jac = ("j00", "j01", "j10", "j11")
    vec = ("u", "v", "w")[: len(axes)]
    points = _kept(U.critical_points(cells, df.join(vertices, "vid"), n, source.n_timesteps, vec, axes, jac), c.archive.get("discrete"))
    roots = U.track(points, cells, n, source.n_timesteps)
    return Tracked(points, _kept(points.join(roots, "tag").withColumnRenamed("root", "id"), c.archive.get("traced")))


def _post(traced: DataFrame, c: TrackerConfig) -> DataFrame:
    if not c.post_processing_options:
        return traced
    return C.post_process(traced, c.post_processing_options, c.duration_pruning_threshold)


def summary(found: Tracked) -> dict[str, int]:
    """Numbers of points, curves and cells."""
    out = {"points": found.discrete.count()}
    if found.traced is not None:
        key = [k for k in ("id", "sub") if k in found.traced.columns]
        out["curves"] = found.traced.select(*key).distinct().count()
    if found.cells is not None:
        out["cells"] = found.cells.count()
    return out


def track_critical_points_2d_scalar(spark: SparkSession, field: DataFrame, post: str = "") -> DataFrame:
    """``id, seq, loop`` and the points' columns of a 2D scalar field ``(t, j, i, f)`` on a lattice that starts at 0: from field to curves in one call."""
    size = field.agg(F.max("i"), F.max("j"), F.max("t")).first()
    w, h, steps = (int(x) + 1 for x in size)
    traced = G.trace(X.critical_points_2d(field, (w, h), steps), X.domain((w, h), steps, 2), 2)
    return C.post_process(traced, post) if post else traced

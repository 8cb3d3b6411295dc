"""A field from a configuration: the keys say what to read, and the rest is found by looking into the first file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields as D
from . import files, formats, synthetic

#: File formats and the endings that name them.
ENDINGS = {".vti": "vti", ".vtu": "vtu", ".nc": "nc", ".npy": "npy", ".png": "png", ".am": "amira", ".raw": "float32", ".f32": "float32", ".f64": "float64"}
#: Default lattice, steps and options of synthetic sources; shapes are (width, height[, depth]).
SYNTHETIC = {
    "woven": ((32, 32), 32),
    "double_gyre": ((64, 32), 50),
    "merger_2d": ((32, 32), 100),
    "moving_extremum_2d": ((21, 21), 32),
    "moving_extremum_3d": ((21, 21, 21), 32),
    "moving_ramp_3d": ((21, 21, 21), 32),
    "moving_dual_ramp_3d": ((21, 21, 21), 32),
    "volcano_2d": ((21, 21), 32),
    "tornado": ((32, 32, 32), 32),
    "abc": ((32, 32, 32), 1),
}


@dataclass(frozen=True)
class SourceConfig:
    """``type`` synthetic or file; ``name`` of a synthetic field or ``filenames`` (a glob or a list); the other keys may be left to ``completed``."""

    type: str = ""
    name: str = ""
    filenames: Any = ""
    mesh_filename: str = ""
    format: str = ""
    variables: tuple[str, ...] = ()
    dimensions: tuple[int, ...] = ()
    n_timesteps: int = 0
    perturbation: float = 0.0
    clamp: tuple[float, ...] = ()
    spatial_smoothing_kernel: float = 0.0
    spatial_smoothing_kernel_size: int = 5
    temporal_smoothing_kernel: float = 0.0
    temporal_smoothing_kernel_size: int = 5
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, given: str | dict | SourceConfig) -> SourceConfig:
        """From a dictionary or JSON text; unknown keys are an error."""
        if isinstance(given, cls):
            return given
        given = json.loads(given) if isinstance(given, str) else dict(given)
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown source keys {sorted(unknown)}")
        for key in ("variables", "dimensions", "clamp"):
            if key in given:
                given[key] = (given[key],) if isinstance(given[key], str) else tuple(given[key])
        return cls(**given)

    @classmethod
    def from_file(cls, path: str) -> SourceConfig:
        with open(path, encoding="utf-8") as f:
            return cls.of(f.read())

    def to_json(self) -> str:
        return json.dumps({k: getattr(self, k) for k in self.__dataclass_fields__ if getattr(self, k) not in ("", (), 0, 0.0, {})})

    def completed(self, spark: SparkSession) -> SourceConfig:
        """With type, format, dimensions, variables and the number of steps filled in, from defaults or the first file."""
        if self.name and not self.filenames:
            if self.name not in SYNTHETIC:
                raise ValueError(f"no synthetic source {self.name!r}; there are {', '.join(SYNTHETIC)}")
            shape, steps = SYNTHETIC[self.name]
            vector = {"double_gyre": ("u", "v"), "tornado": ("u", "v", "w"), "abc": ("u", "v", "w")}.get(self.name, ("f",))
            return replace(self, type="synthetic", dimensions=self.dimensions or shape, n_timesteps=self.n_timesteps or steps, variables=self.variables or vector)
        if not self.filenames:
            raise ValueError("a source needs a name or filenames")
        rows = spark.read.format("binaryFile").load(self.filenames).select("path").orderBy("path").collect()
        if not rows:
            raise ValueError(f"no file matches {self.filenames!r}")
        first = rows[0].path
        kind = self.format or ENDINGS.get("." + first.rpartition(".")[2], "")
        if kind not in {*ENDINGS.values()}:
            raise ValueError(f"unknown format of {first!r}; name one of {sorted(set(ENDINGS.values()))}")
        data = bytes(spark.read.format("binaryFile").load(first).select("content").first().content)
        shape, names, steps = self.dimensions, self.variables, len(rows)
        if kind == "vti":
            got = formats.VtkFile(data)
            names = names or tuple(got.arrays("PointData"))[:1]
            shape = shape or formats.parse_vti(data, names[0]).shape[::-1]
        elif kind == "vtu":
            names = names or tuple(formats.parse_vtu(data)[2])[:1]
        elif kind == "nc":
            nc = formats.NetCdf(data)
            names = names or tuple(n for n, v in nc.variables.items() if len(v[0]) >= 2)[:1]
            got = nc.read(names[0])
            d = len(shape) or (got.ndim - 1 if nc._record(nc.variables[names[0]][0]) else got.ndim)
            shape = shape or got.shape[::-1][:d]
            if got.ndim > d:
                steps = sum(formats.NetCdf(bytes(r.content)).read(names[0]).shape[0] for r in spark.read.format("binaryFile").load(self.filenames).select("content").toLocalIterator())
        elif kind == "npy":
            shape = shape or np.load(__import__("io").BytesIO(data)).shape[::-1]
        elif kind == "png":
            shape = shape or formats.parse_png(data).shape[::-1]
        elif kind == "amira":
            got = formats.parse_amira(data)
            shape, steps, names = shape or got.shape[2:0:-1], got.shape[0], names or (("f",) if got.ndim == 3 else ("u", "v", "w")[: got.shape[3]])
        elif not shape:
            raise ValueError("raw files need dimensions")
        return replace(self, type="file", format=kind, dimensions=tuple(map(int, shape)), variables=names or ("f",), n_timesteps=self.n_timesteps or steps)


def load(spark: SparkSession, config: str | dict | SourceConfig) -> tuple[DataFrame, SourceConfig]:
    """The field that a configuration names, with its snapshots smoothed, perturbed and clamped as that says, and the completed configuration.

    One component is the column ``f``, several are ``u, v[, w]``; steps are numbered from 0.
    """
    c = SourceConfig.of(config).completed(spark)
    d = len(c.dimensions)
    if c.type == "synthetic":
        make = {"woven": lambda **o: synthetic.woven_grid(spark, *c.dimensions, c.n_timesteps, **o), "abc": lambda **o: synthetic.abc_flow(spark, *c.dimensions, **o)}
        make |= {"double_gyre": lambda **o: synthetic.double_gyre(spark, *c.dimensions, c.n_timesteps, **o), "merger_2d": lambda **o: synthetic.merger_grid(spark, *c.dimensions, c.n_timesteps, **o)}
        make |= {"tornado": lambda **o: synthetic.tornado(spark, c.dimensions, c.n_timesteps, **o)}
        df = make[c.name](**c.options) if c.name in make else synthetic.synthetic(spark, c.name, shape=c.dimensions, steps=c.n_timesteps, **c.options)
    elif c.format in ("float32", "float64"):
        df = files.read_raw(spark, c.filenames, c.dimensions, c.format)
    elif c.format == "npy":
        df = files.read_numpy(spark, c.filenames, d)
    elif c.format == "png":
        df = files.read_png(spark, c.filenames)
    elif c.format == "amira":
        df = files.read_amira(spark, c.filenames)
    elif c.format == "nc":
        df = files.read_netcdf(spark, c.filenames, list(c.variables), d)
    elif c.format == "vtu":
        df = files.read_vtu(spark, c.filenames, list(c.variables))
    else:
        df = None
        for v in c.variables:
            part = files.read_vti(spark, c.filenames, v, d).withColumnRenamed("f", v)
            df = part if df is None else df.join(part, ["t", *("k", "j", "i")[3 - d :]])
    if c.type == "file":
        place = ["t", "vid"] if c.format == "vtu" else ["t", *("k", "j", "i")[3 - d :]]
        values = [x for x in df.columns if x not in place] if c.format == "vtu" else (list(c.variables) if c.format in ("nc", "vti", "amira") else ["f"])
        df = df.select(*place, *[F.col(f"`{v}`").alias(n) for v, n in zip(values, ("f",) if len(values) == 1 else ("u", "v", "w"))])
        low = df.agg(F.min("t")).first()[0] or 0
        df = df.withColumn("t", F.col("t") - low).where(F.col("t") < c.n_timesteps)
    return transform(df, c), c


def transform(df: DataFrame, c: SourceConfig) -> DataFrame:
    """Each snapshot smoothed in space, perturbed and clamped, then the series smoothed in time, as far as the configuration asks."""
    for col in [x for x in ("f", "u", "v", "w") if x in df.columns]:
        if c.spatial_smoothing_kernel and D.axes_of(df):
            df = D.smooth(df, c.spatial_smoothing_kernel, c.spatial_smoothing_kernel_size, col)
        if c.perturbation:
            df = D.perturb(df, c.perturbation, col)
        if c.clamp:
            df = D.clamp(df, *c.clamp, col)
        if c.temporal_smoothing_kernel:
            df = D.smooth_time(df, c.temporal_smoothing_kernel, c.temporal_smoothing_kernel_size // 2, col, key=tuple(D.axes_of(df)) or ("vid",))
    return df

"""File sources: raw blocks, NumPy arrays, VTK images and meshes, classic NetCDF, AmiraMesh and PNG as field tables.

Each file is one step; executors read whole files through Spark's own reader, so any store that Spark knows will do.
Steps are numbered by the last number in a file's name before its ending.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import formats

_LAST_NUMBER = re.compile(r"(\d+)(?=\D*$)")


def series(pattern: str, n: int, first: int = 0) -> list[str]:
    """Names of a file series from a printf-like pattern."""
    return [pattern % k for k in range(first, first + n)]


def _step(name: str) -> int:
    stem = name.rpartition("/")[2].rpartition(".")[0] or name.rpartition("/")[2]
    got = _LAST_NUMBER.search(stem)
    return int(got[1]) if got else 0


def _frame(name: str, values: np.ndarray, axes: tuple[str, ...]) -> pd.DataFrame:
    index = np.indices(values.shape).reshape(values.ndim, -1)
    cols = {"t": np.full(values.size, _step(name), np.int64)}
    cols |= {a: i.astype(np.int32) for a, i in zip(axes, index)}
    return pd.DataFrame(cols | {"f": values.reshape(-1).astype(float)})


def _read(spark: SparkSession, path: str | list[str], axes: tuple[str, ...], parse: Callable[[bytes], np.ndarray]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                yield _frame(name, parse(bytes(data)), axes)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"t long, {', '.join(f'{a} int' for a in axes)}, f double")


def _axes(shape: tuple[int, ...]) -> tuple[str, ...]:
    return ("i", "j", "k")[: len(shape)][::-1]


def read_raw(spark: SparkSession, path: str | list[str], shape: tuple[int, ...], kind: str = "float32") -> DataFrame:
    """``(t, [k,] j, i, f)`` of little-endian float32 or float64 blocks; ``shape`` is (width, height[, depth])."""
    if kind not in ("float32", "float64"):
        raise ValueError(kind)
    dtype = "<f4" if kind == "float32" else "<f8"
    return _read(spark, path, _axes(shape), lambda data: np.frombuffer(data, dtype).reshape(shape[::-1]))


def read_numpy(spark: SparkSession, path: str | list[str], dims: int = 2) -> DataFrame:
    """The same from ``.npy`` files, slowest axis first."""
    return _read(spark, path, ("k", "j", "i")[3 - dims :], lambda data: np.load(io.BytesIO(data), allow_pickle=False))


def read_vti(spark: SparkSession, path: str | list[str], variable: str | None = None, dims: int = 2) -> DataFrame:
    """The same from XML image data: ASCII or binary, inline or appended, plain or compressed."""
    return _read(spark, path, ("k", "j", "i")[3 - dims :], lambda data: formats.parse_vti(data, variable))


def read_amira(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(t, j, i, f ..)`` of AmiraMesh lattices whose third axis is time; components are ``u, v[, w]`` (one is ``f``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["content"]:
                got = formats.parse_amira(bytes(data))
                for t, plane in enumerate(got):
                    index = np.indices(plane.shape[:2]).reshape(2, -1)
                    cols = plane.reshape(index.shape[1], -1).astype(float)
                    rest = {n: cols[:, k] if k < cols.shape[1] and cols.shape[1] > 1 else np.full(len(cols), np.nan) for k, n in enumerate("uvw")}
                    f = cols[:, 0] if cols.shape[1] == 1 else np.full(len(cols), np.nan)
                    yield pd.DataFrame({"t": np.int64(t), "j": index[0].astype(np.int32), "i": index[1].astype(np.int32), "f": f, **rest})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "t long, j int, i int, f double, u double, v double, w double")


def read_png(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(t, j, i, f)``: brightness, the first row of pixels at j = 0."""
    return _read(spark, path, ("j", "i"), formats.parse_png)


def read_netcdf(spark: SparkSession, path: str | list[str], variables: list[str], dims: int = 2) -> DataFrame:
    """``(t, [k,] j, i, ...)`` with a column for each variable of classic NetCDF files.

    A variable with one axis more than ``dims`` has time first: its records are steps one after another over the files in the order
    of their names. Without that axis each file is a step.
    """
    axes = ("k", "j", "i")[3 - dims :]

    def steps_of(data: bytes) -> int:
        got = formats.NetCdf(data).read(variables[0])
        return got.shape[0] if got.ndim > dims else 1

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "n": [steps_of(bytes(c)) for c in pdf["content"]]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first, at = {}, 0
    for r in sorted(files.mapInPandas(count, "path string, n long").collect()):  # one row a file
        first[r.path] = at
        at += r.n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                nc = formats.NetCdf(bytes(data))
                got = [nc.read(v) for v in variables]
                got = [a if a.ndim > dims else a[None] for a in got]
                for k in range(len(got[0])):
                    index = np.indices(got[0].shape[1:]).reshape(dims, -1)
                    cols = {"t": np.full(index.shape[1], first[name] + k, np.int64)} | {a: x.astype(np.int32) for a, x in zip(axes, index)}
                    yield pd.DataFrame(cols | {v: a[k].reshape(-1).astype(float) for v, a in zip(variables, got)})

    schema = f"t long, {', '.join(f'{a} int' for a in axes)}, {', '.join(f'`{v}` double' for v in variables)}"
    return files.mapInPandas(run, schema)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vid, x, y, z)`` and ``(tid or cid, v0 ..)`` of one VTK unstructured grid, as the mesh operators take them."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    points, cells, _ = formats.parse_vtu(bytes(row.content))
    vertices = pd.DataFrame({"vid": np.arange(len(points)), **{a: points[:, k].astype(float) for k, a in enumerate("xyz")}})
    name = "tid" if cells.shape[1] == 3 else "cid"
    table = pd.DataFrame({name: np.arange(len(cells)), **{f"v{k}": cells[:, k] for k in range(cells.shape[1])}})
    return spark.createDataFrame(vertices), spark.createDataFrame(table)


def read_vtu(spark: SparkSession, path: str | list[str], variables: list[str]) -> DataFrame:
    """``(t, vid, ...)``: point arrays of VTK unstructured grids, a file a step; several components are ``name_0, name_1 ..``."""
    probe = formats.parse_vtu(bytes(spark.read.format("binaryFile").load(path).orderBy("path").select("content").first().content))[2]
    names = {v: [v] if probe[v].ndim == 1 else [f"{v}_{k}" for k in range(probe[v].shape[1])] for v in variables}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                arrays = formats.parse_vtu(bytes(data))[2]
                cols = {n: arrays[v].reshape(len(arrays[v]), -1)[:, k].astype(float) for v, ns in names.items() for k, n in enumerate(ns)}
                yield pd.DataFrame({"t": np.int64(_step(name)), "vid": np.arange(len(next(iter(cols.values()))))} | cols)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "t long, vid long, " + ", ".join(f"`{n}` double" for ns in names.values() for n in ns))


def read_mpas(spark: SparkSession, path: str | list[str], variables: list[str]) -> DataFrame:
    """``(t, cell, layer, ...)``: cell variables (time, cell, layer) of ocean snapshots in classic NetCDF."""
    got = read_netcdf(spark, path, variables, 2)
    return got.withColumnsRenamed({"j": "cell", "i": "layer"})


def read_mpas_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``cells (cell, x, y, z, vertices, neighbours)`` and ``vertices (vertex, x, y, z, cells)``; numbers start at 0, absent ones are left out."""
    nc = formats.NetCdf(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))

    def table(name: str, where: str, lists: dict[str, str], sizes: str | None) -> DataFrame:
        xyz = [nc.read(f"{a}{where}").astype(float).tolist() for a in "xyz"]
        got = {k: nc.read(v).astype(np.int64) - 1 for k, v in lists.items()}
        n_of = nc.read(sizes) if sizes else None
        rows = []
        for k in range(len(xyz[0])):
            parts = [[int(x) for x in (a[k][: n_of[k]] if n_of is not None else a[k]) if x >= 0] for a in got.values()]
            rows.append((k, *(c[k] for c in xyz), *parts))
        return spark.createDataFrame(rows, f"{name} long, x double, y double, z double, " + ", ".join(f"{k} array<long>" for k in got))

    return table("cell", "Cell", {"vertices": "verticesOnCell", "neighbours": "cellsOnCell"}, "nEdgesOnCell"), table("vertex", "Vertex", {"cells": "cellsOnVertex"}, None)


def read_units(text: str) -> dict[str, float]:
    """Assignments ``name = number;`` of a units file."""
    return {k: float(v) for k, v in re.findall(r"(\w+)\s*=\s*([-+0-9.eE]+)\s*;", text)}

"""Sinks for points, curves, surfaces and volumes: JSON, text, Parquet ("binary"), and files for viewers; array series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import formats


def write_points(df: DataFrame, path: str, kind: str = "json") -> None:
    """One record a point."""
    if kind == "json":
        df.write.json(path)
    elif kind == "binary":
        df.write.parquet(path)
    elif kind == "text":
        parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in df.columns]
        df.select(F.concat_ws(", ", *parts).alias("value")).write.text(path)
    else:
        raise ValueError(kind)


def curves(df: DataFrame, key: tuple[str, ...] = ("root", "piece"), order: str = "seq") -> DataFrame:
    """One row a curve: its key, number of points, and points in order. A curve has a point for each cell it crosses."""
    rest = [c for c in df.columns if c not in (*key, order)]
    points = F.sort_array(F.collect_list(F.struct(order, *rest)))
    return df.groupBy(*key).agg(F.count("*").alias("n"), points.alias("points"))


def write_curves(df: DataFrame, path: str, kind: str = "json", key: tuple[str, ...] = ("root", "piece"), order: str = "seq") -> None:
    """One record a curve; as text a header line and a line for each point."""
    got = curves(df, key, order)
    if kind != "text":
        write_points(got, path, kind)
        return
    head = F.concat(F.lit("curve "), F.concat_ws("-", *[F.col(k).cast("string") for k in key]), F.lit(", n="), F.col("n").cast("string"))
    got.select(F.concat_ws("\n", head, F.transform("points", lambda p: F.to_json(p))).alias("value")).write.text(path)


def intercepted(df: DataFrame, t: int, span: int) -> DataFrame:
    """Points of the last ``span`` steps up to ``t``."""
    return df.where(F.col("t").between(t - span, t))


def write_slices(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Points in one folder a step."""
    df.write.partitionBy("timestep").format(kind).save(path)


#: Formats of each output type; surfaces and volumes have cells.
OUTPUTS = {"discrete": ("json", "text", "binary", "vtp"), "traced": ("json", "text", "binary", "vtp"), "sliced": ("json", "binary", "vtp"), "intercepted": ("json", "binary", "vtp")}
CELLS = ("vtp", "vtu", "ply", "stl", "vtk")


def output_kind(output: dict) -> tuple[str, str]:
    """(type, format) of an output configuration, the format by the pattern's ending if it is auto."""
    if not output:
        return "traced", "json"
    kind, form, pattern = output.get("type", "traced"), output.get("format", "auto"), output.get("pattern", "")
    if unknown := set(output) - {"type", "format", "pattern", "span"}:
        raise ValueError(f"unknown output keys {sorted(unknown)}")
    if kind == "intersections":
        kind = "discrete"
    if form == "auto":
        form = {"json": "json", "txt": "text", "vtp": "vtp", "pvtp": "vtp", "vtu": "vtu", "ply": "ply", "stl": "stl", "vtk": "vtk"}.get(pattern.rpartition(".")[2], "binary")
    form = {"pvtp": "vtp", "parquet": "binary"}.get(form, form)
    if kind not in OUTPUTS or form not in {*OUTPUTS[kind], *CELLS} or not pattern:
        raise ValueError(f"output needs a pattern, a type of {sorted(OUTPUTS)} and a format of {sorted({*OUTPUTS[kind if kind in OUTPUTS else 'traced'], *CELLS})}")
    return kind, form


def write(found, output: dict) -> None:
    """Write what a tracker has found as its output configuration says: files for viewers are made on the driver, all else by the executors.

    Sliced and intercepted outputs have one file (or folder) a step; ``pattern`` numbers them like printf.
    """
    kind, form = output_kind(output)
    path = output["pattern"]
    if found.cells is not None and form in CELLS and found.traced is None:
        return _viewer(path, cells_file(found.discrete, found.cells, form))
    df = found.discrete if kind == "discrete" or found.traced is None else found.traced
    if kind in ("sliced", "intercepted"):
        step = "timestep" if "timestep" in df.columns else "t"
        for r in df.select(step).distinct().orderBy(step).collect():  # one row a step
            part = df.where((F.col(step) == r[0]) & F.col("ordinal")) if kind == "sliced" and "ordinal" in df.columns else df.where(F.col(step) == r[0])
            if kind == "intercepted":
                part = intercepted(df, int(r[0]), int(output.get("span", 1)))
            _one(part, path % int(r[0]), form, kind)
        return None
    return _one(df, path, form, kind)


def _one(df: DataFrame, path: str, form: str, kind: str) -> None:
    key = tuple(c for c in ("id", "sub") if c in df.columns)
    if form in CELLS:
        return _viewer(path, curves_file(df, key) if kind in ("traced", "intercepted") and "seq" in df.columns else points_file(df))
    if kind == "discrete" or "seq" not in df.columns:
        return write_points(df, path, form)
    return write_curves(df, path, form, key or ("root", "piece"))


def _viewer(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def _placed(df: DataFrame):
    """Points on the driver, for a viewer: planar ones have their time as third coordinate."""
    rows = df.toPandas()
    third = rows["z"] if "z" in rows else rows["t"]
    return rows, np.stack((rows["x"], rows["y"], third), axis=1).astype(float)


def _scalars(rows) -> dict:
    return {c: rows[c].to_numpy(np.int32 if c == "type" else np.float64) for c in ("type", "t", "scalar", "vx", "vy", "vz") if c in rows}


def points_file(df: DataFrame) -> bytes:
    rows, xyz = _placed(df)
    return formats.write_vtp(xyz, data=_scalars(rows))


def curves_file(df: DataFrame, key: tuple[str, ...] = ("root", "piece")) -> bytes:
    """Polylines of curves, closed ones back to their first point, with each point's curve, type, time and scalars."""
    rows, xyz = _placed(df.orderBy(*key, "seq"))
    name = rows.groupby(list(key)).ngroup().to_numpy()
    lines = [np.flatnonzero(name == n).tolist() for n in range(int(name.max()) + 1 if len(name) else 0)]
    if "loop" in rows:
        lines = [x + x[:1] if bool(rows["loop"].iloc[x[0]]) and len(x) > 2 else x for x in lines]
    return formats.write_vtp(xyz, lines, data={"id": name.astype(np.int64)} | _scalars(rows))


def cells_file(points: DataFrame, cells: DataFrame, form: str) -> bytes:
    """Triangles or tetrahedra ``p0 ..`` between points ``tag``, for a viewer."""
    rows, xyz = _placed(points.orderBy("tag"))
    names = [c for c in ("p0", "p1", "p2", "p3") if c in cells.columns]
    corner = np.searchsorted(rows["tag"].to_numpy(), cells.select(*names).toPandas().to_numpy())
    if len(names) == 4:
        if form != "vtu":
            raise ValueError("volumes are written as vtu")
        return formats.write_vtu(xyz, corner, _scalars(rows))
    make = {"vtp": lambda: formats.write_vtp(xyz, polys=corner, data=_scalars(rows)), "vtu": lambda: formats.write_vtu(xyz, corner, _scalars(rows)), "ply": lambda: formats.write_ply(xyz, corner)}
    make |= {"stl": lambda: formats.write_stl(xyz, corner), "vtk": lambda: formats.write_legacy(xyz, polys=corner)}
    return make[form]()


def write_arrays(df: DataFrame, pattern: str, form: str, shape: tuple[int, ...], cols: tuple[str, ...] = ("f",)) -> None:
    """A field as one file a step: ``nc``, ``vti``, ``float32`` or ``float64``; each step is one task's, which writes it to a shared folder."""
    if form not in ("nc", "vti", "float32", "float64"):
        raise ValueError(form)
    axes = ("i", "j", "k")[: len(shape)][::-1]

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {c: np.full(shape[::-1], np.nan) for c in cols}
        for c in cols:
            arrays[c][tuple(pdf[a].to_numpy() for a in axes)] = pdf[c].to_numpy(float)
        t = int(pdf["t"].iloc[0])
        if form == "nc":
            data = formats.write_netcdf(arrays, tuple("xyz"[: len(shape)][::-1]), record=True)
        elif form == "vti":
            data = formats.write_vti(arrays)
        else:
            stacked = np.stack(list(arrays.values()), axis=-1) if len(cols) > 1 else arrays[cols[0]]
            data = stacked.astype("<f4" if form == "float32" else "<f8").tobytes()
        with open(pattern % t, "wb") as f:
            f.write(data)
        return pd.DataFrame({"t": [t], "bytes": [len(data)]})

    df.select("t", *axes, *cols).groupBy("t").applyInPandas(save, "t long, bytes long").collect()


def polydata(points: list[tuple[float, float, float]], lines: list[list[int]]) -> str:
    """ASCII polydata of one curve set that the caller has brought to the driver for viewing."""
    ends, at = [], 0
    for line in lines:
        at += len(line)
        ends.append(at)
    flat = " ".join(f"{x:g}" for p in points for x in p)
    return (
        '<?xml version="1.0"?>\n<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian"><PolyData>'
        f'<Piece NumberOfPoints="{len(points)}" NumberOfLines="{len(lines)}">'
        f'<Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">{flat}</DataArray></Points>'
        f'<Lines><DataArray type="Int64" Name="connectivity" format="ascii">{" ".join(str(i) for line in lines for i in line)}</DataArray>'
        f'<DataArray type="Int64" Name="offsets" format="ascii">{" ".join(map(str, ends))}</DataArray></Lines></Piece></PolyData></VTKFile>\n'
    )

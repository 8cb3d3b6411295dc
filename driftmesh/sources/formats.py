"""Parsers and writers of array files, bytes to NumPy and back: VTK XML, classic NetCDF, AmiraMesh, greyscale PNG.

Arrays have their slowest axis first; several components are a last axis.
"""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np

#: Type names of VTK XML files.
VTK_TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}
#: Cell numbers of VTK: vertex count by cell type.
VTK_TRIANGLE, VTK_TETRA = 5, 10
#: Type numbers of classic NetCDF.
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class VtkFile:
    """Data arrays of one VTK XML file: ASCII, inline base64 or appended (raw or base64), plain or zlib-compressed."""

    def __init__(self, data: bytes):
        mark = re.search(rb"<AppendedData[^>]*>\s*_", data)
        self.blob, self.encoded = b"", False
        if mark:
            end = data.rfind(b"</AppendedData>")
            self.blob, self.encoded = data[mark.end() : end], b'"base64"' in mark[0]
            data = data[: mark.start()] + data[end + len(b"</AppendedData>") :]
        self.root = ET.fromstring(data)
        self.order = "<" if self.root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
        self.head = self.order + {"UInt32": "u4", "UInt64": "u8"}[self.root.get("header_type", "UInt32")]
        if self.root.get("compressor") not in (None, "vtkZLibDataCompressor"):
            raise ValueError(f"compressor {self.root.get('compressor')}")
        self.packed = self.root.get("compressor") is not None

    def _bytes(self, raw: bytes, encoded: bool) -> bytes:
        """One array's bytes, from a stream that begins with its header."""
        size = np.dtype(self.head).itemsize

        def take(n: int, at: int = 0) -> bytes:
            if not encoded:
                return raw[at : at + n]
            return base64.b64decode(raw[at : at + 4 * -(-n // 3)])[:n]

        def skip(n: int) -> int:
            return 4 * -(-n // 3) if encoded else n

        if not self.packed:
            n = int(np.frombuffer(take(size), self.head)[0])
            return take(size + n)[size:]
        blocks = int(np.frombuffer(take(size), self.head)[0])
        head = np.frombuffer(take(size * (3 + blocks)), self.head)
        at, body = skip(size * (3 + blocks)), take(int(head[3:].sum()), skip(size * (3 + blocks)))
        out, at = [], 0
        for n in head[3:].tolist():
            out.append(zlib.decompress(body[at : at + n]))
            at += n
        return b"".join(out)

    def values(self, node: ET.Element) -> np.ndarray:
        kind = self.order + VTK_TYPES[node.get("type", "Float64")]
        if node.get("format", "ascii") == "ascii":
            got = np.array((node.text or "").split(), float).astype(kind)
        elif node.get("format") == "appended":
            got = np.frombuffer(self._bytes(self.blob[int(node.get("offset")) :], self.encoded), kind)
        else:
            got = np.frombuffer(self._bytes((node.text or "").strip().encode(), True), kind)
        n = int(node.get("NumberOfComponents") or 1)
        return got.reshape(-1, n) if n > 1 else got

    def arrays(self, section: str) -> dict[str, np.ndarray]:
        part = self.root.find(f".//{section}")
        return {} if part is None else {a.get("Name"): self.values(a) for a in part.findall("DataArray")}


def parse_vti(data: bytes, variable: str | None = None) -> np.ndarray:
    """A point array of VTK image data; the first one if none is named. A depth of one gives two axes."""
    f = VtkFile(data)
    lo_hi = list(map(int, f.root.find("ImageData").get("WholeExtent").split()))
    shape = [b - a + 1 for a, b in zip(lo_hi[::2], lo_hi[1::2])][::-1]
    arrays = f.arrays("PointData")
    if not arrays or variable not in (None, *arrays):
        raise ValueError(f"no array {variable!r}; there are {sorted(arrays)}")
    got = arrays[variable] if variable else next(iter(arrays.values()))
    got = got.reshape(*shape, *got.shape[1:])
    return got[0] if shape[0] == 1 else got


def parse_vtu(data: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Points (n, 3), cells (m, 3 or 4) with ascending vertices, and point arrays of a VTK unstructured grid.

    Triangles are read, or tetrahedra if there are any; other cells are left out.
    """
    f = VtkFile(data)
    points = next(iter(f.arrays("Points").values())).reshape(-1, 3)
    cells = f.arrays("Cells")
    ends, kinds = cells["offsets"].astype(np.int64), cells["types"].astype(int)
    size, kind = (4, VTK_TETRA) if (kinds == VTK_TETRA).any() else (3, VTK_TRIANGLE)
    first = (np.append(0, ends[:-1]))[kinds == kind]
    got = cells["connectivity"].astype(np.int64)[first[:, None] + np.arange(size)]
    return points, np.sort(got, axis=1), f.arrays("PointData")


def _data_array(name: str, values: np.ndarray, compress: bool) -> str:
    values = np.ascontiguousarray(values)
    kind = next(k for k, v in VTK_TYPES.items() if np.dtype(v) == values.dtype.newbyteorder("="))
    raw = values.astype(values.dtype.newbyteorder("<")).tobytes()
    if compress:
        z = zlib.compress(raw)
        text = base64.b64encode(struct.pack("<4I", 1, len(raw), len(raw), len(z))).decode() + base64.b64encode(z).decode()
    else:
        text = base64.b64encode(struct.pack("<I", len(raw)) + raw).decode()
    n = values.shape[1] if values.ndim > 1 else 1
    return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="binary">{text}</DataArray>'


def _vtk(kind: str, body: str, compress: bool) -> bytes:
    packed = ' compressor="vtkZLibDataCompressor"' if compress else ""
    return f'<?xml version="1.0"?>\n<VTKFile type="{kind}" version="0.1" byte_order="LittleEndian" header_type="UInt32"{packed}>{body}</VTKFile>\n'.encode()


def write_vti(arrays: dict[str, np.ndarray], compress: bool = True) -> bytes:
    """VTK image data of arrays with two or three axes."""
    shape = next(iter(arrays.values())).shape
    shape = (1,) * (3 - len(shape)) + shape
    extent = " ".join(f"0 {n - 1}" for n in reversed(shape))
    data = "".join(_data_array(k, v.ravel(), compress) for k, v in arrays.items())
    body = f'<ImageData WholeExtent="{extent}" Origin="0 0 0" Spacing="1 1 1"><Piece Extent="{extent}"><PointData>{data}</PointData></Piece></ImageData>'
    return _vtk("ImageData", body, compress)


def write_vtu(points: np.ndarray, cells: np.ndarray, data: dict[str, np.ndarray] | None = None, compress: bool = True) -> bytes:
    """A VTK unstructured grid of triangles or tetrahedra."""
    kind = VTK_TRIANGLE if cells.shape[1] == 3 else VTK_TETRA
    n, m = len(points), len(cells)
    parts = [_data_array("connectivity", cells.astype("i8").ravel(), compress), _data_array("offsets", np.arange(1, m + 1) * cells.shape[1], compress), _data_array("types", np.full(m, kind, "u1"), compress)]
    fields = "".join(_data_array(k, v, compress) for k, v in (data or {}).items())
    body = f'<UnstructuredGrid><Piece NumberOfPoints="{n}" NumberOfCells="{m}"><PointData>{fields}</PointData><Points>{_data_array("Points", points.astype("f8"), compress)}</Points><Cells>{"".join(parts)}</Cells></Piece></UnstructuredGrid>'
    return _vtk("UnstructuredGrid", body, compress)


def write_vtp(points: np.ndarray, lines: list[list[int]] = (), polys: np.ndarray | None = None, data: dict[str, np.ndarray] | None = None, compress: bool = True) -> bytes:
    """VTK polydata: points with lines or triangles (else each point as a vertex), and point arrays."""
    polys = np.zeros((0, 3), np.int64) if polys is None else polys
    verts = [] if len(lines) or len(polys) else [[k] for k in range(len(points))]

    def part(name: str, runs) -> str:
        flat = np.array([x for r in runs for x in r], "i8")
        return f"<{name}>{_data_array('connectivity', flat, compress)}{_data_array('offsets', np.cumsum([len(r) for r in runs]).astype('i8'), compress)}</{name}>"

    fields = "".join(_data_array(k, v, compress) for k, v in (data or {}).items())
    piece = f'<Piece NumberOfPoints="{len(points)}" NumberOfVerts="{len(verts)}" NumberOfLines="{len(lines)}" NumberOfStrips="0" NumberOfPolys="{len(polys)}">'
    body = f"<PolyData>{piece}<PointData>{fields}</PointData><Points>{_data_array('Points', points.astype('f8'), compress)}</Points>{part('Verts', verts)}{part('Lines', lines)}{part('Polys', polys.tolist())}</Piece></PolyData>"
    return _vtk("PolyData", body, compress)


def write_ply(points: np.ndarray, faces: np.ndarray) -> bytes:
    head = f"ply\nformat ascii 1.0\nelement vertex {len(points)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = ["%r %r %r" % tuple(map(float, p)) for p in points] + [" ".join(map(str, (len(f), *f))) for f in faces.tolist()]
    return (head + "\n".join(rows) + "\n").encode()


def write_stl(points: np.ndarray, faces: np.ndarray) -> bytes:
    """Binary STL: a normal and three corners for each triangle."""
    p = points[faces].astype("<f4")
    normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    rows = np.zeros(len(faces), np.dtype([("v", "<f4", (4, 3)), ("a", "<u2")]))
    rows["v"][:, 0], rows["v"][:, 1:] = normal / np.where(size > 0, size, 1), p
    return b"\0" * 80 + struct.pack("<I", len(faces)) + rows.tobytes()


def write_legacy(points: np.ndarray, lines: list[list[int]] = (), polys: np.ndarray | None = None) -> bytes:
    """Polydata in VTK's legacy ASCII form."""
    out = ["# vtk DataFile Version 3.0", "driftmesh", "ASCII", "DATASET POLYDATA", f"POINTS {len(points)} double"]
    out += ["%r %r %r" % tuple(map(float, p)) for p in points]
    for name, runs in (("LINES", list(lines)), ("POLYGONS", [] if polys is None else polys.tolist())):
        if runs:
            out.append(f"{name} {len(runs)} {sum(len(r) + 1 for r in runs)}")
            out += [" ".join(map(str, (len(r), *r))) for r in runs]
    return ("\n".join(out) + "\n").encode()


class NetCdf:
    """Classic NetCDF (versions 1 and 2): dimensions, attributes and variables; the record dimension comes first."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.data, self.at, self.wide = data, 4, data[3] == 2
        self.n_records = self._int()
        self.dims = [(self._name(), self._int()) for _ in range(self._list())]
        self.attributes = self._attributes()
        self.variables: dict[str, tuple[list[int], dict, str, int, int]] = {}
        for _ in range(self._list()):
            name = self._name()
            dims = [self._int() for _ in range(self._int())]
            attrs, kind, size = self._attributes(), NC_TYPES[self._int()], self._int()
            begin = self._int(8) if self.wide else self._int()
            self.variables[name] = dims, attrs, kind, size, begin
        records = [size for dims, _, _, size, _ in self.variables.values() if self._record(dims)]
        self.record_size = sum(records)
        if len(records) == 1:  # a single record variable isn't padded
            dims, _, kind, _, _ = next(v for v in self.variables.values() if self._record(v[0]))
            self.record_size = int(np.prod([self.dims[d][1] for d in dims[1:]], dtype=int)) * np.dtype(kind).itemsize

    def _int(self, n: int = 4) -> int:
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")

    def _name(self) -> str:
        n = self._int()
        self.at += -(-n // 4) * 4
        return self.data[self.at - -(-n // 4) * 4 :][:n].decode()

    def _list(self) -> int:
        self._int()  # the list's tag
        return self._int()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), NC_TYPES[self._int()], self._int()
            raw = self.data[self.at : self.at + n * np.dtype(kind).itemsize]
            self.at += -(-len(raw) // 4) * 4
            out[name] = raw.decode(errors="replace") if kind == "S1" else np.frombuffer(raw, kind)
        return out

    def _record(self, dims: list[int]) -> bool:
        return bool(dims) and self.dims[dims[0]][1] == 0

    def read(self, name: str) -> np.ndarray:
        if name not in self.variables:
            raise ValueError(f"no variable {name!r}; there are {sorted(self.variables)}")
        dims, _, kind, _, begin = self.variables[name]
        if not self._record(dims):
            shape = [self.dims[d][1] for d in dims]
            return np.frombuffer(self.data, kind, int(np.prod(shape, dtype=int)), begin).reshape(shape)
        shape = [self.dims[d][1] for d in dims[1:]]
        n = int(np.prod(shape, dtype=int))
        rows = [np.frombuffer(self.data, kind, n, begin + k * self.record_size) for k in range(self.n_records)]
        return np.stack(rows).reshape(self.n_records, *shape) if rows else np.zeros((0, *shape), kind)


def write_netcdf(arrays: dict[str, np.ndarray], names: tuple[str, ...], record: bool = False) -> bytes:
    """Classic NetCDF of equally shaped double arrays with the dimensions ``names``; ``record`` puts one unlimited record in front."""
    shape = next(iter(arrays.values())).shape

    def text(x: str) -> bytes:
        return struct.pack(">I", len(x)) + x.encode() + b"\0" * (-len(x) % 4)

    dims = ([("time", 0)] if record else []) + list(zip(names, shape))
    head = b"CDF\1" + struct.pack(">I", int(record)) + struct.pack(">II", 10, len(dims)) + b"".join(text(n) + struct.pack(">I", s) for n, s in dims) + b"\0" * 8
    size, bodies = int(np.prod(shape)) * 8, []
    fixed = head + struct.pack(">II", 11, len(arrays))
    length = len(fixed) + sum(len(text(n)) + 4 + 4 * len(dims) + 8 + 12 for n in arrays)
    for k, (name, a) in enumerate(arrays.items()):
        fixed += text(name) + struct.pack(f">I{len(dims)}I", len(dims), *range(len(dims))) + b"\0" * 8 + struct.pack(">III", 6, size, length + k * size)
        bodies.append(np.ascontiguousarray(a, ">f8").tobytes())
    return fixed + b"".join(bodies)


def parse_amira(data: bytes) -> np.ndarray:
    """A uniform AmiraMesh lattice of little-endian floats; vectors have their components last."""
    head, _, body = data.partition(b"# Data section follows")
    text = head.decode("latin-1")
    size = re.search(r"define\s+Lattice\s+(\d+)\s+(\d+)\s+(\d+)", text)
    many = re.search(r"Lattice\s*\{\s*float\s*(?:\[\s*(\d+)\s*\])?", text)
    if not size or not many or 'CoordType "uniform"' not in text:
        raise ValueError("not a uniform AmiraMesh lattice of floats")
    body = body.split(b"\n", 2)[2]  # the rest of this line, and the line that names the block
    w, h, d = map(int, size.groups())
    n = int(many[1] or 1)
    got = np.frombuffer(body, "<f4", w * h * d * n).reshape(d, h, w, n)
    return got[..., 0] if n == 1 else got


def parse_png(data: bytes) -> np.ndarray:
    """Brightness, 0 to 255 (or 65535), of a PNG without interlacing: grey levels as they are, colours by their mean."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed = 8, []
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or laced:
        raise ValueError("only grey and true colours of 8 or 16 bits without interlacing")
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * step)
    out, above = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for y, row in enumerate(rows):
        line = row[1:].copy()
        if row[0] == 2:
            line += above
        elif row[0] == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif row[0]:
            for x in range(len(line)):
                left, up, corner = (int(line[x - step]), int(above[x]), int(above[x - step])) if x >= step else (0, int(above[x]), 0)
                if row[0] == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    image = out.view(">u2" if depth == 16 else np.uint8).reshape(h, w, channels)
    return image[..., : channels - (channels % 2 == 0)].astype(float).mean(axis=2)

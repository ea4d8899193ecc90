"""Contents of binary surface files: from bytes to arrays. A file is unpacked by one task."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np

XYZ, NORMAL, COLOUR = ("x", "y", "z"), ("nx", "ny", "nz"), ("red", "green", "blue")


@dataclass
class Raw:
    """Points (n x 3), cells by kind, and what a file says of its points."""

    xyz: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))
    cells: list[tuple[str, list[int]]] = field(default_factory=list)
    scalar: np.ndarray | None = None
    normal: np.ndarray | None = None
    uv: np.ndarray | None = None
    rgb: np.ndarray | None = None

    def checked(self) -> Raw:
        """Without point data of another length than the points."""
        for name in ("scalar", "normal", "uv", "rgb"):
            if (x := getattr(self, name)) is not None and len(x) != len(self.xyz):
                setattr(self, name, None)
        return self


def cut(flat: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Lists of ids by where each one ends."""
    ids = flat.tolist()
    return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def parse_stl(raw: bytes) -> Raw:
    """Corners of the triangles of a binary or text STL, unwelded."""
    if len(raw) >= 84 and len(raw) == 84 + 50 * struct.unpack_from("<I", raw, 80)[0]:
        rows = np.frombuffer(raw, np.dtype([("n", "<3f4"), ("v", "<9f4"), ("a", "<u2")]), offset=84)
        xyz = rows["v"].reshape(-1, 3).astype(float)
    else:
        xyz = np.array(re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", raw), dtype=float).reshape(-1, 3)
    return Raw(xyz, [("polys", p) for p in np.arange(len(xyz)).reshape(-1, 3).tolist()])


#: Fixed: number types of PLY headers.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
#: Fixed: names of texture coordinates in PLY headers.
PLY_TEXTURE = (("u", "v"), ("s", "t"), ("texture_u", "texture_v"))


def parse_ply(raw: bytes) -> Raw:
    """Points with normals, colours and texture, and faces of an ascii or binary PLY; other elements and properties are skipped."""
    end = re.search(rb"end_header\r?\n", raw)
    if not end:
        raise ValueError("no end of the PLY header")
    body, lines = raw[end.end() :], [x.split() for x in raw[: end.start()].decode("ascii", "replace").splitlines()]
    form = next(x[1] for x in lines if x and x[0] == "format")
    elements: list[tuple[str, int, list[list[str]]]] = []
    for x in lines:
        if x and x[0] == "element":
            elements.append((x[1], int(x[2]), []))
        elif x and x[0] == "property":
            elements[-1][2].append(x[1:])
    words, at, order = iter(body.split()) if form == "ascii" else None, 0, ">" if form == "binary_big_endian" else "<"
    out = Raw()

    def vertices(get, names) -> None:
        table = lambda some, kind=float: np.column_stack([np.asarray(get(c), kind) for c in some])
        out.xyz = table(XYZ).reshape(-1, 3)
        out.normal = table(NORMAL) if {*NORMAL} <= names else None
        out.rgb = table(COLOUR, np.int64) if {*COLOUR} <= names else None
        out.uv = next((table(t) for t in PLY_TEXTURE if {*t} <= names), None)

    for name, n, props in elements:
        if words is None and all(p[0] != "list" for p in props):
            kind = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in props])
            rows = np.frombuffer(body, kind, n, at)
            at += n * kind.itemsize
            if name == "vertex":
                vertices(rows.__getitem__, {p[1] for p in props})
            continue
        values = []
        for _ in range(n):
            row: dict[str, object] = {}
            for p in props:
                if words is not None:
                    row[p[-1]] = [int(next(words)) for _ in range(int(next(words)))] if p[0] == "list" else float(next(words))
                elif p[0] == "list":
                    size, item = np.dtype(order + PLY_TYPES[p[1]]), np.dtype(order + PLY_TYPES[p[2]])
                    k = int(np.frombuffer(body, size, 1, at)[0])
                    row[p[-1]] = np.frombuffer(body, item, k, at + size.itemsize).tolist()
                    at += size.itemsize + k * item.itemsize
                else:
                    item = np.dtype(order + PLY_TYPES[p[0]])
                    row[p[-1]] = float(np.frombuffer(body, item, 1, at)[0])
                    at += item.itemsize
            values.append(row)
        if name == "vertex":
            vertices(lambda c, values=values: [r[c] for r in values], {p[-1] for p in props})
        elif name == "face":
            out.cells = [("polys", [int(i) for i in r.get("vertex_indices", r.get("vertex_index", []))]) for r in values]
    return out


#: Fixed: number types of the legacy format; binary values are big-endian. Sections of cells and the kinds of their cells.
VTK_TYPES = {"float": ">f4", "double": ">f8", "int": ">i4", "long": ">i8", "vtktypeint64": ">i8", "vtkidtype": ">i4", "unsigned_int": ">u4", "short": ">i2", "unsigned_short": ">u2", "char": ">i1", "unsigned_char": ">u1", "unsigned_long": ">u8"}
VTK_CELLS = {"VERTICES": "verts", "LINES": "lines", "POLYGONS": "polys", "TRIANGLE_STRIPS": "strips"}


class Legacy:
    """A cursor over a legacy file: heading lines, and numbers as text or big-endian."""

    def __init__(self, raw: bytes):
        head = raw.split(b"\n", 3)
        if len(head) < 4:
            raise ValueError("no legacy VTK header")
        self.raw, self.at, self.binary = raw, len(raw) - len(head[3]), head[2].strip().upper() == b"BINARY"

    def line(self) -> list[str]:
        """Words of the next line that isn't blank; none at the end."""
        while self.at < len(self.raw):
            end = self.raw.find(b"\n", self.at)
            end = len(self.raw) if end < 0 else end
            words, self.at = self.raw[self.at : end].split(), end + 1
            if words:
                return [w.decode("latin-1") for w in words]
        return []

    def numbers(self, n: int, kind: str) -> np.ndarray:
        if self.binary:
            dtype = np.dtype(VTK_TYPES[kind.lower()])
            out = np.frombuffer(self.raw, dtype, n, self.at)
            self.at += n * dtype.itemsize
            return out.astype(float if dtype.kind == "f" else np.int64)
        words = self.raw[self.at :].split(None, n)
        self.at = len(self.raw) - (len(words[n]) if len(words) > n else 0)
        return np.array(words[:n], float if kind.lower() in ("float", "double") else np.int64)

    def cells(self, n: int, size: int) -> list[list[int]]:
        """Classic lists (count, ids ...) or, by the newer version, offsets and connectivity."""
        before, words = self.at, self.line()
        if words[:1] == ["OFFSETS"]:
            ends = self.numbers(n, words[1])
            return cut(self.numbers(size, self.line()[1]), ends[1:])
        self.at = before
        flat, at, out = self.numbers(size, "int").tolist(), 0, []
        while at < size:
            out.append(flat[at + 1 : at + 1 + flat[at]])
            at += 1 + flat[at]
        return out


def parse_vtk(raw: bytes) -> Raw:
    """Points, cells of all kinds, and scalars, normals, texture and colours of the points of legacy polydata, ascii or binary."""
    out, file, of_points, n = Raw(), Legacy(raw), False, 0
    while words := file.line():
        key = words[0].upper()
        if key == "POINTS":
            out.xyz = file.numbers(3 * int(words[1]), words[2]).astype(float).reshape(-1, 3)
        elif key in VTK_CELLS:
            out.cells += [(VTK_CELLS[key], p) for p in file.cells(int(words[1]), int(words[2]))]
        elif key in ("POINT_DATA", "CELL_DATA"):
            of_points, n = key == "POINT_DATA", int(words[1])
        elif key == "SCALARS":
            k, before = int(words[3]) if len(words) > 3 else 1, file.at
            if file.line()[:1] != ["LOOKUP_TABLE"]:
                file.at = before
            values = file.numbers(n * k, words[2]).reshape(n, k)
            if of_points and words[2].lower() == "unsigned_char" and k == 3:
                out.rgb = values
            elif of_points and out.scalar is None:
                out.scalar = values[:, 0].astype(float)
        elif key == "COLOR_SCALARS":
            k = int(words[2])
            values = file.numbers(n * k, "unsigned_char" if file.binary else "double").reshape(n, k)
            if of_points and k >= 3:
                out.rgb = values[:, :3] if file.binary else np.floor(values[:, :3] * 255 + 0.5)
        elif key in ("NORMALS", "VECTORS", "TENSORS"):
            values = file.numbers(n * (9 if key == "TENSORS" else 3), words[2])
            if of_points and key == "NORMALS":
                out.normal = values.reshape(n, 3)
        elif key == "TEXTURE_COORDINATES":
            values = file.numbers(n * int(words[2]), words[3]).reshape(n, -1)
            if of_points and values.shape[1] >= 2:
                out.uv = values[:, :2]
        elif key == "LOOKUP_TABLE":
            file.numbers(4 * int(words[2]), "unsigned_char" if file.binary else "double")
        elif key == "FIELD":
            for _ in range(int(words[2])):
                _, k, m, kind = file.line()
                file.numbers(int(k) * int(m), kind)
        elif key == "METADATA":
            end = re.compile(rb"\r?\n[ \t]*\r?\n").search(raw, file.at)
            file.at = end.end() if end else len(raw)
    return out.checked()


#: Fixed: number types of XML files.
VTP_TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}


class Xml:
    """An XML file with ascii, inline base64 or appended arrays, packed by zlib or not."""

    def __init__(self, raw: bytes):
        start = re.search(rb'<AppendedData[^>]*encoding="(\w+)"[^>]*>\s*_', raw)
        self.coded = bool(start) and start[1] == b"base64"
        self.appended = raw[start.end() :] if start else b""
        self.root = ElementTree.fromstring(raw[: start.start()] + b"</VTKFile>" if start else raw)
        self.order = ">" if self.root.get("byte_order") == "BigEndian" else "<"
        self.head = np.dtype(self.order + VTP_TYPES[self.root.get("header_type", "UInt32")])
        self.packed = self.root.get("compressor")
        if self.packed not in (None, "", "vtkZLibDataCompressor"):
            raise ValueError(f"compressor {self.packed}")

    def array(self, node) -> np.ndarray:
        kind = np.dtype(self.order + VTP_TYPES[node.get("type")])
        if node.get("format", "ascii") == "ascii":
            return np.array((node.text or "").split(), float if kind.kind == "f" else np.int64)
        inline = node.get("format") == "binary"
        data = (node.text or "").strip().encode() if inline else self.appended[int(node.get("offset", 0)) :]
        return np.frombuffer(self.block(data, inline or self.coded), kind).astype(float if kind.kind == "f" else np.int64)

    def block(self, data: bytes, coded: bool) -> bytes:
        w = self.head.itemsize
        length = lambda n: -(-n // 3) * 4 if coded else n
        take = lambda at, n: base64.b64decode(data[at : at + length(n)])[:n] if coded else data[at : at + n]
        numbers = lambda at, n: np.frombuffer(take(at, n * w), self.head, n).tolist()
        if not self.packed:
            (n,) = numbers(0, 1)
            joint = coded and b"=" not in data[: length(w)]  # length and values coded in one go
            return take(0, w + n)[w:] if joint else take(length(w), n)
        (blocks,) = numbers(0, 1) if not coded else np.frombuffer(base64.b64decode(data[: length(3 * w)])[:w], self.head).tolist()
        if not blocks:
            return b""
        sizes = numbers(0, 3 + blocks)[3:]
        rest, at, out = take(length((3 + blocks) * w), sum(sizes)), 0, []
        for size in sizes:
            out.append(zlib.decompress(rest[at : at + size]))
            at += size
        return b"".join(out)


def parse_vtp(raw: bytes) -> Raw:
    """Points, cells of all kinds, and scalars, normals and texture of the points of XML polydata; pieces follow each other."""
    file, out, more = Xml(raw), [], {"scalar": [], "normal": [], "uv": []}
    cells, before = [], 0
    for piece in file.root.iter("Piece"):
        node = piece.find("Points/DataArray")
        xyz = file.array(node).astype(float).reshape(-1, 3) if node is not None else np.empty((0, 3))
        for section, kind in (("Verts", "verts"), ("Lines", "lines"), ("Polys", "polys"), ("Strips", "strips")):
            ids, ends = (piece.find(f"{section}/DataArray[@Name='{name}']") for name in ("connectivity", "offsets"))
            if ids is not None and ends is not None:
                cells += [(kind, p) for p in cut(file.array(ids) + before, file.array(ends))]
        data = piece.find("PointData")
        for name, role in (("scalar", "Scalars"), ("normal", "Normals"), ("uv", "TCoords")):
            node = data.find(f"DataArray[@Name='{data.get(role)}']") if data is not None and data.get(role) else None
            if node is not None:
                values = file.array(node).astype(float).reshape(len(xyz), -1)
                more[name].append(values[:, 0] if name == "scalar" else values[:, : 3 if name == "normal" else 2])
        out.append(xyz)
        before += len(xyz)
    return Raw(np.concatenate(out) if out else np.empty((0, 3)), cells, **{k: np.concatenate(v) for k, v in more.items() if v}).checked()


def parse_wrl(raw: bytes) -> Raw:
    """Points and polygons of the last shape of a VRML 2 text; a shape without faces gives its points."""
    text = raw.decode("utf-8", "replace")
    numbers = lambda s: re.findall(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?", s)
    places = [*re.finditer(r"\bpoint\s*\[([^\]]*)\]", text)]
    faces = re.compile(r"\bcoordIndex\s*\[([^\]]*)\]").search(text, places[-1].end()) if places else None
    polys: list[list[int]] = [[]]
    for i in map(int, numbers(faces[1]) if faces else []):
        if i < 0:
            polys.append([])
        else:
            polys[-1].append(i)
    return Raw(np.array(numbers(places[-1][1]) if places else [], float).reshape(-1, 3), [("polys", p) for p in polys if p])

"""Writers of surfaces. Each format is a table of ordered lines or packed rows; a file is made by one task, as the formats demand."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Mesh, Scene, cloud
from ..sharing import numbered

XYZ, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")


def short(x: Column, digits: int = 8) -> Column:
    """A number as C's %.<digits>g: scientific below 1e-5 and from 10^digits on, without trailing zeros."""
    sci = F.format_string(f"%.{digits - 1}e", x)
    power = F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")
    part = F.regexp_replace(F.regexp_replace(F.regexp_extract(sci, r"^([^e]*)", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.lit("0")
    for p in range(-4, digits):
        plain = F.when(power == p, F.format_string(f"%.{digits - 1 - p}f", x)).otherwise(plain)
    plain = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(x == 0, F.lit("0")).when((power < -4) | (power >= digits), F.concat(part, F.lit("e"), F.format_string("%+03d", power))).otherwise(plain)


def save_file(rows: DataFrame, path: str, *order: str) -> None:
    """Column ``value`` (binary) as one file, in order; it appears under its name when it is whole, in place of one that was there.

    A surface format is one file, so one task writes it as a stream; the sort before it is spread and may spill. Each attempt of
    the task has a draft of its own; the driver gives the name to the one whose attempt counts and removes the others.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = files.makeQualified(at).toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    folder = f"{uri}.{uuid.uuid4().hex}.tmp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = fs.FileSystem.from_uri(folder)
        files.create_dir(name, recursive=True)
        draft, n = uuid.uuid4().hex, 0
        with files.open_output_stream(f"{name}/{draft}", compression=None) as out:
            for batch in batches:
                for value in batch.column(0):
                    n += out.write(value.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([draft]), pa.array([n], pa.int64())], ["draft", "n"])

    drafts = rows.orderBy(*order).select("value").coalesce(1).mapInArrow(run, "draft string, n long").collect()  # one row
    held = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files.delete(at, False)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{drafts[0]['draft']}"), at):
        raise OSError(f"can't move the file to {path}")
    files.delete(held, True)


def save_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Column ``value`` (text) as the lines of one file, in order."""
    save_file(lines.withColumn("value", F.encode(F.concat("value", F.lit("\n")), "utf-8")), path, *order)


def raw_lines(mesh: Mesh, normals: bool = True, scalars: bool = True) -> DataFrame:
    """(pid, value): x y z [normal] [scalar] with eight digits."""
    columns = [*XYZ, *(NORMAL if normals and mesh.has_normals else ()), *(("scalar",) if scalars and mesh.has_scalar else ())]
    return mesh.points.select("pid", F.concat_ws(" ", *(short(F.col(c).cast("double")) for c in columns)).alias("value"))


def _lines(*parts: tuple[int, DataFrame]) -> DataFrame:
    """Lines (k, value) of parts in order."""
    out = None
    for part, df in parts:
        rows = df.select(F.lit(part).alias("part"), F.col("k").cast("long").alias("k"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _heading(mesh: Mesh, values: list[str]) -> DataFrame:
    return mesh.points.sparkSession.createDataFrame(list(enumerate(values)), "k long, value string")


def _joined(*columns) -> Column:
    return F.concat_ws(" ", *(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in columns))


def obj_lines(mesh: Mesh) -> DataFrame:
    parts = [(0, mesh.points.select(F.col("pid").alias("k"), _joined(F.lit("v"), *XYZ).alias("value")))]
    if mesh.has_normals:
        parts.append((1, mesh.points.select(F.col("pid").alias("k"), _joined(F.lit("vn"), *NORMAL).alias("value"))))
    faces = mesh.cells.where("kind = 'polys'").select(F.col("cid").alias("k"), F.concat(F.lit("f "), F.concat_ws(" ", F.transform("pids", lambda p: (p + 1).cast("string")))).alias("value"))
    return _lines(*parts, (2, faces))


def _faces(mesh: Mesh) -> DataFrame:
    return mesh.cells.where("kind = 'polys'").select(F.col("cid").alias("k"), F.concat(F.size("pids").cast("string"), F.lit(" "), F.concat_ws(" ", F.transform("pids", lambda p: p.cast("string")))).alias("value"), F.size("pids").alias("n"))


#: Fixed: sections of the legacy and the XML format for the kinds of cells, in their order.
SECTIONS = {"verts": ("VERTICES", "Verts"), "lines": ("LINES", "Lines"), "polys": ("POLYGONS", "Polys"), "strips": ("TRIANGLE_STRIPS", "Strips")}


def _of(mesh: Mesh, *columns: str) -> DataFrame:
    """(k, value): columns of the points as text."""
    return mesh.points.select(F.col("pid").alias("k"), _joined(*columns).alias("value"))


def packed(df: DataFrame, key: str, columns: list[str], kinds: list[str]) -> DataFrame:
    """(k, value): the columns of each row as binary numbers of the numpy types ``kinds``; arrays follow their length, which has the type before the comma."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for c, kind in zip(columns, kinds, strict=True):
                values, (*size, item) = batch.column(names.index(c)).to_pylist(), kind.split(",")
                parts.append([(np.array(len(v), size[0]).tobytes() if size else b"") + np.array(v, item).tobytes() for v in values])
            yield pa.RecordBatch.from_arrays([batch.column(names.index(key)), pa.array([b"".join(x) for x in zip(*parts, strict=True)], pa.binary())], ["k", "value"])

    return df.mapInArrow(run, "k long, value binary")


def _binary(*parts: tuple[int, DataFrame]) -> DataFrame:
    """Rows (part, k, value binary) of parts in order; text parts are lines."""
    out = None
    for part, df in parts:
        if dict(df.dtypes)["value"] == "string":
            df = df.withColumn("value", F.encode(F.concat("value", F.lit("\n")), "utf-8"))
        rows = df.select(F.lit(part).alias("part"), F.col("k").cast("long").alias("k"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def ply_lines(mesh: Mesh, binary: bool = False) -> DataFrame:
    """Points with normals and colours (whole numbers 0 to 255) and polygons."""
    n, polys = mesh.points.count(), mesh.cells.where("kind = 'polys'")
    more = [*(NORMAL if mesh.has_normals else ())]
    points, colours = mesh.points.select("pid", *XYZ, *more), []
    if "rgb" in mesh.points.columns:
        colours = ["red", "green", "blue"]
        points = mesh.points.select("pid", *XYZ, *more, *(F.coalesce(F.get("rgb", F.lit(i)), F.lit(0)).cast("int").alias(c) for i, c in enumerate(colours)))
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {n}", *(f"property double {c}" for c in (*XYZ, *more)), *(f"property uchar {c}" for c in colours)]
    head = _heading(mesh, [*head, f"element face {polys.count()}", "property list uchar int vertex_indices", "end_header"])
    columns = [*XYZ, *more, *colours]
    if binary:
        kinds = ["<f8"] * (len(columns) - len(colours)) + ["u1"] * len(colours)
        return _binary((0, head), (1, packed(points, "pid", columns, kinds)), (2, packed(polys.select("cid", "pids"), "cid", ["pids"], ["u1,<i4"])))
    return _lines((0, head), (1, points.select(F.col("pid").alias("k"), _joined(*columns).alias("value"))), (2, _faces(mesh)))


def _cells(mesh: Mesh, kind: str) -> DataFrame:
    """(cid, pids, n) of the cells of a kind."""
    return mesh.cells.where(F.col("kind") == kind).select("cid", "pids", F.size("pids").alias("n"))


def vtk_lines(mesh: Mesh, binary: bool = False) -> DataFrame:
    """Points, cells of all kinds, and scalars, normals and texture of the points as legacy polydata."""
    n = mesh.points.count()
    parts = [(0, _heading(mesh, ["# vtk DataFile Version 3.0", "surface", "BINARY" if binary else "ASCII", "DATASET POLYDATA", f"POINTS {n} double"]))]

    def add(rows: DataFrame, key: str, columns: list[str], kinds: list[str], text: Column) -> None:
        """A table of numbers; binary ones end with a line end."""
        if binary:
            parts.append((len(parts), packed(rows, key, columns, kinds)))
            parts.append((len(parts), _heading(mesh, [""])))
        else:
            parts.append((len(parts), rows.select(F.col(key).alias("k"), text.alias("value"))))

    add(mesh.points.select("pid", *XYZ), "pid", [*XYZ], [">f8"] * 3, _joined(*XYZ))
    for kind, (section, _) in SECTIONS.items():
        cells = _cells(mesh, kind)
        count = cells.agg(F.count("*"), F.coalesce(F.sum(F.col("n") + 1), F.lit(0))).first()
        if count[0]:
            parts.append((len(parts), _heading(mesh, [f"{section} {count[0]} {count[1]}"])))
            add(cells, "cid", ["pids"], [">i4,>i4"], F.concat_ws(" ", F.col("n").cast("string"), F.transform("pids", lambda p: p.cast("string"))))
    data = [(True, ["scalar"], ["SCALARS scalar double 1", "LOOKUP_TABLE default"])] if mesh.has_scalar else []
    data += [(True, [*NORMAL], ["NORMALS normals double"])] if mesh.has_normals else []
    data += [(True, ["u", "v"], ["TEXTURE_COORDINATES tcoords 2 double"])] if mesh.has_texture else []
    for i, (_, columns, heading) in enumerate(data):
        parts.append((len(parts), _heading(mesh, [f"POINT_DATA {n}"][i:] + heading)))
        add(mesh.points.select("pid", *(F.col(c).cast("double").alias(c) for c in columns)), "pid", columns, [">f8"] * len(columns), _joined(*columns))
    return (_binary if binary else _lines)(*parts)


def vtp_lines(mesh: Mesh) -> DataFrame:
    """Points, cells of all kinds, and scalars, normals and texture of the points as XML polydata."""
    array = lambda kind, name, more="": f'<DataArray type="{kind}" Name="{name}" format="ascii"{more}>'
    counts = {r["kind"]: r["count"] for r in mesh.cells.groupBy("kind").count().collect()}
    data = [("Scalars", "scalar", ["scalar"])] if mesh.has_scalar else []
    data += [("Normals", "normals", [*NORMAL])] if mesh.has_normals else []
    data += [("TCoords", "tcoords", ["u", "v"])] if mesh.has_texture else []
    sizes = " ".join(f'NumberOf{name}="{counts.get(kind, 0)}"' for kind, (_, name) in SECTIONS.items())
    roles = "".join(f' {role}="{name}"' for role, name, _ in data)
    parts = [(0, _heading(mesh, ['<?xml version="1.0"?>', '<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian">', "<PolyData>", f'<Piece NumberOfPoints="{mesh.points.count()}" {sizes}>', f"<PointData{roles}>"]))]
    for _, name, columns in data:
        parts += [(len(parts), _heading(mesh, [array("Float64", name, f' NumberOfComponents="{len(columns)}"')])), (len(parts) + 1, _of(mesh, *columns)), (len(parts) + 2, _heading(mesh, ["</DataArray>"]))]
    parts += [(len(parts), _heading(mesh, ["</PointData>", "<Points>", array("Float64", "Points", ' NumberOfComponents="3"')])), (len(parts) + 1, _of(mesh, *XYZ)), (len(parts) + 2, _heading(mesh, ["</DataArray>", "</Points>"]))]
    for kind, (_, name) in SECTIONS.items():
        cells = numbered(_cells(mesh, kind), "_i", "cid")
        ids = cells.select(F.col("cid").alias("k"), F.concat_ws(" ", F.transform("pids", lambda p: p.cast("string"))).alias("value"))
        ends = _running(cells).select(F.col("cid").alias("k"), F.col("end").cast("string").alias("value"))
        parts += [(len(parts), _heading(mesh, [f"<{name}>", array("Int64", "connectivity")])), (len(parts) + 1, ids), (len(parts) + 2, _heading(mesh, ["</DataArray>", array("Int64", "offsets")])), (len(parts) + 3, ends), (len(parts) + 4, _heading(mesh, ["</DataArray>", f"</{name}>"]))]
    return _lines(*parts, (len(parts), _heading(mesh, ["</Piece>", "</PolyData>", "</VTKFile>"])))


#: Cells of a block whose sizes are summed in one window.
BLOCK_CELLS = 10_000


def _running(cells: DataFrame) -> DataFrame:
    """(cid, end): running sums of the sizes ``n`` by number ``_i``, from blocks; only one row a block meets in one window."""
    rows = cells.withColumn("_b", F.floor(F.col("_i") / BLOCK_CELLS))
    before = rows.groupBy("_b").agg(F.sum("n").alias("s")).withColumn("_before", F.sum("s").over(Window.orderBy("_b")) - F.col("s"))
    within = F.sum("n").over(Window.partitionBy("_b").orderBy("_i"))
    return rows.withColumn("_within", within).join(before.select("_b", "_before"), "_b").select("cid", (F.col("_before") + F.col("_within")).alias("end"))


def stl_lines(mesh: Mesh, binary: bool = False) -> DataFrame:
    """Triangles with their own normals."""
    t = mesh.placed_triangles()
    a, b, c = (g.vector(k + "x", k + "y", k + "z") for k in "abc")
    n = g.normalised(g.cross(g.sub(b, a), g.sub(c, a)))
    if binary:
        values = t.select("cid", F.array(*n, *a, *b, *c).alias("v"), F.lit(0).alias("_0"))
        head = mesh.points.sparkSession.createDataFrame([(0, b"facetlake binary surface".ljust(80) + struct.pack("<I", t.count()))], "k long, value binary")
        return _binary((0, head), (1, packed(values, "cid", ["v", "_0"], ["<f4", "<u2"])))
    corner = [F.concat(F.lit("vertex "), _joined(*p)) for p in (a, b, c)]
    facet = F.concat_ws("\n", F.concat(F.lit("facet normal "), _joined(*n)), F.lit("outer loop"), *corner, F.lit("endloop"), F.lit("endfacet"))
    rows = t.select(F.col("cid").alias("k"), facet.alias("value"))
    return _lines((0, _heading(mesh, ["solid surface"])), (1, rows), (2, _heading(mesh, ["endsolid surface"])))


WRITERS = {"obj": obj_lines, "ply": ply_lines, "vtk": vtk_lines, "vtp": vtp_lines, "stl": stl_lines}
BINARY = ("ply", "vtk", "stl")


def write_surface(mesh: Mesh, path: str, kind: str, matrix=None, normals: bool = True, scalars: bool = True, binary: bool = False) -> None:
    """A surface as one file in the format ``kind``, placed by ``matrix`` where given; ``txt`` has raw rows.

    ``binary`` counts for ply, vtk and stl; the others are text. obj, ply and stl hold polygons only, vtk and vtp all cells.
    """
    if matrix is not None:
        from ..operators.project import apply_transform

        mesh = apply_transform(mesh, matrix)
    mesh = mesh if normals or not mesh.has_normals else mesh.drop_normals()
    mesh = mesh if scalars or not mesh.has_scalar else mesh.drop_scalar()
    if kind == "txt":
        save_lines(raw_lines(mesh), path, "pid")
    elif binary and kind in BINARY:
        save_file(WRITERS[kind](mesh, binary=True), path, "part", "k")
    elif kind in WRITERS:
        save_lines(WRITERS[kind](mesh), path, "part", "k")
    else:
        raise ValueError(f"no writer for .{kind}")


def write_scene(scene: Scene, path: str, kind: str, **options) -> None:
    """All surfaces of a scene, each placed by its matrix, as one file."""
    from ..operators.project import apply_transform
    from ..operators.sets import append

    meshes = [apply_transform(s.mesh, s.matrix) for s in scene.surfaces.values()]
    if not meshes:
        raise ValueError("an empty scene")
    write_surface(reduce(append, meshes), path, kind, **options)


def write_plane(spark, path: str, corners) -> None:
    """Origin and two points as a file of three points with a vertex each."""
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(corners)], "pid long, x double, y double, z double")
    write_surface(cloud(points), path, "vtk")


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Rows of a matrix (r, c, value) as text, one line a row."""
    save_lines(matrix_lines(matrix), path, "r")


def write_matrix_array(matrix: DataFrame, path: str) -> None:
    """A matrix (r, c, value) in the public layout of dense arrays: a heading, sizes, then values column by column."""
    size = matrix.agg(F.max("r"), F.max("c"), F.count("*")).first()
    head = matrix.sparkSession.createDataFrame([(0, -1, f"vtkArray dense double 2\nDENSE\n{size[0] + 1} {size[1] + 1}")], "c int, r int, value string")
    rows = matrix.select(F.col("c").cast("int").alias("c"), F.col("r").cast("int").alias("r"), F.col("value").cast("string").alias("value"))
    save_lines(head.unionByName(rows.withColumn("c", F.col("c") + 1)), path, "c", "r")


def write_numbers(values: DataFrame, path: str) -> None:
    """Numbers (i, value) as text, one a line."""
    save_lines(values.select("i", F.col("value").cast("string").alias("value")), path, "i")


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """(r, value): rows of a matrix (r, c, value)."""
    return matrix.groupBy("r").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("c", "value"))), lambda x: x["value"].cast("string"))).alias("value"))


def write_polygon_2d(polygon: DataFrame, path: str, by: list[str]) -> None:
    """Rows ``x, y`` of polygons in their own planes."""
    from ..operators.project import polygon_2d

    save_lines(polygon_2d(polygon, by).select(*by, "ord", F.concat_ws(", ", F.col("px").cast("string"), F.col("py").cast("string")).alias("value")), path, *by, "ord")

"""Readers of surface files. Text formats are scans with relational steps; binary ones are unpacked by tasks from whole files.

A path may name one file or a folder of many; every reader also returns ``surface_id``, the file's path, where it says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..model import Mesh, Scene, cloud
from ..operators.clip import first_stop
from ..sharing import numbered, settled
from . import formats
from .formats import Raw

XYZ, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")
#: Fixed: columns of delimited rows by their number.
LAYOUTS = {3: [*XYZ], 4: [*XYZ, "scalar"], 6: [*XYZ, *NORMAL], 7: [*XYZ, *NORMAL, "scalar"], 9: [*XYZ, *NORMAL, "r", "g", "b"]}


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the numbered lines of one text file. A last line without a line end counts.

    Files of this kind are small; one is read by one task, as lines have no numbers of their own to sort by.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("line", "value"), F.size(F.split("value", "\n")).alias("_n"))
    return lines.where((F.col("line") < F.col("_n") - 1) | (F.col("value") != "")).select("line", "value")


def delimiter(line: str) -> str:
    """The first of comma, semicolon and tab that a line has, else space."""
    return next((d for d in ",;\t" if d in line), " ")


def _fields(value: Column, by: str) -> Column:
    return F.filter(F.split(F.trim(value), "[" + ("\\t" if by == "\t" else by) + "]"), lambda x: F.trim(x) != "")


def read_delimited(spark: SparkSession, path: str, kind: str = "txt") -> Mesh:
    """Points from delimited text: 3, 4, 6, 7 or 9 columns, or, for ``bnd`` and ``pse``, an id and three.

    The first line's number of columns counts; reading stops at the first line with another, and for ``pse`` at the first with an
    ``n``. ValueError for other numbers and for files without points. Colours are values times 255, cut to whole numbers;
    normals are made unit, and left out where the first one is zero.
    """
    lines = text_lines(spark, path)
    if kind == "pse":
        lines = first_stop(lines, F.contains("value", F.lit("n")))
    top = lines.where(F.trim("value") != "").orderBy("line").first()
    if top is None:
        raise ValueError(f"{path}: no points")
    by = delimiter(top["value"])
    rows = lines.select("line", F.transform(_fields(F.col("value"), by), lambda x: F.trim(x).try_cast("double")).alias("f"))
    n = rows.where(F.col("line") == top["line"]).select(F.size("f")).first()[0]
    names = ["_id", *XYZ] if kind in ("bnd", "pse") and n == 4 else LAYOUTS.get(n)
    if names is None or kind in ("bnd", "pse") and n != 4:
        raise ValueError(f"{path}: {n} columns")
    rows = first_stop(rows.where(F.col("line") >= top["line"]), (F.size("f") != n) | F.exists("f", lambda x: x.isNull()))
    points = rows.select((F.col("line") - top["line"]).cast("long").alias("pid"), *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)))
    if "nx" in names:
        first = points.where("pid = 0").select(g.dot(g.vector(*NORMAL), g.vector(*NORMAL)).alias("s")).first()
        if first and first["s"] == 0:
            points = points.drop(*NORMAL)
        else:
            points = points.withColumns(dict(zip(NORMAL, g.normalised(g.vector(*NORMAL)), strict=True)))
    if "r" in names:
        points = points.withColumn("rgb", F.array(*((F.col(c) * 255).cast("int").cast("smallint") for c in "rgb"))).drop("r", "g", "b")
    return cloud(points.drop("_id"))


def read_landmarks_anno(spark: SparkSession, path: str) -> DataFrame:
    """Landmarks of rows of exactly three numbers: ids from 0, all active, no names."""
    rows = text_lines(spark, path).select("line", tx.numbers_from_string(F.translate("value", ",;\t", "   ")).alias("f")).where("size(f) = 3")
    at = (F.row_number().over(Window.orderBy("line")) - 1).cast("int")  # one small file
    return rows.select(at.alias("lm_pos"), at.alias("id"), *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(XYZ)), F.lit(1).alias("active"), F.lit("").alias("name"))


def read_landmarks_pp(spark: SparkSession, path: str) -> DataFrame:
    """Landmarks of ``<point x= y= z= active= name=>`` elements: ids from 1."""
    whole = spark.read.text(path, wholetext=True)
    tags = whole.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"<point\b([^>]*)>"), 1)).alias("lm_pos", "tag"))
    get = lambda name: F.regexp_extract("tag", rf'\b{name}\s*=\s*"([^"]*)"', 1)
    return tags.select("lm_pos", (F.col("lm_pos") + 1).alias("id"), *(get(c).try_cast("double").alias(c) for c in XYZ), F.coalesce(get("active").try_cast("int"), F.lit(1)).alias("active"), get("name").alias("name"))


def landmarks_mesh(landmarks: DataFrame) -> Mesh:
    return cloud(landmarks.select(F.col("lm_pos").cast("long").alias("pid"), *XYZ, F.col("active").cast("double").alias("scalar")))


def read_doubles(spark: SparkSession, path: str) -> DataFrame:
    """(i, value): one number a line up to the first blank line; ValueError for none."""
    rows = first_stop(text_lines(spark, path), F.trim("value") == "").select(F.col("line").alias("i"), F.trim("value").try_cast("double").alias("value"))
    if not rows.limit(1).count():
        raise ValueError(f"{path}: no numbers")
    return rows


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, value) of a dense 2-D double array in the public text layout: a heading, sizes, then values column by column."""
    words = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)^[^\n]*\n(?:DENSE[^\n]*\n)?(.*)$", 1).alias("v")).select(F.filter(F.split("v", r"\s+"), lambda x: x != "").alias("w"))
    rows = words.select(F.get("w", F.lit(0)).cast("int").alias("_r"), F.posexplode(F.expr("slice(w, 3, size(w))")).alias("k", "value"))
    return rows.select((F.col("k") % F.col("_r")).alias("r"), F.floor(F.col("k") / F.col("_r")).cast("int").alias("c"), F.col("value").cast("double").alias("value"))


def read_obj(spark: SparkSession, path: str) -> Mesh:
    """Points (v), texture (vt, first two numbers), normals (vn) and polygons (f) of an OBJ file.

    A point takes the first texture place and normal, by their order in the file, that a face gives it; points of no face have none.
    """
    lines = settled(_tagged(spark, path))
    points = _counted(lines, "v").select((F.col("k") - 1).alias("pid"), *(F.get("f", F.lit(i)).cast("double").alias(c) for i, c in enumerate(XYZ)))
    corner = _corners(lines)
    cells = corner.groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "p"))), lambda x: x["p"]).alias("pids"))
    mesh = Mesh(points, numbered(cells, "cid", "line").select("cid", F.lit("polys").alias("kind"), "pids"))
    if lines.where("tag = 'vt'").limit(1).count():
        uv = _counted(lines, "vt").select((F.col("k") - 1).alias("t"), *(F.get("f", F.lit(i)).cast("float").alias(c) for i, c in enumerate("uv")))
        of = corner.where("t is not null").groupBy(F.col("p").alias("pid")).agg(F.min("t").alias("t")).join(uv, "t").drop("t")
        mesh = mesh.with_points(mesh.points.join(of, "pid", "left"))
    if corner.where("n is not null").limit(1).count():
        vn = _counted(lines, "vn").select((F.col("k") - 1).alias("n"), *(F.get("f", F.lit(i)).cast("double").alias(c) for i, c in enumerate(NORMAL)))
        of = corner.where("n is not null").groupBy(F.col("p").alias("pid")).agg(F.min("n").alias("n")).join(vn, "n").drop("n")
        mesh = mesh.with_points(mesh.points.join(of, "pid", "left"))
    return mesh


def _tagged(spark: SparkSession, path: str) -> DataFrame:
    """(line, tag, f): first word and the other words of each line."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return text_lines(spark, path).select("line", words.alias("w")).where("size(w) > 0").select("line", F.lower(F.get("w", F.lit(0))).alias("tag"), F.expr("slice(w, 2, size(w))").alias("f"))


def _counted(lines: DataFrame, tag: str) -> DataFrame:
    """Lines of a tag, numbered from 1 (k)."""
    rows = numbered(lines.where(F.col("tag") == tag), "_k", "line")
    return rows.withColumn("k", F.col("_k") + 1).drop("_k")


def _corners(lines: DataFrame) -> DataFrame:
    """(line, ord, p, t, n): 0-based point, texture and normal ids of face corners in the forms p, p/t, p//n and p/t/n."""
    part = lambda i: F.regexp_extract("v", r"^(\d+)(?:/(\d*)(?:/(\d+))?)?", i).try_cast("long") - 1
    return lines.where("tag = 'f'").select("line", F.posexplode("f").alias("ord", "v")).select("line", "ord", part(1).alias("p"), part(2).alias("t"), part(3).alias("n"))


def read_obj_materials(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Meshes of an OBJ by material: points (segment, pid, x, y, z), tcoords (segment, tid, u, v) and cells (segment, cid, material, pids, tids).

    Each ``usemtl`` starts a segment; segments without faces are skipped and the others numbered from 0. Points and texture
    coordinates of a segment are renumbered in the order of their first use. Faces must have three corners.
    """
    lines = settled(_tagged(spark, path))
    runs = lines.where("tag in ('f', 'usemtl')").withColumn("s", F.sum((F.col("tag") == "usemtl").cast("long")).over(Window.orderBy("line")))
    of = runs.where("tag = 'f'").select("line", "s")
    names = runs.where("tag = 'usemtl'").select("s", F.concat_ws(" ", "f").alias("material"))
    filled = of.select("s").distinct().withColumn("segment", F.dense_rank().over(Window.orderBy("s")) - 1)
    corner = settled(_corners(lines).join(of, "line").join(filled, "s").withColumn("seq", F.col("line") * 4 + F.col("ord")))
    if corner.groupBy("line").count().where("count <> 3").limit(1).count():
        raise ValueError(f"{path}: a face without three corners")

    def renumbered(key: str, new: str) -> DataFrame:
        first = corner.where(F.col(key).isNotNull()).groupBy("segment", key).agg(F.min("seq").alias("first"))
        return first.withColumn(new, (F.row_number().over(Window.partitionBy("segment").orderBy("first")) - 1).cast("long")).drop("first")

    p, t = renumbered("p", "pid"), renumbered("t", "tid")
    points = p.join(_counted(lines, "v").select((F.col("k") - 1).alias("p"), *(F.get("f", F.lit(i)).cast("double").alias(c) for i, c in enumerate(XYZ))), "p").select("segment", "pid", *XYZ)
    tcoords = t.join(_counted(lines, "vt").select((F.col("k") - 1).alias("t"), *(F.get("f", F.lit(i)).cast("float").alias(c) for i, c in enumerate("uv"))), "t").select("segment", "tid", "u", "v")
    rows = corner.join(p, ["segment", "p"]).join(t, ["segment", "t"], "left")
    ids = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    faces = rows.groupBy("segment", "s", "line").agg(ids("pid").alias("pids"), ids("tid").alias("tids")).join(names, "s", "left")
    cells = faces.select("segment", (F.row_number().over(Window.partitionBy("segment").orderBy("line")) - 1).cast("long").alias("cid"), "material", "pids", "tids")
    return points, tcoords, cells


def read_mtl(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, filename) of materials with an image; ValueError where none has one."""
    lines = text_lines(spark, path).select("line", F.trim("value").alias("value"))
    named = lines.select("line", tx.token_rest(F.col("value"), "newmtl").alias("new"), tx.token_rest(F.col("value"), "map_kd").alias("file"))
    w = Window.orderBy("line")
    rows = named.select("line", F.last("new", True).over(w).alias("name"), "file").where(F.col("file").isNotNull() & tx.is_image(F.col("file")))
    out = rows.select((F.row_number().over(w) - 1).alias("ord"), "name", F.col("file").alias("filename"))
    if not out.limit(1).count():
        raise ValueError(f"{path}: no image")
    return out


def read_textures(spark: SparkSession, folder: str, materials: DataFrame) -> DataFrame:
    """Materials with the bytes of their images from a folder; null where the file is missing."""
    files = spark.read.format("binaryFile").load(folder).select(tx.without_path(F.col("path")).alias("_f"), F.col("content").alias("image"))
    return materials.join(files, tx.without_path(F.col("filename")) == F.col("_f"), "left").drop("_f")


def sidecar_texture(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """The image beside a surface: the first of stem.png, .tif, .bmp and .jpg that there is."""
    order = F.array_position(F.array(*(F.lit(stem + e) for e in (".png", ".tif", ".bmp", ".jpg"))), tx.without_path(F.col("path")))
    return spark.read.format("binaryFile").load(folder).where(order > 0).orderBy(order).limit(1).select("path", "content")


#: Points of a batch that a reader hands on.
BATCH_POINTS = 100_000
_PARTS = "surface_id string, k long, xyz array<double>, scalar double, normal array<double>, uv array<float>, rgb array<smallint>, kind string, pids array<long>"


def _parts(spark: SparkSession, path: str, parse: Callable[[bytes], Raw]) -> DataFrame:
    """Points (kind null) and cells of binary files; a file is one row and one task's work."""
    types = [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float32()), pa.list_(pa.int16()), pa.string(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in _PARTS.split(", ")]

    def rows(name: str, n: int, first: int, values: dict[str, list]) -> pa.RecordBatch:
        held = {"surface_id": [name] * n, "k": range(first, first + n), **values}
        return pa.RecordBatch.from_arrays([pa.array(held[c], t) if c in held else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = parse(content)
                data = {"xyz": raw.xyz, "scalar": raw.scalar, "normal": raw.normal, "uv": raw.uv, "rgb": raw.rgb}
                for a in range(0, len(raw.xyz), BATCH_POINTS):
                    some = {c: x[a : a + BATCH_POINTS].astype("i2" if c == "rgb" else float).tolist() for c, x in data.items() if x is not None}
                    yield rows(name, len(some["xyz"]), a, some)
                for a in range(0, len(raw.cells), BATCH_POINTS):
                    some = raw.cells[a : a + BATCH_POINTS]
                    yield rows(name, len(some), a, {"kind": [c[0] for c in some], "pids": [c[1] for c in some]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _PARTS)


def _from_parts(parts: DataFrame, path: str) -> Mesh:
    """Points with what the file says of them, and cells; ValueError for a file without points."""
    parts = settled(parts)
    points = parts.where("kind is null")
    has = points.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in ("scalar", "normal", "uv", "rgb"))).first()
    if not has["n"]:
        raise ValueError(f"{path}: no points")
    at = lambda c, i: F.get(c, F.lit(i))
    columns = [F.col("k").alias("pid"), *(at("xyz", i).alias(c) for i, c in enumerate(XYZ))]
    columns += ["scalar"] if has["scalar"] else []
    columns += [at("normal", i).alias(c) for i, c in enumerate(NORMAL)] if has["normal"] else []
    columns += [at("uv", i).alias(c) for i, c in enumerate("uv")] if has["uv"] else []
    columns += ["rgb"] if has["rgb"] else []
    return Mesh(points.select(*columns), parts.where("kind is not null").select(F.col("k").alias("cid"), "kind", "pids"))


def read_stl(spark: SparkSession, path: str) -> Mesh:
    """Triangles with equal corners welded."""
    from ..operators.sets import weld

    return weld(_from_parts(_parts(spark, path, formats.parse_stl), path))


def read_ply(spark: SparkSession, path: str) -> Mesh:
    """Points with normals, colours and texture, and faces; a point cloud has no cells."""
    return _from_parts(_parts(spark, path, formats.parse_ply), path)


def read_vtk(spark: SparkSession, path: str) -> Mesh:
    """Points, cells of all kinds, scalars, normals, texture and colours of legacy polydata."""
    return _from_parts(_parts(spark, path, formats.parse_vtk), path)


def read_vtp(spark: SparkSession, path: str) -> Mesh:
    """Points, cells of all kinds, scalars, normals and texture of XML polydata."""
    return _from_parts(_parts(spark, path, formats.parse_vtp), path)


def read_wrl(spark: SparkSession, path: str) -> Mesh:
    """The last shape of a VRML text."""
    return _from_parts(_parts(spark, path, formats.parse_wrl), path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of a settings JSON."""
    return spark.read.json(path, multiLine=True)


def read_plane(spark: SparkSession, path: str) -> list[tuple[float, float, float]]:
    """Origin and two points of a plane file, which has exactly three points."""
    rows = read_vtk(spark, path).points.orderBy("pid").limit(4).collect()
    if len(rows) != 3:
        raise ValueError(f"{path}: {len(rows)} points")
    return [(r["x"], r["y"], r["z"]) for r in rows]


READERS: dict[str, Callable[[SparkSession, str], Mesh]] = {
    "vtk": read_vtk,
    "vtp": read_vtp,
    "stl": read_stl,
    "obj": read_obj,
    "ply": read_ply,
    "wrl": read_wrl,
    "pp": lambda spark, path: landmarks_mesh(read_landmarks_pp(spark, path)),
    **{kind: (lambda spark, path, kind=kind: read_delimited(spark, path, kind)) for kind in ("dat", "csv", "pts", "txt", "bnd", "pse", "anno")},
}


def read_surface(spark: SparkSession, path: str) -> Mesh:
    """A surface by the extension of its file; ValueError for one that has no reader."""
    kind = path.rpartition(".")[2].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    return READERS[kind](spark, path)


def material_meshes(spark: SparkSession, path: str) -> list[tuple[str, Mesh]]:
    """The meshes of an OBJ by material (name, mesh), texture by point; none where no segment has a material with an image.

    A mesh's points carry the texture place of the first corner that uses them.
    """
    lines = text_lines(spark, path)
    libraries = [r[0] for r in lines.select(tx.token_rest(F.trim("value"), "mtllib").alias("f")).where("f is not null").collect()]
    if not libraries:
        return []
    try:
        read_mtl(spark, path.rpartition("/")[0] + "/" + libraries[0])
        points, tcoords, cells = (settled(x) for x in read_obj_materials(spark, path))
    except (ValueError, AnalysisException):  # no usable materials, or a face that isn't a triangle: a single surface
        return []
    out = []
    for segment, material in cells.groupBy("segment").agg(F.first("material")).orderBy("segment").collect():  # a few materials
        mine = cells.where(F.col("segment") == segment)
        used = mine.select("cid", F.posexplode(F.arrays_zip("pids", "tids")).alias("ord", "s")).select("cid", "ord", F.col("s.pids").alias("pid"), F.col("s.tids").alias("tid"))
        first = used.groupBy("pid").agg(F.min_by("tid", F.struct("cid", "ord")).alias("tid"))
        placed = points.where(F.col("segment") == segment).drop("segment").join(first, "pid", "left")
        placed = placed.join(tcoords.where(F.col("segment") == segment).drop("segment"), "tid", "left").select("pid", *XYZ, "u", "v")
        out.append((material or f"segment {segment}", Mesh(placed, mine.select("cid", F.lit("polys").alias("kind"), "pids"))))
    return out


def read_scene(spark: SparkSession, *paths: str, scene: Scene | None = None) -> Scene:
    """A scene with the surfaces of the files, in order; an OBJ is tried as several meshes by material first, then as one.

    ValueError for a file that no reader takes; surfaces before it are in ``scene`` then.
    """
    scene = scene or Scene()
    for path in paths:
        name = path.rstrip("/").rpartition("/")[2]
        some = material_meshes(spark, path) if name.lower().endswith(".obj") else []
        for material, mesh in some:
            scene.add(f"{name}_{material}", mesh)
        if not some:
            scene.add(name, read_surface(spark, path))
    return scene

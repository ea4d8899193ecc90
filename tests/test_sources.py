"""Readers and writers: files written by hand, and round trips in every format."""

import base64
import struct
import zlib

import numpy as np
import pytest

from facetlake.model import Mesh, Scene, cloud
from facetlake.operators.generate import cube
from facetlake.sources import readers, writers


def points(mesh, *columns):
    return [tuple(r) for r in mesh.points.orderBy("pid").select("x", "y", "z", *columns).collect()]


def cells(mesh):
    return [(r["kind"], list(r["pids"])) for r in mesh.cells.orderBy("cid").collect()]


def saved(tmp_path, name, data):
    at = tmp_path / name
    at.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(at)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, float(i), i * 0.5, -1.25 * i, 0.1 * i, 0.0, 0.6, 0.8, i / 4, i / 8, [i, 2 * i, 255]) for i in range(5)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, scalar double, nx double, ny double, nz double, u float, v float, rgb array<smallint>")
    kinds = [("verts", [4]), ("lines", [0, 1, 2]), ("polys", [0, 1, 2]), ("polys", [0, 2, 3, 4]), ("strips", [0, 1, 2, 3])]
    return Mesh(df, spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(kinds)], "cid long, kind string, pids array<long>"))


@pytest.mark.parametrize("binary", [False, True])
def test_vtk_round_trip(spark, tmp_path, mixed, binary):
    writers.write_surface(mixed, f"{tmp_path}/a.vtk", "vtk", binary=binary)
    back = readers.read_surface(spark, f"{tmp_path}/a.vtk")
    some = ("scalar", "nx", "ny", "nz", "u", "v")
    assert points(back, *some) == points(mixed, *some) and cells(back) == cells(mixed)


def test_vtp_round_trip(spark, tmp_path, mixed):
    writers.write_surface(mixed, f"{tmp_path}/a.vtp", "vtp")
    back = readers.read_surface(spark, f"{tmp_path}/a.vtp")
    some = ("scalar", "nx", "ny", "nz", "u", "v")
    assert points(back, *some) == points(mixed, *some) and cells(back) == cells(mixed)


@pytest.mark.parametrize("binary", [False, True])
def test_ply_round_trip(spark, tmp_path, mixed, binary):
    writers.write_surface(mixed, f"{tmp_path}/a.ply", "ply", binary=binary)
    back = readers.read_surface(spark, f"{tmp_path}/a.ply")
    assert points(back, "nx", "ny", "nz", "rgb") == points(mixed, "nx", "ny", "nz", "rgb")
    assert cells(back) == [c for c in cells(mixed) if c[0] == "polys"]


@pytest.mark.parametrize("binary", [False, True])
def test_stl_round_trip(spark, tmp_path, binary):
    box = cube(spark)
    writers.write_surface(box, f"{tmp_path}/a.stl", "stl", binary=binary)
    back = readers.read_surface(spark, f"{tmp_path}/a.stl")
    assert back.cells.count() == 12 and back.points.count() == 8
    assert set(points(back)) == set(points(box))


def test_obj_round_trip(spark, tmp_path, mixed):
    writers.write_surface(mixed, f"{tmp_path}/a.obj", "obj")
    back = readers.read_surface(spark, f"{tmp_path}/a.obj")
    assert points(back) == points(mixed) and cells(back) == [c for c in cells(mixed) if c[0] == "polys"]


def test_text_round_trip(spark, tmp_path, mixed):
    writers.write_surface(mixed, f"{tmp_path}/a.txt", "txt")
    back = readers.read_surface(spark, f"{tmp_path}/a.txt")
    assert np.allclose(points(back, "nx", "ny", "nz", "scalar"), points(mixed, "nx", "ny", "nz", "scalar"))


def test_points_only_and_empty(spark, tmp_path):
    loose = cloud(spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "pid long, x double, y double, z double"))
    for kind in ("vtk", "vtp", "ply", "obj"):
        writers.write_surface(loose, f"{tmp_path}/p.{kind}", kind)
        assert points(readers.read_surface(spark, f"{tmp_path}/p.{kind}")) == [(1, 2, 3), (4, 5, 6)]
    none = saved(tmp_path, "none.vtk", "# vtk DataFile Version 3.0\nx\nASCII\nDATASET POLYDATA\nPOINTS 0 float\n")
    with pytest.raises(ValueError, match="no points"):
        readers.read_surface(spark, none)
    with pytest.raises(ValueError, match="no points"):
        readers.read_surface(spark, saved(tmp_path, "none.stl", "solid x\nendsolid x\n"))
    with pytest.raises(ValueError, match="no reader"):
        readers.read_surface(spark, f"{tmp_path}/a.xyzzy")


def test_plane(spark, tmp_path):
    writers.write_plane(spark, f"{tmp_path}/plane.vtk", [(0, 0, 0), (1, 0, 0), (0, 2, 0)])
    assert readers.read_plane(spark, f"{tmp_path}/plane.vtk") == [(0, 0, 0), (1, 0, 0), (0, 2, 0)]
    four = cloud(spark.createDataFrame([(i, 0.0, 0.0, float(i)) for i in range(4)], "pid long, x double, y double, z double"))
    writers.write_surface(four, f"{tmp_path}/four.vtk", "vtk")
    with pytest.raises(ValueError, match="4 points"):
        readers.read_plane(spark, f"{tmp_path}/four.vtk")


def test_ply_with_other_line_ends_and_elements(spark, tmp_path):
    text = "ply\r\nformat ascii 1.0\r\ncomment x\r\nelement vertex 3\r\nproperty float x\r\nproperty float y\r\nproperty float z\r\nproperty uchar red\r\nproperty uchar green\r\nproperty uchar blue\r\nelement edge 1\r\nproperty int a\r\nelement face 1\r\nproperty list uchar int vertex_index\r\nend_header\r\n0 0 0 1 2 3\r\n1 0 0 4 5 6\r\n0 1 0 7 8 255\r\n9\r\n3 0 1 2\r\n"
    mesh = readers.read_surface(spark, saved(tmp_path, "a.ply", text))
    assert points(mesh, "rgb") == [(0, 0, 0, [1, 2, 3]), (1, 0, 0, [4, 5, 6]), (0, 1, 0, [7, 8, 255])] and cells(mesh) == [("polys", [0, 1, 2])]


def test_ply_big_endian_cloud(spark, tmp_path):
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
    mesh = readers.read_surface(spark, saved(tmp_path, "a.ply", head + struct.pack(">6d", *range(6))))
    assert points(mesh) == [(0, 1, 2), (3, 4, 5)] and cells(mesh) == []


def test_vtk_newer_cells_and_fields(spark, tmp_path):
    text = "# vtk DataFile Version 5.1\nx\nASCII\nDATASET POLYDATA\nPOINTS 4 float\n0 0 0 1 0 0 1 1 0\n0 1 0\nMETADATA\nINFORMATION 0\n\nPOLYGONS 3 6\nOFFSETS vtktypeint64\n0 3 6\nCONNECTIVITY vtktypeint64\n0 1 2\n0 2 3\nCELL_DATA 2\nSCALARS c int\nLOOKUP_TABLE default\n7 8\nPOINT_DATA 4\nFIELD FieldData 1\nf 2 4 float\n1 2 3 4 5 6 7 8\nSCALARS s float\nLOOKUP_TABLE default\n1 2 3 4\nCOLOR_SCALARS c 3\n0 0.5 1 0 0 0 1 1 1 0 0 1\n"
    mesh = readers.read_surface(spark, saved(tmp_path, "a.vtk", text))
    assert points(mesh, "scalar", "rgb") == [(0, 0, 0, 1, [0, 128, 255]), (1, 0, 0, 2, [0, 0, 0]), (1, 1, 0, 3, [255, 255, 255]), (0, 1, 0, 4, [0, 0, 255])]
    assert cells(mesh) == [("polys", [0, 1, 2]), ("polys", [0, 2, 3])]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("appended", ["", "base64", "raw"])
def test_vtp_coded_arrays(spark, tmp_path, packed, appended):
    arrays, blob = [], b""
    for values in (np.array([0, 0, 0, 1, 0, 0, 0, 1, 0], "<f4"), np.array([0, 1, 2], "<i8"), np.array([3], "<i8")):
        data = values.tobytes()
        code = (lambda x: x) if appended == "raw" else base64.b64encode
        if packed:
            half = (len(data) + 1) // 2
            blocks = [zlib.compress(data[:half]), zlib.compress(data[half:])]
            coded = code(struct.pack("<5I", 2, half, len(data) - half, *map(len, blocks))) + code(b"".join(blocks))
        else:
            coded = code(struct.pack("<I", len(data))) + code(data)
        arrays.append(f'format="appended" offset="{len(blob)}"/>' if appended else f'format="binary">{coded.decode()}</DataArray>')
        blob += coded
    p, c, o = arrays
    more = ' compressor="vtkZLibDataCompressor"' if packed else ""
    text = f'<VTKFile type="PolyData" byte_order="LittleEndian" header_type="UInt32"{more}><PolyData><Piece NumberOfPoints="3" NumberOfPolys="1"><Points><DataArray type="Float32" NumberOfComponents="3" {p}</Points><Polys><DataArray type="Int64" Name="connectivity" {c}<DataArray type="Int64" Name="offsets" {o}</Polys></Piece></PolyData>'.encode()
    text += f'<AppendedData encoding="{appended}">\n_'.encode() + blob + b"\n</AppendedData></VTKFile>" if appended else b"</VTKFile>"
    mesh = readers.read_surface(spark, saved(tmp_path, "a.vtp", text))
    assert points(mesh) == [(0, 0, 0), (1, 0, 0), (0, 1, 0)] and cells(mesh) == [("polys", [0, 1, 2])]


def test_wrl_takes_the_last_shape(spark, tmp_path):
    face = "coordIndex [0 1 2 -1 0 2 1 -1]"
    text = "#VRML V2.0 utf8\nShape { geometry IndexedFaceSet { coord Coordinate { point [9 9 9, 8 8 8, 7 7 7] } %s } }\nShape { geometry IndexedFaceSet { coord Coordinate { point [0 0 0, 1 0 0, 0 1 0] } %s } }\n"
    mesh = readers.read_surface(spark, saved(tmp_path, "a.wrl", text % (face, face)))
    assert points(mesh) == [(0, 0, 0), (1, 0, 0), (0, 1, 0)] and cells(mesh) == [("polys", [0, 1, 2]), ("polys", [0, 2, 1])]
    bare = readers.read_surface(spark, saved(tmp_path, "b.wrl", text % (face, "")))
    assert points(bare) == [(0, 0, 0), (1, 0, 0), (0, 1, 0)] and cells(bare) == []


ROWS = {"xyz": ("1 2 3", []), "xyzs": ("1 2 3 7", ["scalar"]), "xyzn": ("1 2 3 0 0 2", ["nx", "ny", "nz"]), "xyzns": ("1 2 3 0 3 4 7", ["nx", "ny", "nz", "scalar"]), "xyznrgb": ("1 2 3 0 0 0 0.5 1 0", ["rgb"])}
WANTED = {"xyz": (1, 2, 3), "xyzs": (1, 2, 3, 7), "xyzn": (1, 2, 3, 0, 0, 1), "xyzns": (1, 2, 3, 0, 0.6, 0.8, 7), "xyznrgb": (1, 2, 3, [127, 255, 0])}


@pytest.mark.parametrize("by", [" ", ",", ";", "\t"])
@pytest.mark.parametrize("name", ROWS)
def test_delimited(spark, tmp_path, name, by):
    row, columns = ROWS[name]
    line = row.replace(" ", by)
    mesh = readers.read_surface(spark, saved(tmp_path, "a.csv", f"{line}\n{line}"))
    assert points(mesh, *columns) == [WANTED[name]] * 2 and cells(mesh) == [("verts", [0]), ("verts", [1])]


def test_delimited_ends(spark, tmp_path):
    for n in (5, 8):
        with pytest.raises(ValueError, match=f"{n} columns"):
            readers.read_surface(spark, saved(tmp_path, f"bad{n}.txt", " ".join("1" * n) + "\n"))
    with pytest.raises(ValueError, match="no points"):
        readers.read_surface(spark, saved(tmp_path, "empty.txt", "\n \n"))
    assert points(readers.read_surface(spark, saved(tmp_path, "ragged.txt", "1 2 3\n4 5 6\n7 8 9 1\n1 1 1\n"))) == [(1, 2, 3), (4, 5, 6)]
    assert points(readers.read_surface(spark, saved(tmp_path, "crlf.txt", "1 2 3\r\n4 5 6\r\n"))) == [(1, 2, 3), (4, 5, 6)]
    assert points(readers.read_surface(spark, saved(tmp_path, "a.bnd", "9 1 2 3\n8 4 5 6"))) == [(1, 2, 3), (4, 5, 6)]
    assert points(readers.read_surface(spark, saved(tmp_path, "a.pse", "9 1 2 3\n8 4 5 6\nend\n7 7 8 9\n"))) == [(1, 2, 3), (4, 5, 6)]
    assert points(readers.read_surface(spark, saved(tmp_path, "a.anno", "1 2 3\n4 5 6"))) == [(1, 2, 3), (4, 5, 6)]


def test_landmarks(spark, tmp_path):
    rows = readers.read_landmarks_anno(spark, saved(tmp_path, "a.anno", "1 2 3\n1 2\n4,5,6")).orderBy("id").collect()
    assert [(r["id"], r["x"], r["y"], r["z"], r["active"]) for r in rows] == [(0, 1, 2, 3, 1), (1, 4, 5, 6, 1)]
    text = '<PickedPoints><point x="1" y="2" z="3" active="1" name="a"/><point name="b" active="0" x="4.5" y="5" z="6"/></PickedPoints>'
    mesh = readers.read_surface(spark, saved(tmp_path, "a.pp", text))
    assert points(mesh, "scalar") == [(1, 2, 3, 1), (4.5, 5, 6, 0)]
    rows = readers.read_landmarks_pp(spark, f"{tmp_path}/a.pp").orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "a"), (2, "b")]


def test_numbers_matrix_settings(spark, tmp_path):
    assert [r["value"] for r in readers.read_doubles(spark, saved(tmp_path, "n.txt", "1.5\n2\n\n3\n")).orderBy("i").collect()] == [1.5, 2.0]
    with pytest.raises(ValueError, match="no numbers"):
        readers.read_doubles(spark, saved(tmp_path, "none.txt", "\n1\n"))
    m = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(2) for c in range(3)], "r int, c int, value double")
    writers.write_matrix_array(m, f"{tmp_path}/m.vtk")
    assert {tuple(r) for r in readers.read_matrix(spark, f"{tmp_path}/m.vtk").collect()} == {tuple(r) for r in m.collect()}
    writers.write_matrix(m, f"{tmp_path}/m.txt")
    assert (tmp_path / "m.txt").read_text() == "0.0 1.0 2.0\n10.0 11.0 12.0\n"
    writers.write_numbers(spark.createDataFrame([(1, 2.0), (0, 1.5)], "i int, value double"), f"{tmp_path}/v.txt")
    assert (tmp_path / "v.txt").read_text() == "1.5\n2.0\n"
    row = readers.read_settings(spark, saved(tmp_path, "s.json", '{"PointSize": 3,\n "BackgroundColor": [0, 1, 2]}')).first()
    assert row["PointSize"] == 3 and row["BackgroundColor"] == [0, 1, 2]


OBJ = "mtllib m.mtl\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nvt 1 0 9\nvt 1 1\nvn 0 0 1\nusemtl red\nf 3/3 1/1 2/2\nusemtl none\nusemtl blue\nf 1/1/1 3/3/1 4/2/1\nf 1//1 2//1 3//1\n"


def test_obj_materials_and_scene(spark, tmp_path):
    path = saved(tmp_path, "m.obj", OBJ)
    single = readers.read_surface(spark, path)
    assert points(single, "nz", "u") == [(0, 0, 0, 1, 0), (1, 0, 0, 1, 1), (1, 1, 0, 1, 1), (0, 1, 0, 1, 1)]
    assert cells(single) == [("polys", [2, 0, 1]), ("polys", [0, 2, 3]), ("polys", [0, 1, 2])]
    assert list(Scene.read(spark, path).surfaces) == [0]  # no materials: one surface
    saved(tmp_path, "m.mtl", "newmtl red\nmap_Kd red.png\nnewmtl blue\nMap_kd blue.jpg\n")
    saved(tmp_path, "b.txt", "1 2 3\n")
    scene = Scene.read(spark, path, f"{tmp_path}/b.txt")
    assert [s.name for s in scene.surfaces.values()] == ["m.obj_red", "m.obj_blue", "b.txt"]
    assert points(scene[0].mesh, "u", "v") == [(1, 1, 0, 1, 1), (0, 0, 0, 0, 0), (1, 0, 0, 1, 0)]
    assert cells(scene[1].mesh) == [("polys", [0, 1, 2]), ("polys", [0, 3, 1])]
    materials = readers.read_mtl(spark, f"{tmp_path}/m.mtl").orderBy("ord").collect()
    assert [(r["name"], r["filename"]) for r in materials] == [("red", "red.png"), ("blue", "blue.jpg")]
    saved(tmp_path, "red.png", b"pixels")
    found = {r["name"]: r["image"] for r in readers.read_textures(spark, str(tmp_path), readers.read_mtl(spark, f"{tmp_path}/m.mtl")).collect()}
    assert bytes(found["red"]) == b"pixels" and found["blue"] is None
    assert readers.sidecar_texture(spark, str(tmp_path), "red").first()["path"].endswith("red.png")
    scene[0].matrix = (1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    scene.write(f"{tmp_path}/all.vtp", "vtp")
    back = readers.read_surface(spark, f"{tmp_path}/all.vtp")
    assert points(back)[:3] == [(6, 1, 0), (5, 0, 0), (6, 0, 0)] and points(back)[-1] == (1, 2, 3)
    assert cells(back)[0] == ("verts", [7])


def test_mtl_without_image(spark, tmp_path):
    with pytest.raises(ValueError, match="no image"):
        readers.read_mtl(spark, saved(tmp_path, "m.mtl", "newmtl a\nKd 1 1 1\nmap_kd a.gif\n"))


def test_sinks_place_and_choose(spark, tmp_path, mixed):
    shift = (1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    writers.write_surface(mixed, f"{tmp_path}/t.txt", "txt", matrix=shift, normals=False, scalars=False)
    assert points(readers.read_surface(spark, f"{tmp_path}/t.txt"))[1] == (11, 0.5, -1.25)
    with pytest.raises(ValueError, match="no writer"):
        writers.write_surface(mixed, f"{tmp_path}/t.abc", "abc")


def test_short_numbers(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1.0, -2.5, 1e-5, 0.0001, 123456789.0, 99999999.0, 0.1 + 0.2, 1 / 3, -1e20, 12345.678912]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", writers.short(F.col("x")).alias("s"))
    assert [r["s"] for r in df.orderBy("i").collect()] == ["%.8g" % x for x in values]

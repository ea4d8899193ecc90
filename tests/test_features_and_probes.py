"""Smoothing that keeps features, distance fields by boxes and with sure signs, derived names."""

import math

import numpy as np
import pytest

from facetlake.functions import geometry as g
from facetlake.model import Mesh, Scene
from facetlake.operators import generate, graph, sets, volume

XYZ, NORMAL = ["x", "y", "z"], ["nx", "ny", "nz"]


def mesh_of(spark, xyz, polys):
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    return Mesh(points, spark.createDataFrame([(i, "polys", [int(k) for k in p]) for i, p in enumerate(polys)], "cid long, kind string, pids array<long>"))


def array(df, *columns, by="pid"):
    return np.array([[r[c] for c in columns] for r in df.orderBy(by).collect()], float)


def bumpy_box(n=4):
    """A cube's surface as a welded grid of triangles, its side points moved in and out, and what kind each point is."""
    rng, xyz, tri = np.random.default_rng(0), {}, []
    for axis in range(3):
        for end in (0, n):
            for i in range(n):
                for j in range(n):
                    corner = lambda a, b: tuple(np.insert(np.array([a, b]), axis, end).tolist())
                    quad = [xyz.setdefault(corner(*c), len(xyz)) for c in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]
                    tri += [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
    keys = sorted(xyz, key=xyz.get)
    on = np.array([sum(v in (0, n) for v in k) for k in keys])  # 1: side, 2: edge, 3: corner
    places = np.array(keys, float)
    for p, k in zip(places, keys, strict=True):
        if sum(v in (0, n) for v in k) == 1:
            axis = next(i for i, v in enumerate(k) if v in (0, n))
            p[axis] += rng.uniform(-0.05, 0.05)
    return places, tri, on


@pytest.mark.parametrize("way", ["laplace", "sinc"])
def test_smoothing_keeps_edges_and_corners(spark, way):
    xyz, tri, on = bumpy_box()
    mesh = mesh_of(spark, xyz, tri)
    after = graph.smooth(mesh, 5, 0.5, feature=45.0) if way == "laplace" else graph.smooth_sinc(mesh, 10, feature=45.0)
    after = array(after.points, *XYZ)
    assert np.allclose(after[on == 3], xyz[on == 3])  # corners stay
    moved = np.abs(after - xyz)
    assert (np.sort(moved[on == 2], axis=1)[:, :2] < 1e-9).all()  # points of edges stay on their lines
    side = on == 1
    axis = np.array([int(np.argmin(np.minimum(np.abs(p), np.abs(p - 4)))) for p in xyz[side]])
    rough = lambda p: np.abs(p[side][np.arange(side.sum()), axis] - np.round(p[side][np.arange(side.sum()), axis] / 4) * 4).mean()
    assert rough(after) < 0.7 * rough(xyz)
    free = array(graph.smooth(mesh, 5, 0.5).points, *XYZ)
    assert np.abs(free - xyz)[on == 3].max() > 0.1  # without features corners are pulled in


def test_smoothing_fixes_what_turns(spark):
    """On an open strip with features the ends of the border's straight runs stay, the others move along it."""
    xyz = [(i, j, 0.3 * (i == 2 and j == 1)) for j in range(3) for i in range(5)]
    tri = [t for j in range(2) for i in range(4) for t in ((5 * j + i, 5 * j + i + 1, 5 * j + i + 6), (5 * j + i, 5 * j + i + 6, 5 * j + i + 5))]
    links = graph.smoothing_links(mesh_of(spark, xyz, tri), feature=80.0)
    found = {}
    for r in links.collect():
        found.setdefault(r["a"], set()).add(r["b"])
    assert {a for a in range(15) if a not in found} == {0, 4, 10, 14}
    assert found[2] == {1, 3} and found[5] == {0, 10} and len(found[7]) == 6
    rigid = graph.smoothing_links(mesh_of(spark, xyz, tri), boundary=False, feature=80.0)
    assert {r["a"] for r in rigid.collect()} == {6, 7, 8}


def brute(mesh, places):
    """For each place (d2, triangle, place, weights) of all triangles."""
    xyz = array(mesh.points, *XYZ)
    tri = [r["pids"] for r in mesh.cells.orderBy("cid").collect()]
    out = []
    for p in places:
        at, w = g.closest_places(np.repeat(p[None], len(tri), 0), *(xyz[[t[k] for t in tri]] for k in range(3)))
        out.append((((at - p) ** 2).sum(1), at, w))
    return xyz, tri, out


def small_meshes(spark):
    ball = sets.weld(generate.sphere(spark, theta_res=6, phi_res=5))
    closed = Mesh(ball.points.select("pid", *XYZ), ball.cells)
    return closed, Mesh(closed.points, closed.cells.where("cid <> 0"))


@pytest.mark.parametrize("which", [0, 1])
def test_sure_signs(spark, which):
    mesh = small_meshes(spark)[which]
    grid = volume.Grid((5, 5, 5), (0.6,) * 3, (-1.2,) * 3)
    normal = graph.vertex_normals(mesh, orient=True)
    found = array(volume.mesh_distance_sure(grid.voxels(spark), normal), "value", by="vid")[:, 0]
    n = array(normal.points, *NORMAL)
    places = array(grid.voxels(spark), *XYZ, by="vid")
    _, tri, rows = brute(mesh, places)
    uses = {}
    for t in tri:
        for e in zip(t, t[1:] + t[:1], strict=True):
            uses[frozenset(e)] = uses.get(frozenset(e), 0) + 1
    for value, p, (d2, at, w) in zip(found, places, rows, strict=True):
        k = int(d2.argmin())
        sure = all(uses[frozenset(e)] == 2 for e in zip(tri[k], tri[k][1:] + tri[k][:1], strict=True))
        inside = sure and (w[k] @ n[list(tri[k])]) @ (p - at[k]) < 0
        assert value == pytest.approx((1 if inside else -1) * math.sqrt(d2[k]), abs=1e-9)
    assert (found > 0).any() and (found < 0).any()


def test_boxes(spark):
    mesh = graph.vertex_normals(small_meshes(spark)[0], orient=True)
    grid = volume.Grid((9, 8, 7), (0.5,) * 3, (-2.2, -2.0, -1.4))
    found = array(volume.mesh_distance_boxes(grid, mesh, least=0.3), "value", by="vid")[:, 0]
    places = array(grid.voxels(spark), *XYZ, by="vid")
    xyz, tri, rows = brute(mesh, places)
    n = array(mesh.points, *NORMAL)
    index = [(x, y, z) for z in range(7) for y in range(8) for x in range(9)]
    untouched = 0
    for value, p, ijk, (d2, at, w) in zip(found, places, index, rows, strict=True):
        best = None
        for k, t in enumerate(tri):
            low, high = xyz[t].min(0), xyz[t].max(0)
            reach = np.maximum(0.3, 1.5 * (high - low))
            first = np.maximum(np.trunc(((low + high) / 2 - reach - grid.origin) / 0.5), 0)
            last = np.minimum(np.trunc(((low + high) / 2 + reach - grid.origin) / 0.5) + 1, np.array(grid.dims) - 1)
            if (first <= ijk).all() and (ijk < last).all() and (best is None or d2[k] < d2[best]):
                best = k
        if best is None:
            assert value == volume.UNTOUCHED
            untouched += 1
        else:
            corner = tri[best][int(np.argmax(w[best]))]
            assert abs(value) == pytest.approx(math.sqrt(d2[best]), abs=1e-9)
            assert value == pytest.approx(math.copysign(math.sqrt(d2[best]), n[corner] @ (p - at[best])), abs=1e-9) or np.sort(w[best])[-1] - np.sort(w[best])[-2] < 1e-9
    assert 0 < untouched < len(found)


def test_derived_names(spark):
    mesh = mesh_of(spark, [(0, 0, 0)], [])
    scene = Scene()
    a, b = scene.add("face", mesh), scene.add("skull", mesh)
    made = [scene.derive(a, "threshold", mesh, 0.5, 2), scene.derive(a, "compare", mesh, scene[b].name), scene.derive(a, "connect", mesh, 3), scene.derive(a, "flip", mesh)]
    assert [scene[k].name for k in made] == ["face_threshold_0.5_to_2", "face_ComparedTo_skull", "face_connect3", "face_flip"]
    assert scene.derive(b, "mirror", mesh, replaced=True) == b and scene[b].name == "skull"
    with pytest.raises(ValueError):
        scene.derive(a, "unknown", mesh)

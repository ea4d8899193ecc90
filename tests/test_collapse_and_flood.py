"""Edge collapse, floods and sections against plain versions."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from facetlake.model import Mesh
from facetlake.operators import clip, decimate, generate, graph, measure, project, sets, volume

XYZ = ["x", "y", "z"]


def mesh_of(spark, xyz, polys):
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    return Mesh(points, spark.createDataFrame([(i, "polys", [int(k) for k in p]) for i, p in enumerate(polys)], "cid long, kind string, pids array<long>"))


def arrays(mesh):
    xyz = np.array([[r[c] for c in XYZ] for r in mesh.points.orderBy("pid").collect()])
    return xyz, [tuple(r["pids"]) for r in mesh.cells.orderBy("cid").collect()]


def edge_counts(tri):
    return Counter(frozenset(e) for t in tri for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))


def sheet(n, bump=0.0):
    at = lambda i, j: i * (n + 1) + j
    xyz = [(i, j, bump * math.sin(i) * math.cos(j)) for i in range(n + 1) for j in range(n + 1)]
    return xyz, [t for i in range(n) for j in range(n) for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]


def test_collapse_keeps_a_sphere_closed(spark):
    ball = generate.sphere(spark, theta_res=8, phi_res=8)
    ball = Mesh(ball.points.select("pid", *XYZ), ball.cells)
    before = arrays(ball)[1]
    xyz, tri = arrays(decimate.decimate(ball, 0.4))
    target = len(before) - int(len(before) * 0.4)
    assert target - 1 <= len(tri) <= target
    uses = edge_counts(tri)
    assert set(uses.values()) == {2} and len(xyz) - len(uses) + len(tri) == 2
    assert len({frozenset(t) for t in tri}) == len(tri)
    middle = np.array([xyz[list(t)].mean(0) for t in tri])
    assert np.abs(np.linalg.norm(middle, axis=1) - 1).max() < 0.25
    normals = np.cross(xyz[[t[1] for t in tri]] - xyz[[t[0] for t in tri]], xyz[[t[2] for t in tri]] - xyz[[t[0] for t in tri]])
    assert ((normals * middle).sum(1) > 0).all()  # none turned over


def test_collapse_of_a_flat_sheet_keeps_its_outline(spark):
    xyz, tri = sheet(4)
    after, cells = arrays(decimate.decimate(mesh_of(spark, xyz, tri), 0.3, "progressive"))
    assert len(cells) <= len(tri) - int(0.3 * len(tri))
    area = lambda p, ts: sum(0.5 * np.linalg.norm(np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])) for t in ts)
    assert area(after, cells) == pytest.approx(16) and np.allclose(after[:, 2], 0)
    places = {tuple(p) for p in after}
    assert places >= {(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 4.0, 0.0), (4.0, 4.0, 0.0)}
    assert places <= {tuple(map(float, p)) for p in xyz}


def test_collapse_ends_where_nothing_may_go(spark):
    tetra = mesh_of(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)])
    assert len(arrays(decimate.decimate(tetra, 0.9))[1]) == 4
    assert arrays(decimate.decimate(mesh_of(spark, [(0, 0, 0)], []), 0.5))[1] == []
    xyz, tri = sheet(2)
    assert len(arrays(decimate.decimate(mesh_of(spark, xyz, tri), 0.0))[1]) == len(tri)
    with pytest.raises(ValueError):
        decimate.decimate(tetra, 0.5, "other")


def plain_flood(known, dims):
    """A front that moves one step a round; the least id of the round before wins."""
    values, front = dict(known), dict(known)
    while front:
        offers = {}
        for vid, value in front.items():
            ix, iy, iz = vid % dims[0], vid // dims[0] % dims[1], vid // (dims[0] * dims[1])
            for d in itertools.product((-1, 0, 1), repeat=3):
                x, y, z = ix + d[0], iy + d[1], iz + d[2]
                if 0 <= x < dims[0] and 0 <= y < dims[1] and 0 <= z < dims[2]:
                    to = x + y * dims[0] + z * dims[0] * dims[1]
                    if to not in values:
                        offers[to] = min(offers.get(to, (vid, value)), (vid, value))
        front = {to: value for to, (_, value) in offers.items()}
        values |= front
    return values


@pytest.mark.parametrize(("dims", "seeds"), [((9, 7, 5), 4), ((1, 40, 2), 1), ((6, 6, 6), 30)])
def test_flood(spark, dims, seeds):
    rng = np.random.default_rng(seeds)
    known = {int(v): float(i) for i, v in enumerate(rng.choice(math.prod(dims), seeds, replace=False))}
    grid = volume.Grid(dims, (1.0,) * 3, (0.0,) * 3)
    found = volume.flooded(spark.createDataFrame(list(known.items()), "vid long, value double"), grid)
    assert {r["vid"]: r["value"] for r in found.collect()} == plain_flood(known, dims)
    assert volume.flooded(spark.createDataFrame([], "vid long, value double"), grid).count() == 0


def test_least_along_a_line():
    rng = np.random.default_rng(0)
    none = np.iinfo(np.int32).max
    for n in (1, 2, 5, 33, 64):
        for _ in range(20):
            at = np.where(rng.random(n) < 0.3, rng.integers(0, 3 * n, n), none)
            i = np.arange(n)
            assert (volume.nearest_along(at) == np.maximum(np.abs(i[:, None] - i[None]), at[None]).min(1)).all()


def test_section_takes_the_largest_loop(spark):
    """Two cubes, then a tube whose section has a hole, with triangles turned at random."""
    cubes = sets.append(*(sets.weld(graph.triangulated(project.apply_transform(generate.cube(spark, s, s, s), [1, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]))) for s, x in ((1.0, 0.0), (2.0, 9.0))))
    loops = measure.section_loops(cubes, (0, 0, 0.1), (0, 0, 1)).orderBy("area").collect()
    assert [r["area"] for r in loops] == pytest.approx([1, 4])
    assert measure.section_area(cubes, (0, 0, 0.1), (0, 0, 1)).first()["area"] == pytest.approx(4)
    assert measure.section_area(cubes, (0, 0, 5), (0, 0, 1)).first()["area"] == 0
    n, xyz, tri = 12, [], []
    for r in (1.0, 2.0):
        for z in (0.0, 1.0):
            xyz += [(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n), z) for i in range(n)]
    for a, b in ((0, 1), (1, 3), (3, 2), (2, 0)):  # inner wall, top, outer wall, bottom
        for i in range(n):
            p, q, r, s = a * n + i, a * n + (i + 1) % n, b * n + i, b * n + (i + 1) % n
            tri += [(p, q, s), (p, s, r)]
    rng = np.random.default_rng(1)
    tri = [t[::-1] if rng.random() < 0.5 else t for t in tri]
    tube = mesh_of(spark, xyz, tri)
    ring = lambda r: 0.5 * n * r * r * math.sin(2 * math.pi / n)
    assert sorted(x["area"] for x in measure.section_loops(tube, (3, 1, 0.5), (0, 0, 1)).collect()) == pytest.approx([ring(1), ring(2)])
    xyz, tri = sheet(3, 0.5)
    assert measure.section_loops(mesh_of(spark, xyz, tri), (1.5, 0, 0), (1, 0, 0)).count() == 0  # an open chain encloses nothing
    assert clip.edge_uses(tube).where("cells <> 2").count() == 0

"""Places in regions: the closest triangle, against brute force, where bounds alone rule out nearly nothing."""

import numpy as np
import pytest

from facetlake.functions import geometry as g
from facetlake.model import Mesh
from facetlake.operators import index, spatial


def table(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")


@pytest.fixture
def small(monkeypatch):
    """Several regions, chunks, blocks and halvings, and no way that holds all triangles."""
    monkeypatch.setattr(spatial, "BLOCK_PAIRS", 0)
    for module, name, value in ((spatial, "TRIANGLE_REGIONS", 6), (spatial, "TOGETHER", 4), (spatial, "TRIED_FIRST", 2), (index, "REGION_ITEMS", 40), (index, "REGION_PLACES", 16), (index, "AT_ONCE", 50)):
        monkeypatch.setattr(module, name, value)


def closest(p, q, tri):
    """(place, cell, squared distance) by comparing all pairs."""
    found = []
    for i, at in enumerate(p):
        place, _ = g.closest_places(np.broadcast_to(at, (len(tri), 3)), *(q[tri[:, k]] for k in range(3)))
        d2 = ((place - at) ** 2).sum(1)
        found.append((i, int(d2.argmin()), float(d2.min())))
    return found


def test_closest_triangle_among_huge_thin_and_equal_ones(spark, small):
    rng = np.random.default_rng(11)
    q = np.concatenate([rng.normal(size=(120, 3)), rng.uniform(size=(30, 3)) * 1e-6, rng.normal(size=(6, 3)) * 1e6])
    tri = np.array([(i, i + 1, i + 2) for i in range(len(q) - 2)] + [(3, 4, 5), (3, 4, 5), (7, 7, 8), (9, 9, 9), (0, 50, 100)])
    q[20:23] = [[0, 0, 0], [1, 1, 1], [2, 2, 2 + 1e-9]]
    p = np.concatenate([rng.normal(size=(60, 3)), np.full((20, 3), 0.1), rng.normal(size=(5, 3)) * 1e4, q[:10]])
    mesh = Mesh(table(spark, q), spark.createDataFrame([(i, "polys", list(map(int, t))) for i, t in enumerate(tri)], "cid long, kind string, pids array<long>"))
    rows = spatial.nearest_triangle(table(spark, p), mesh).orderBy("id").collect()
    assert [(r["id"], r["cid"], r["d2"]) for r in rows] == closest(p, q, tri)


def test_few_pairs_of_a_tangled_mesh_are_compared_exactly(monkeypatch):
    """Every triangle's bounds hold most places; so bounds alone left over a third of all pairs to compare."""
    rng = np.random.default_rng(12)
    q, p = rng.normal(size=(3000, 3)), rng.normal(size=(500, 3))
    tri = np.arange(3000).reshape(-1, 3)
    columns = {"cid": np.arange(1000), "k": np.zeros(1000, np.int64)} | {c: tri[:, k] for k, c in enumerate("abc")} | {c + x: q[tri[:, k], i] for k, c in enumerate("abc") for i, x in enumerate("xyz")}
    seen, whole = [], g.closest_places
    monkeypatch.setattr(g, "closest_places", lambda at, *corners: (seen.append(len(at)), whole(at, *corners))[1])
    found = spatial._closest_of(np.arange(500), *p.T, spatial._held(spatial.pa.table(columns)))
    monkeypatch.undo()
    assert [(i, c, d) for i, c, d in zip(*(found.column(k).to_pylist() for k in ("id", "cid", "d2")), strict=True)] == closest(p, q, tri)
    assert sum(seen) < 500 * 1000 / 10

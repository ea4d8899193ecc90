"""Nearest and radius joins on hard clouds, both ways of each; orientation along forests."""

import itertools
import math

import numpy as np
import pytest

from facetlake.model import Mesh
from facetlake.operators import graph, index, spatial

XYZ = ["x", "y", "z"]


def table(spark, xyz, first=0):
    return spark.createDataFrame([(first + i, *(None if v is None else float(v) for v in p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")


def hard_cloud(n, seed):
    """A third in a tiny cluster, a third of one place, a few far away, the rest spread."""
    rng = np.random.default_rng(seed)
    third = n // 3
    return np.concatenate([rng.normal(size=(third, 3)) * 1e-7 + 0.3, np.full((third, 3), 0.25), [[1e6, 0, 0], [0, -1e7, 3], [1e6, 1, 0]], rng.uniform(size=(n - 2 * third - 3, 3))])


NOWHERE = [(float("nan"), 0, 0), (None, 1, 1), (0, float("inf"), 0), (0, 0, -float("inf"))]


@pytest.fixture
def small(monkeypatch):
    """Small leaves, chunks and blocks, and no way that holds all points."""
    monkeypatch.setattr(spatial, "BLOCK_PAIRS", 0)
    for name, value in (("LEAF_ROWS", 8), ("CHUNK", 32), ("BLOCK", 40), ("AT_ONCE", 64)):
        monkeypatch.setattr(index, name, value)


@pytest.mark.parametrize("k", [1, 3, 200])
def test_nearest_points_of_a_hard_cloud(spark, small, k):
    p, q = hard_cloud(90, 1), hard_cloud(150, 2)
    found = spatial.knn(table(spark, [*p, *NOWHERE]), table(spark, [*q, *NOWHERE]), k).orderBy("id", "rank").collect()
    d2 = ((p[:, None] - q[None]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(np.arange(len(q)), d2.shape), d2), axis=1)[:, :k]
    assert [r["other"] for r in found] == order.ravel().tolist()
    assert [r["rank"] for r in found] == np.tile(np.arange(1, min(k, len(q)) + 1), len(p)).tolist()
    assert [r["d2"] for r in found] == np.take_along_axis(d2, order, 1).ravel().tolist()


def test_both_ways_leave_out_what_has_no_place(spark, monkeypatch):
    p, q = hard_cloud(40, 3), hard_cloud(40, 4)
    left, right = table(spark, [*p, *NOWHERE]), table(spark, [*q, *NOWHERE])
    tri = [(i, "polys", [i, i + 1, i + 2]) for i in range(len(q) + len(NOWHERE) - 2)]
    mesh = Mesh(right, spark.createDataFrame(tri, "cid long, kind string, pids array<long>"))
    both = []
    for pairs in (spatial.BLOCK_PAIRS, 0):
        monkeypatch.setattr(spatial, "BLOCK_PAIRS", pairs)
        both.append((sorted(map(tuple, spatial.knn(left, right, 2).collect())), sorted(map(tuple, spatial.nearest_triangle(left, mesh).collect()))))
    assert both[0] == both[1]
    assert len(both[0][0]) == 2 * len(p) and len(both[0][1]) == len(p)
    nowhere = table(spark, NOWHERE)
    assert spatial.knn(left, nowhere, 1).count() == 0 and spatial.knn(nowhere, right, 1).count() == 0
    assert spatial.nearest_triangle(nowhere, mesh).count() == 0


def test_nearest_triangle_beside_a_huge_one(spark, small, monkeypatch):
    rng = np.random.default_rng(5)
    xyz = [*rng.uniform(size=(120, 3)), (-1e5, -1e5, 0.2), (1e5, -1e5, 0.4), (0, 2e5, 0.5)]
    cells = [(i, "polys", [3 * i, 3 * i + 1, 3 * i + 2]) for i in range(41)]
    mesh = Mesh(table(spark, xyz), spark.createDataFrame(cells, "cid long, kind string, pids array<long>"))
    places = table(spark, [*rng.uniform(size=(60, 3)), (1e4, 1e4, 5), (1e6, 0, 0)])
    found = sorted(map(tuple, spatial.nearest_triangle(places, mesh).collect()))
    monkeypatch.setattr(spatial, "BLOCK_PAIRS", 1 << 40)
    assert found == sorted(map(tuple, spatial.nearest_triangle(places, mesh).collect()))


def test_no_leaf_is_too_large_and_few_are_visited():
    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.normal(size=(20_000, 3)) * 1e-6, rng.uniform(size=(40_000, 3)), rng.normal(size=(9, 3)) * 1e9])
    tree = index.Tree.cut(np.column_stack([xyz, np.zeros(len(xyz))]), 100)
    leaf = tree.leaf_of(np.column_stack([xyz, np.zeros(len(xyz))]))
    tree.fill([(k, int((leaf == k).sum()), *xyz[leaf == k].min(0), *xyz[leaf == k].max(0)) for k in np.unique(leaf)])
    assert np.bincount(leaf).max() <= 100 and tree.rows[0] == len(xyz)
    some = np.concatenate([xyz[::500], rng.normal(size=(5, 3)) * 1e12])
    point, _ = tree.near(some, k=5)
    assert np.bincount(point).max() <= 100
    point, at = tree.near(some[:50], radius=0.05)
    for i, p in enumerate(some[:50]):
        held = set(leaf[((xyz - p) ** 2).sum(1) <= 0.0025])
        assert held <= set(at[point == i])


@pytest.mark.parametrize("dense", [4096, 8])
def test_radius_join_of_a_hard_cloud(spark, monkeypatch, dense):
    monkeypatch.setattr(spatial, "DENSE", dense)
    p, q = hard_cloud(60, 7), hard_cloud(90, 8)
    found = {(r["id"], r["other"]) for r in spatial.radius_join(table(spark, [*p, *NOWHERE]), table(spark, [*q, *NOWHERE]), 0.2).collect()}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(((p[:, None] - q[None]) ** 2).sum(2) <= 0.04)), strict=True))


def strip(n, twist):
    """A band of 2n triangles, closed; with a twist it is a Moebius strip. Every third triangle is turned."""
    side = lambda i, up: 2 * (i % n) + (up if i < n or not twist else 1 - up)
    tri = []
    for i in range(n):
        a, b, c, d = side(i, 0), side(i, 1), side(i + 1, 0), side(i + 1, 1)
        tri += [(a, c, b), (b, c, d)]
    return [t if k % 3 else t[::-1] for k, t in enumerate(tri)]


def disagreeing(tri):
    """Edges that two triangles run along in the same direction."""
    seen = {}
    for t in tri:
        for a, b in zip(t, t[1:] + t[:1], strict=True):
            seen.setdefault(frozenset((a, b)), []).append((a, b))
    return sum(len(uses) == 2 and uses[0] == uses[1] for uses in seen.values())


@pytest.mark.parametrize("twist", [False, True])
def test_orientation_of_a_band(spark, twist):
    tri = strip(9, twist)
    points = table(spark, [(math.cos(i // 2 / 9 * 6.28), math.sin(i // 2 / 9 * 6.28), i % 2) for i in range(18)])
    mesh = Mesh(points, spark.createDataFrame([(i, "polys", list(t)) for i, t in enumerate(tri)], "cid long, kind string, pids array<long>"))
    got = [tuple(r["pids"]) for r in graph.consistent(mesh).cells.orderBy("cid").collect()]
    assert got[0] == tri[0] and disagreeing(tri) > 1
    assert disagreeing(got) == int(twist)  # no turns make all of a Moebius strip agree: one edge is left


def plain_parities(nodes, links):
    """Kruskal's forest over links in order, then the parity along it to the least node."""
    pairs = {}
    for a, b, odd in links:
        if a != b:
            key = (min(a, b), max(a, b))
            pairs[key] = min(odd, pairs.get(key, True))
    group, flip = {n: n for n in nodes}, dict.fromkeys(nodes, False)
    for (a, b), odd in sorted(pairs.items()):
        if group[a] != group[b]:
            turn = odd != (flip[a] != flip[b])
            gone = group[b]
            for n in nodes:
                if group[n] == gone:
                    group[n], flip[n] = group[a], flip[n] != turn
    least = {}
    for n in sorted(nodes):
        least.setdefault(group[n], n)
    return {n: (least[group[n]], flip[n] != flip[least[group[n]]]) for n in nodes}


def test_parities_with_contradictions(spark):
    rng = np.random.default_rng(9)
    nodes = list(range(0, 120, 2))
    links = [(int(a), int(b), bool(o)) for a, b, o in zip(rng.choice(nodes, 70), rng.choice(nodes, 70), rng.integers(0, 2, 70), strict=True)]
    found = graph.parities(spark.createDataFrame(links, "a long, b long, odd boolean"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: (r["label"], r["flip"]) for r in found.collect()} == plain_parities(nodes, links)


def test_parities_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    tables, settled = itertools.count(), graph.settled
    monkeypatch.setattr(graph, "settled", lambda *a, **k: (next(tables), settled(*a, **k))[1])
    n = 400
    links = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b", "true AS odd")
    found = graph.parities(links, spark.range(n).withColumnRenamed("id", "node")).collect()
    assert {(r["node"], r["label"], r["flip"]) for r in found} == {(i, 0, i % 2 == 1) for i in range(n)}
    assert next(tables) < 30

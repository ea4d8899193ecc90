"""Places on a border that is not of their own triangle."""

import numpy as np

from facetlake.model import Mesh, cloud
from facetlake.operators import spatial


def table(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")


def test_compare_inside_leaves_out_places_near_any_border_edge(spark):
    # A large triangle at z = 0; a small one over it whose lower side lies 1e-6 above the large one's middle.
    corners = [(-9, -9, 0), (9, -9, 0), (0, 9, 0), (-1, 0, 1e-6), (1, 0, 1e-6), (0, 0, 3)]
    cells = spark.createDataFrame([(0, "polys", [0, 1, 2]), (1, "polys", [3, 4, 5])], "cid long, kind string, pids array<long>")
    places = [(0.5, 0, -1), (0.5, 1, -1), (0.5, 1e-3, -1), (-0.999, 1e-5, -1), (-2, 0, -1), (0, -9.5, 0), (1.00001, 0, -2)]
    found = spatial.compare_inside(cloud(table(spark, places)), Mesh(table(spark, corners), cells), signed=False).collect()
    assert sorted(r["pid"] for r in found) == [1, 2, 4]


def test_on_border_of_long_and_short_edges(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(0, 0.01, (30, 3)), [(50, 0, 0), (-50, 1, 0), (0, 0, 40)]])
    tri = [(i, i + 1, i + 2) for i in range(0, len(p) - 2, 3)]
    cells = spark.createDataFrame([(i, "polys", list(t)) for i, t in enumerate(tri)], "cid long, kind string, pids array<long>")
    ends = [(a, b) for t in tri for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))]
    a, d = p[[e[0] for e in ends]], np.array([p[y] - p[x] for x, y in ends])
    at = np.concatenate([a + rng.uniform(-0.1, 1.1, (len(a), 1)) * d + rng.normal(0, 0.01, a.shape), rng.normal(0, 1, (200, 3))])
    near = table(spark, at).selectExpr("pid AS id", "x AS cx", "y AS cy", "z AS cz", "0L AS a", "1L AS b", "2L AS c")
    w = at[:, None] - a[None]
    t = np.clip((w * d).sum(2) / (d * d).sum(1), 0, 1)
    far2 = ((w - t[..., None] * d) ** 2).sum(2).min(1)
    found = sorted(r["id"] for r in spatial.on_border(near, Mesh(table(spark, p), cells), 4e-4).collect())
    assert found == np.flatnonzero(far2 < 4e-4).tolist()
    assert 20 < len(found) < len(at) - 20

"""Links that connect what lies near each other, without all pairs."""

import numpy as np
import pytest

from facetlake.operators import graph, spatial


def table(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")


def labels(p, radius):
    """The least reachable point of each, by brute force."""
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= radius * radius
    of = np.arange(len(p))
    while True:
        new = np.array([of[row].min() for row in near])
        if (new == of).all():
            return of.tolist()
        of = new


def dense_and_split():
    """A dense ball, two walls just within and two just out of reach of each other, a far group and lone points."""
    rng = np.random.default_rng(3)
    wall = np.column_stack([np.zeros(60), rng.uniform(0, 0.5, 60), rng.uniform(0, 0.5, 60)])
    parts = [rng.normal(0, 0.1, (300, 3)), wall + (3, 0, 0), wall + (3.2499, 0, 0), wall + (6, 0, 0), wall + (6.2501, 0, 0), rng.normal(9, 0.02, (30, 3)), rng.uniform(-5, -1, (40, 3))]
    return np.concatenate(parts)


@pytest.mark.parametrize("few, dense", [(16, 4096), (1, 20)])
def test_connecting_links_have_the_components_of_all_links(spark, monkeypatch, few, dense):
    monkeypatch.setattr(spatial, "FEW", few)
    monkeypatch.setattr(spatial, "DENSE", dense)
    p = dense_and_split()
    links = spatial.connecting_links(table(spark, p), 0.25).collect()
    assert len(links) < 20 * len(p)
    assert all(((p[r["a"]] - p[r["b"]]) ** 2).sum() <= 0.25**2 for r in links)
    found = graph.components(spark.range(len(p)).withColumnRenamed("id", "node"), spark.createDataFrame(links, "a long, b long")).collect()
    assert [r["label"] for r in sorted(found)] == labels(p, 0.25)


def no_pairs(*_):
    raise AssertionError("all pairs within the radius")


def test_components_query_makes_no_pairs(spark, monkeypatch):
    from facetlake.plans import catalog

    monkeypatch.setattr(spatial, "radius_join", no_pairs)
    assert catalog.components(spark, "/root/testdata/sf0.001").count() == 500


def test_vertex_neighbours_by_a_distance(spark, monkeypatch):
    p = dense_and_split()[:360]
    points = table(spark, p).cache()
    pairs = spatial.radius_join(points, points, 0.1).where("id < other").selectExpr("id AS a", "other AS b")
    expected = sorted(r["pid"] for r in graph.vertex_neighbours(points, pairs, 0, 0.04).collect())
    monkeypatch.setattr(spatial, "radius_join", no_pairs)
    assert sorted(r["pid"] for r in graph.vertex_neighbours(points, 0.1, 0, 0.04).collect()) == expected != []


def test_crop_flood_by_a_distance(spark, monkeypatch):
    points = table(spark, dense_and_split()).selectExpr("*", "CASE WHEN pid % 3 = 1 THEN 1.0 WHEN pid % 97 = 0 THEN 2.0 ELSE 0.0 END AS scalar").cache()
    pairs = spatial.radius_join(points, points, 0.1).where("id < other").selectExpr("id AS a", "other AS b")
    expected = sorted((r["pid"], r["scalar"]) for r in graph.crop_flood(points, pairs).collect())
    monkeypatch.setattr(spatial, "radius_join", no_pairs)
    assert sorted((r["pid"], r["scalar"]) for r in graph.crop_flood(points, 0.1).collect()) == expected


def test_closest_points_within_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "radius_join", no_pairs)
    p = dense_and_split()
    q = p[::7] + 0.01
    cells = spark.createDataFrame([], "cid long, kind string, pids array<long>")
    found = [tuple(r) for r in spatial.closest_points_within(spatial.Mesh(table(spark, p), cells), table(spark, q), 0.05).points.orderBy("pid").select("x", "y", "z").collect()]
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    hit = dict.fromkeys(int(row.argmin()) for row in d2 if row.min() <= 0.05**2)
    assert found == [tuple(p[i]) for i in hit]


def test_mark_covered_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "radius_join", no_pairs)
    p = dense_and_split()
    q = p[::9] + 0.03
    found = [r["scalar"] for r in spatial.mark_covered(table(spark, p), table(spark, q), 0.1).orderBy("pid").collect()]
    assert found == (((p[:, None] - q[None]) ** 2).sum(2).min(1) <= 0.1**2).astype(float).tolist()

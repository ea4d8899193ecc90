"""Values of the surface operators that no SQL covers, against numpy on small meshes and clouds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.functions import statistics as st
from facetlake.functions import text as tx
from facetlake.model import Mesh, Scene, cloud
from facetlake.operators import clip, generate, graph, measure, project, register, sets, spatial, volume
from facetlake.streaming import moments

XYZ, NORMAL = ["x", "y", "z"], ["nx", "ny", "nz"]


def table(spark, xyz, **more):
    rows = [(i, *map(float, p), *(float(v[i]) for v in more.values())) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double" + "".join(f", {c} double" for c in more))


def mesh_of(spark, xyz, polys, **more):
    return Mesh(table(spark, xyz, **more), spark.createDataFrame([(i, "polys", [int(k) for k in p]) for i, p in enumerate(polys)], "cid long, kind string, pids array<long>"))


def array(df, *columns, by="pid"):
    return np.array([[float("nan") if v is None else v for v in r] for r in df.orderBy(by).select(*(columns or XYZ)).collect()], float)


def grid(n=4, bump=0.0):
    """Points and triangles of an n x n grid of squares."""
    at = lambda i, j: i * (n + 1) + j
    xyz = [(i, j, bump * math.sin(i + 2 * j)) for i in range(n + 1) for j in range(n + 1)]
    tri = [t for i in range(n) for j in range(n) for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    return np.array(xyz, float), tri


@pytest.fixture(scope="module")
def hills(spark):
    xyz, tri = grid(4, 0.3)
    return mesh_of(spark, xyz, tri, scalar=np.arange(len(xyz)) % 7)


@pytest.fixture(scope="module")
def two(spark):
    """Two cubes apart, the second three times as large; its ids follow."""
    box = graph.triangulated(generate.cube(spark))
    far = project.apply_transform(generate.cube(spark, 3, 3, 3), [1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    both = sets.append(sets.weld(box), sets.weld(graph.triangulated(far)))
    return Mesh(both.points.select("pid", *XYZ), both.cells)


def brute_places(p, xyz, tri):
    """(d2, place) of the closest place on the triangles, by many barycentric trials."""
    best = (np.inf, None)
    for t in tri:
        a, b, c = (xyz[k] for k in t)
        at, _ = g.closest_places(np.array([p]), a[None], b[None], c[None])
        d = ((at[0] - p) ** 2).sum()
        best = min(best, (d, tuple(at[0])), key=lambda v: v[0])
    return best


def test_closest_places_against_a_fine_sample():
    rng = np.random.default_rng(0)
    u = np.linspace(0, 1, 60)
    w = np.array([(1 - s - t, s, t) for s in u for t in u if s + t <= 1])
    for _ in range(40):
        p, a, b, c = rng.normal(size=(4, 3))
        at, weights = g.closest_places(p[None], a[None], b[None], c[None])
        sample = w @ np.array([a, b, c])
        assert ((at[0] - p) ** 2).sum() <= ((sample - p) ** 2).sum(1).min() + 1e-12
        assert np.allclose(weights[0] @ np.array([a, b, c]), at[0]) and (weights[0] >= -1e-9).all()


@pytest.mark.parametrize("blocks", [True, False])
def test_nearest_searches(spark, hills, monkeypatch, blocks):
    """Both ways of a search, with a dense cluster and far outliers."""
    if not blocks:
        monkeypatch.setattr(spatial, "BLOCK_PAIRS", 0)
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(30, 3)) * 1e-3, [[50, 0, 0], [0, -80, 3]]])
    q = np.concatenate([rng.normal(size=(40, 3)), [[60, 0, 0]], p[:3]])
    d2 = ((p[:, None] - q[None]) ** 2).sum(2)
    found = spatial.knn(table(spark, p), table(spark, q), 3).orderBy("id", "rank").collect()
    order = np.lexsort((np.broadcast_to(np.arange(len(q)), d2.shape), d2), axis=1)[:, :3]
    assert [r["other"] for r in found] == order.ravel().tolist()
    assert np.allclose([r["d2"] for r in found], np.take_along_axis(d2, order, 1).ravel())
    xyz, tri = grid(4, 0.3)
    rows = spatial.nearest_triangle(table(spark, p), hills).orderBy("id").collect()
    for r, place in zip(rows, p, strict=True):
        d, at = brute_places(place, xyz, tri)
        assert r["d2"] == pytest.approx(d, abs=1e-12) and np.allclose([r["cx"], r["cy"], r["cz"]], at)
        corners = np.array([xyz[r[k]] for k in "abc"])
        assert np.allclose(np.array([r["wa"], r["wb"], r["wc"]]) @ corners, at)


def test_knn_ties_and_few(spark):
    q = table(spark, [(0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, 1)])
    rows = spatial.knn(table(spark, [(0, 0, 0)]), q, 2).orderBy("rank").collect()
    assert [(r["rank"], r["other"]) for r in rows] == [(1, 0), (2, 1)]
    assert spatial.knn(table(spark, [(0, 0, 0)]), q, 9).count() == 4
    assert spatial.knn(table(spark, [(0, 0, 0)]), q.where("false"), 2).count() == 0
    assert spatial.nearest_triangle(table(spark, [(0, 0, 0)]), mesh_of(spark, [(0, 0, 0)], [])).count() == 0


def test_compare_signed_inside_project(spark, hills):
    xyz, tri = grid(4, 0.3)
    p = np.array([(1.3, 1.6, 2), (1.3, 1.6, -2), (-3, 2, 0), (2.5, 3.1, 0.9)])
    normals = array(graph.vertex_normals(hills).points, *NORMAL)
    want = []
    for place in p:
        rows = [(((at := g.closest_places(place[None], *(xyz[k][None] for k in t)))[0][0] - place) ** 2).sum() for t in tri]
        at, w = g.closest_places(place[None], *(xyz[k][None] for k in tri[int(np.argmin(rows))]))
        n = w[0] @ normals[list(tri[int(np.argmin(rows))])]
        want.append((-1 if n @ (place - at[0]) < 0 else 1) * math.sqrt(min(rows)))
    found = spatial.compare(cloud(table(spark, p)), hills).orderBy("pid").collect()
    assert np.allclose([r["distance"] for r in found], want)
    inside = spatial.compare_inside(cloud(table(spark, p)), hills).collect()
    assert sorted(r["pid"] for r in inside) == [0, 1, 3]
    assert sorted(r["pid"] for r in spatial.compare_inside(cloud(table(spark, p)), hills, most=2).collect()) == [0]
    moved, moves = spatial.project_surface(cloud(table(spark, p)), hills)
    places = np.array([brute_places(q, xyz, tri)[1] for q in p])
    assert np.allclose(array(moved.points), places) and np.allclose(array(moves), places - p)


def test_random_resample_lies_on_the_surface(spark, hills):
    xyz, tri = grid(4, 0.3)
    got = spatial.random_resample(hills, 20, seed=3, normals=True).points
    assert got.count() == 20
    for row in array(got, *XYZ, *NORMAL):
        assert brute_places(row[:3], xyz, tri)[0] < 1e-18 and np.linalg.norm(row[3:]) == pytest.approx(1)


def test_selected_and_picked(spark):
    marks = spark.createDataFrame([(0, 5, 1.0), (1, 6, 2.0), (2, 7, 3.0)], "lm_pos int, id int, x double")
    assert [r["x"] for r in spatial.selected_landmarks(marks, [7, 5, 9]).orderBy("at").collect()] == [3, 1]
    rows = spatial.picked(cloud(table(spark, [(1, 2, 3)], scalar=[4])), 0).collect()
    assert rows[0]["text"] == "id 0, position 1.000000 2.000000 3.000000, scalar 4.000000"


def test_regions(spark, two):
    assert [m.cells.count() for m in graph.all_regions(two)] == [12, 12]
    for f in (graph.largest_region, graph.outer_region):
        assert f(two).points.count() == 8
    assert array(graph.outer_region(two).points).max() > 10
    assert array(graph.closest_region(two, (9, 0, 0)).points)[:, 0].min() > 8
    assert array(graph.closest_region(two, (1, 0, 0)).points)[:, 0].max() < 2
    big = two.with_points(two.points.withColumn("scalar", F.col("x")))
    assert graph.scalar_region(big, 5, 50).points.count() == 8
    assert graph.scalar_region(big, -1, -0.4, full=True).cells.count() == 2
    assert graph.scalar_region(big, -1, -0.4).cells.count() == 10


def test_orientation_and_normals(spark):
    box = sets.weld(graph.triangulated(generate.cube(spark)))
    bare = Mesh(box.points.select("pid", *XYZ), box.cells)
    mixed = Mesh(bare.points, bare.cells.withColumn("pids", F.when(F.col("cid") % 3 == 1, F.reverse("pids")).otherwise(F.col("pids"))))
    n = array(graph.vertex_normals(mixed, orient=True).points, *NORMAL)
    at = array(bare.points)
    side = np.sign((n * at).sum(1))
    assert (side == side[0]).all() and np.allclose(np.linalg.norm(n, axis=1), 1)
    assert np.allclose(array(graph.vertex_normals(mixed, orient=True, flip=True).points, *NORMAL), -n)
    split = graph.vertex_normals(bare, split=True)
    assert split.points.count() == 24 and split.cells.count() == 12
    sharp = array(split.points, *XYZ, *NORMAL)
    assert np.allclose(np.abs(sharp[:, 3:]).max(1), 1) and len({tuple(np.round(r, 6)) for r in sharp}) == 24
    assert graph.vertex_normals(bare, split=True, angle=100).points.count() == 8


def test_cliques_vote_and_reference(spark):
    rng = np.random.default_rng(2)
    base = np.concatenate([rng.uniform(0, 3, (40, 2)) @ np.eye(2, 3), rng.uniform(0, 3, (7, 2)) @ np.eye(2, 3) + [20, 0, 0]])
    n = np.array([[0, 0, 1 if i % 3 else -1] for i in range(47)])
    points = table(spark, base, nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])
    of = graph.cliques(points, radius=2.0)
    voted = graph.vote_orientation(points, of)
    for clique, rows in voted.toPandas().groupby("clique"):
        assert abs(rows["nz"].sum()) == len(rows), clique
    down = points.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(-1.0)})
    assert array(graph.vote_orientation(points, of, reference=down), "nz").sum() == -voted.count()
    kept = graph.keep_cliques(voted, 10)
    assert kept.select("clique").distinct().count() == 1 and kept.count() >= 30
    assert {r[0] for r in graph.keep_cliques(voted, 0).select("clique").distinct().collect()} == set(range(voted.select("clique").distinct().count()))
    assert graph.keep_cliques(voted, largest_only=True).count() == voted.groupBy("clique").count().agg(F.max("count")).first()[0]


def test_pca_normals_of_a_plane(spark):
    xyz, _ = grid(5)
    rows = graph.pca_normals(table(spark, xyz), radius=1.5).collect()
    assert len(rows) == 36 and all(abs(abs(r["nz"]) - 1) < 1e-9 and r["third"] < 1e-9 for r in rows)
    assert len(graph.pca_normals(table(spark, xyz), radius=None, k=6).collect()) == 36


def test_smoothing(spark, hills):
    xyz, tri = grid(4, 0.3)
    near = [sorted({k for t in tri if i in t for k in t} - {i}) for i in range(len(xyz))]
    want = xyz.copy()
    for _ in range(7):
        want = want + 0.1 * (np.array([want[k].mean(0) for k in near]) - want)
    assert np.allclose(array(graph.smooth(hills, 7, 0.1).points), want)
    c = graph.sinc_coefficients(12, 0.1)
    average = np.array([[1 / len(near[i]) if j in near[i] else 0 for j in range(len(xyz))] for i in range(len(xyz))])
    half = (np.eye(len(xyz)) + average) / 2
    t = [np.eye(len(xyz)), half]
    for _ in range(11):
        t.append(2 * half @ t[-1] - t[-2])
    assert np.allclose(array(graph.smooth_sinc(hills, 12, 0.1).points), sum(a * m for a, m in zip(c, t, strict=True)) @ xyz)
    assert c.sum() == pytest.approx(1)
    k = np.linspace(0, 2, 50)
    response = [sum(a * math.cos(i * math.acos(1 - x / 2)) for i, a in enumerate(c)) for x in k]
    assert abs(response[0] - 1) < 1e-9 and max(map(abs, response[25:])) < 0.05
    ends = {i for i, p in enumerate(xyz) if 0 in p[:2] or 4 in p[:2]}
    fixed = array(graph.smooth_sinc(hills, 8, 0.1, boundary=False).points)
    assert all(np.allclose(fixed[i], xyz[i]) for i in ends) and not np.allclose(fixed, xyz)
    low = array(graph.smooth_taubin(hills, 5).points)
    assert low.shape == xyz.shape and low[:, 2].std() < xyz[:, 2].std()


def test_subdivision(spark, hills):
    xyz, tri = grid(4, 0.3)
    uses = {}
    for t in tri:
        for p, q, w in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
            uses.setdefault(tuple(sorted((t[p], t[q]))), []).append(t[w])
    linear = graph.subdivide(hills, "linear")
    got = array(linear.points)
    assert linear.cells.count() == 4 * len(tri) and len(got) == len(xyz) + len(uses)
    middle = {tuple(np.round((xyz[a] + xyz[b]) / 2, 9)) for a, b in uses}
    assert {tuple(np.round(p, 9)) for p in got[len(xyz) :]} == middle
    loop = array(graph.subdivide(hills, "loop").points)
    want = set()
    for (a, b), w in uses.items():
        p = (3 * (xyz[a] + xyz[b]) + xyz[w[0]] + xyz[w[1]]) / 8 if len(w) == 2 else (xyz[a] + xyz[b]) / 2
        want.add(tuple(np.round(p, 9)))
    for i, p in enumerate(xyz):
        ring = [a if b == i else b for a, b in uses if i in (a, b)]
        rim = [k for k in ring if len(uses[tuple(sorted((i, k)))]) == 1]
        n = len(ring)
        beta = (0.625 - (0.375 + math.cos(2 * math.pi / n) / 4) ** 2) / n
        q = 0.75 * p + sum(xyz[k] for k in rim) / 8 if rim else (1 - n * beta) * p + beta * sum(xyz[k] for k in ring)
        want.add(tuple(np.round(q, 9)))
    assert {tuple(np.round(p, 9)) for p in loop} == want
    flat = graph.subdivide(mesh_of(spark, *grid(5)), "butterfly")
    assert np.allclose(array(flat.points)[:, 2], 0) and np.allclose(array(flat.points)[:36], grid(5)[0])


def test_decimate_and_holes(spark):
    ball = sets.weld(generate.sphere(spark, theta_res=24, phi_res=24))
    small = graph.cluster_decimate(ball, 6)
    r = np.linalg.norm(array(small.points), axis=1)
    assert 20 < small.points.count() < ball.points.count() / 2 and r.min() > 0.8 and r.max() < 1.15
    edges = clip.edge_uses(small).where("cells = 2").count()
    assert edges > 0.9 * clip.edge_uses(small).count()
    tube = sets.weld(graph.triangulated(generate.cylinder(spark, cap=False)))
    assert clip.edge_uses(tube).where("cells = 1").count() == 24
    closed = graph.close_holes(tube)
    assert clip.edge_uses(closed).where("cells <> 2").count() == 0
    n = {r["loop"]: r["count"] for r in graph.boundary_loops(tube).groupBy("loop").count().collect()}
    assert sorted(n.values()) == [12, 12]
    assert clip.edge_uses(graph.close_holes(tube, most=5)).where("cells = 1").count() == 24


def test_clips(spark, hills):
    part = clip.cut_with_plane(hills, (1.5, 0, 0), (1, 0, 0))
    assert array(part.points)[:, 0].min() == pytest.approx(1.5)
    flat = mesh_of(spark, *grid(4))
    half = clip.cut_with_plane(flat, (1.5, 0, 0), (1, 0, 0))
    assert measure.surface_area(half).first()["area"] == pytest.approx(10)
    assert clip.flipped_plane((1, 2, 3), (0, 0, 1)) == ((1, 2, 3), (0, 0, -1))
    fin = mesh_of(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (5, 5, 5), (6, 5, 5), (5, 6, 5)], [(0, 1, 2), (0, 1, 3), (0, 1, 4), (5, 6, 7)])
    assert [r["cid"] for r in clip.remove_non_manifold(fin).cells.collect()] == [3]
    assert clip.consistency(fin) == "1 non-manifold edges" and clip.consistency(flat) == ""
    loose = Mesh(fin.points, fin.cells.where("cid = 3"))
    assert array(clip.compact(loose).points).tolist() == [[5, 5, 5], [6, 5, 5], [5, 6, 5]]


def test_registration(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(60, 3))
    turn = math.radians(10)
    r = np.array([[math.cos(turn), -math.sin(turn), 0], [math.sin(turn), math.cos(turn), 0], [0, 0, 1]])
    q = 1.5 * p @ r.T + [1, -2, 0.5]
    pairs = table(spark, p, tx=q[:, 0], ty=q[:, 1], tz=q[:, 2])
    m = register.landmark_transform(pairs, "similarity")
    assert np.allclose(m[:3, :3], 1.5 * r) and np.allclose(m[:3, 3], [1, -2, 0.5])
    assert np.allclose(register.landmark_transform(pairs)[:3, :3], r)
    skewed = p @ np.array([[1, 0.2, 0], [0, 2, 0], [0.1, 0, 0.7]]).T + 3
    m = register.landmark_transform(table(spark, p, tx=skewed[:, 0], ty=skewed[:, 1], tz=skewed[:, 2]), "affine")
    assert np.allclose(m[:3, :3], [[1, 0.2, 0], [0, 2, 0], [0.1, 0, 0.7]]) and np.allclose(m[:3, 3], 3)
    assert np.allclose(register.landmark_transform(pairs.where("false")), np.eye(4))


@pytest.mark.parametrize("options", [{}, {"points_first": True, "stop": 1e-4}])
def test_icp_finds_a_small_move(spark, options):
    xyz, tri = grid(5, 0.6)
    target = mesh_of(spark, xyz, tri)
    t = math.radians(3)
    m = np.array([[math.cos(t), -math.sin(t), 0, 0.05], [math.sin(t), math.cos(t), 0, -0.1], [0, 0, 1, 0.08], [0, 0, 0, 1]])
    source = project.apply_transform(target, np.linalg.inv(m).ravel())
    got = register.icp(source, target, register.IcpOptions(iterations=40, stop=options.pop("stop", 1e-7), match_centroids=True, **options))
    moved = array(project.apply_transform(source, got).points)
    assert np.abs(moved - xyz).max() < 0.05 and np.allclose(got[:3, :3] @ got[:3, :3].T, np.eye(3))


def test_measures(spark, hills, two):
    xyz, tri = grid(4, 0.3)
    sides = lambda t: [np.linalg.norm(xyz[t[i]] - xyz[t[i - 1]]) for i in range(3)]
    least = []
    for t in tri:
        a, b, c = sides(t)
        least.append(min(math.degrees(math.acos((y * y + z * z - x * x) / (2 * y * z))) for x, y, z in ((a, b, c), (b, c, a), (c, a, b))))
    assert measure.mean_minimum_angle(hills).first()["angle"] == pytest.approx(np.mean(least))
    assert measure.section_area(two, (10, 0, 0), (1, 0, 0)).first()["area"] == pytest.approx(9)
    assert measure.section_area(two, (10, 0, 0), (1, 1, 0)).first()["area"] == pytest.approx(9 * math.sqrt(2))
    rng = np.random.default_rng(5)
    p = rng.normal(size=(80, 3)) * [3, 2, 1]
    points = table(spark, p)
    mean, values, axes = measure.pca(points)
    want = np.sort(np.linalg.eigvalsh(np.cov(p.T, bias=True)))[::-1]
    assert np.allclose(values, want) and np.allclose(mean, p.mean(0)) and np.allclose(axes.T @ axes, np.eye(3))
    o, a, b = measure.fit_plane(points)
    n = np.cross(a - o, b - o)
    assert abs(n @ axes[:, 2]) == pytest.approx(np.linalg.norm(n)) and np.allclose((o + a + b - o) / 2, mean, atol=10)
    m = measure.principal_transform(points, scaled=True)
    assert np.linalg.det(m[:3, :3]) > 0 and np.allclose(np.linalg.norm(m[:3, :3], axis=0), np.sqrt(want)) and np.allclose(m[:3, 3], mean)
    blob = array(generate.pca_blob(spark, points, res=12).points)
    local = (np.linalg.inv(m[:3, :3]) @ (blob - mean).T).T
    assert np.allclose(np.linalg.norm(local, axis=1), 1)


def test_reports(spark, hills):
    rows = {(r["section"], r["key"]): r["value"] for r in measure.mesh_report(hills).collect()}
    s = np.arange(25) % 7
    assert rows["cells", "polys"] == 32 and rows["points", "points"] == 25 and rows["points", "scalar_mean"] == pytest.approx(s.mean())
    assert rows["points", "scalar_median"] == np.sort(s)[12] and rows["arrays", "scalar"] == 1
    row = measure.index_range(spark.createDataFrame([(i, float(i * i)) for i in range(10)], "i int, v double"), "i", "v", 2, 5).first()
    assert row["mean"] == pytest.approx(np.mean([4, 9, 16])) and row["sdev"] == pytest.approx(np.std([4, 9, 16]))
    a = np.random.default_rng(6).normal(size=(3, 5))
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(5)], "r int, c int, value double")
    for found, want in ((measure.small_cov_compat(cells), a @ a.T / 4), (measure.matrix_product(measure.matrix_transpose(cells), cells), a.T @ a)):
        got = np.zeros(want.shape)
        for r in found.collect():
            got[r["r"], r["c"]] = r["value"]
        assert np.allclose(got, want)


def test_order_statistics_of_any_group(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(v)) for k, n in (("a", 500), ("b", 1), (None, 40)) for v in rng.integers(0, 50, n)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    found = {r["k"]: r for r in st.fractiles(df, ["k"], "v", {"low": 0.05, "mid": 0.5, "top": 0.95}).collect()}
    robust = {r["k"]: r for r in st.robust_mean_sdev(df, ["k"], "v", 0.1, 0.9).collect()}
    assert set(found) == {"a", "b", None}
    for k in found:
        v = np.sort([x for j, x in rows if j == k])
        assert [found[k][c] for c in ("low", "mid", "top")] == [v[int(len(v) * f)] for f in (0.05, 0.5, 0.95)]
        some = v[int(len(v) * 0.1) : int(len(v) * 0.9) + 1]
        assert robust[k]["mean"] == pytest.approx(some.mean()) and robust[k]["sdev"] == pytest.approx(some.std())


def test_windows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK_ROWS", 10)
    monkeypatch.setattr(st, "BLOCK_WIDTHS", 1)
    rng = np.random.default_rng(8)
    rows = [(k, i, float(rng.normal())) for k, n in (("a", 57), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    for how, f in (("median", lambda v: sorted(v)[len(v) // 2]), ("average", np.mean)):
        got = {(r["k"], r["i"]): r["m"] for r in st.windowed(df, "v", ["k"], ["i"], 7, how, "m").collect()}
        for k in "ab":
            v = [x for j, _, x in rows if j == k]
            assert all(got[k, i] == pytest.approx(f(v[max(0, i - 3) : i + 4])) for i in range(len(v)))
        assert len(got) == len(rows)


def test_projections(spark, hills):
    n = graph.vertex_normals(hills)
    lines = array(project.normal_lines(n))
    xyz, normals = array(n.points), array(n.points, *NORMAL)
    size = 0.01 * math.sqrt(((xyz.max(0) - xyz.min(0)) ** 2).sum())
    assert np.allclose(lines[0::2], xyz) and np.allclose(lines[1::2], xyz + size * normals)
    moved, how = project.normalise_size(hills, 2.0)
    at = array(moved.points)
    assert (at.max(0) - at.min(0)).max() == pytest.approx(2) and np.allclose(at.mean(0), 0) and how.first()["scale"] == pytest.approx(0.5)
    m = project.matrix_from_line((1, 2, 3), (1, 2, 8), 90)
    assert np.allclose(m @ [0, 0, 5, 1], [1, 2, 8, 1]) and np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3))
    ring = spark.createDataFrame([("a", i, 2 * math.cos(t), 2 * math.sin(t), 7.0) for i, t in enumerate(np.linspace(0, 2 * math.pi, 12, endpoint=False))], "s string, ord int, x double, y double, z double")
    flat = array(project.polygon_2d(ring, ["s"]), "px", "py", by="ord")
    assert np.allclose(np.linalg.norm(flat, axis=1), 2)
    assert not {"nx", "scalar"} & set(n.drop_normals().drop_scalar().points.columns)


def test_colours(spark):
    import colorsys

    df = spark.createDataFrame([(i, i / 8 * 3 - 0.5) for i in range(9)], "pid int, v double")
    for k, (h, s, v) in enumerate(project.RAMPS):
        for r in df.select("v", project.color_ramp(F.col("v"), 0, 2, k).alias("c")).collect():
            t = min(1, max(0, r["v"] / 2))
            want = [255 * c for c in colorsys.hsv_to_rgb(*(a + t * (b - a) for a, b in (h, s, v)))]
            assert np.allclose(r["c"], want, atol=0.51)
    got = df.select(project.next_color(F.col("pid"), [[1, 2, 3], [4, 5, 6]]).alias("c")).collect()
    assert [r["c"][0] for r in got[:3]] == [1, 4, 1]


def test_volumes(spark):
    ball = generate.sphere(spark, theta_res=20, phi_res=20)
    ball = graph.vertex_normals(sets.weld(Mesh(ball.points.select("pid", *XYZ), ball.cells)), orient=True)
    at = array(ball.points)
    normals = array(ball.points, *NORMAL)
    if (at * normals).sum() < 0:
        ball = ball.with_points(ball.points.withColumns({c: -F.col(c) for c in NORMAL}))
        normals = -normals
    box = volume.grid_by_side(ball.points, side=6, pad=2)
    voxels = box.voxels(spark)
    p = array(voxels, by="vid")
    d2 = ((p[:, None] - at[None]) ** 2).sum(2)
    near = np.lexsort((np.broadcast_to(np.arange(len(at)), d2.shape), d2), axis=1)[:, :5]
    d = np.sqrt(np.take_along_axis(d2, near, 1))
    along = ((p[:, None] - at[near]) * normals[near]).sum(2)
    signed = np.where(along < 0, -1, 1) * d
    want = {
        "signed_mean": signed.mean(1), "projected_mean": along.mean(1), "projected_median": np.sort(along, 1)[:, 2], "signed_median": np.sort(signed, 1)[:, 2],
        "unsigned_median": -np.sort(d, 1)[:, 2], "nearest_signed": signed[:, 0], "nearest_projected": along[:, 0], "nearest_unsigned": -d[:, 0],
    }
    for mode, value in want.items():
        got = array(volume.oriented_distance(voxels, ball.points, mode, outside_sign=1), "value", by="vid")[:, 0]
        assert np.allclose(np.abs(got) if "unsigned" in mode else got, np.abs(value) if "unsigned" in mode else value, atol=1e-9), mode
    exact = np.linalg.norm(p, axis=1) - 1
    got = array(volume.mesh_distance(voxels, ball), "value", by="vid")[:, 0]
    assert np.abs(got - exact).max() < 0.06
    surface = array(volume.oriented_distance(voxels, ball.points, "unsigned_surface", surface=ball), "value", by="vid")[:, 0]
    assert np.allclose(surface, np.abs(got))
    banded = volume.band_distance(box, ball.points, 0.3, mode="signed_mean", outside_sign=1)
    inside = {r[0] for r in volume.band(ball.points, box, 0.3).collect()}
    full = array(volume.oriented_distance(voxels, ball.points, "signed_mean", outside_sign=1), "value", by="vid")[:, 0]
    for r in banded.collect():
        assert r["value"] == pytest.approx(full[r["vid"]] if r["vid"] in inside else 0.0)
        assert (r["weight"] == 0) == (r["vid"] not in inside) or r["weight"] == 0
    field = volume.mesh_distance(voxels, ball).join(voxels, "vid")
    shell = volume.isosurface(field, box)
    r = np.linalg.norm(array(shell.points), axis=1)
    assert abs(r - 1).max() < 0.08 and clip.edge_uses(shell).where("cells <> 2").count() == 0
    same = volume.isosurface_from(field, box, (1, 0, 0))
    assert same.points.count() == shell.points.count()
    flooded = volume.mesh_distance_band(box, ball, 0.1)
    assert flooded.count() == voxels.count()


def test_stencils_and_sampling(spark):
    box = volume.Grid((5, 4, 3), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3, 4, 5))  # z, y, x
    voxels = box.voxels(spark).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v.ravel())], "vid long, value double"), "vid")
    pad = np.pad(v, 1, mode="edge")
    mean = sum(pad[1 + a : 4 + a, 1 + b : 5 + b, 1 + c : 6 + c] for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))) / 6
    assert np.allclose(array(volume.smooth_mean(voxels, box), "value", by="vid")[:, 0], mean.ravel())
    kernel = volume.double_laplacian_kernel()
    assert sum(kernel.values()) == pytest.approx(1) and (0, 0, 0) not in kernel
    want = np.zeros_like(v)
    for (i, j, k), w in kernel.items():
        z, y, x = (np.clip(np.arange(n) + o, 0, n - 1) for n, o in ((3, k), (4, j), (5, i)))
        want += w * v[np.ix_(z, y, x)]
    assert np.allclose(array(volume.smooth_double_laplacian(voxels, box, 1, 0.5), "value", by="vid")[:, 0], (v + 0.5 * (want - v)).ravel())
    p = np.array([(0.5, 0.5, 0.5), (3.2, 1.7, 0.4), (4, 3, 2), (9, 0, 0)])
    got = array(volume.trilinear(table(spark, p), voxels, box, clamp=False), "scalar")[:, 0]
    for q, s in zip(p[:3], got, strict=False):
        lo = np.minimum(np.floor(q).astype(int), [3, 2, 1])
        f = q - lo
        total = sum(v[lo[2] + c, lo[1] + b, lo[0] + a] * np.prod([x if k else 1 - x for x, k in zip(f, (a, b, c), strict=True)]) for a in (0, 1) for b in (0, 1) for c in (0, 1))
        assert s == pytest.approx(total)
    assert np.isnan(got[3])
    sphere = lambda q: F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2]) - 1
    start = np.array([(2.0, 0, 0), (0.5, 0.5, 0.2), (0, -3, 1)])
    end = array(volume.implicit_closest(table(spark, start), sphere, steps=20))
    assert np.allclose(end, start / np.linalg.norm(start, axis=1)[:, None], atol=1e-4)


def test_scene_and_sets(spark, hills):
    scene = Scene()
    a, b = scene.add("one", hills), scene.add("two", hills)
    assert scene.picker_names() == ["001 : one", "002 : two"]
    scene.cut(a, clip.cut_with_plane(hills, (2, 0, 0), (1, 0, 0)))
    assert scene[a].name == "one_cut" and scene[a].undo() and scene[a].name == "one" and not scene[a].undo()
    c = scene.put(b, "_copy", hills, replaced=False)
    scene.remove(a)
    assert scene.position(c) == 1 and scene[c].name == "two_copy"
    with pytest.raises(KeyError):
        scene[a]
    assert sets.merge_all([hills, hills]).points.count() == 50
    with pytest.raises(ValueError, match="empty"):
        sets.merge_all([])
    pairs = spark.createDataFrame([(1, 2), (3, 1), (1, 1)], "x int, y int")
    assert [tuple(r) for r in sets.sort_pairs(pairs, "x", "y", reverse=True).collect()] == [(3, 1), (1, 2), (1, 1)]
    assert sets.chunk_bounds(3, 10) == [0, 3, 6, 10]
    rows = [r[0] for r in spark.range(2000).select(st.gaussian(5, 1.0, 2.0)).collect()]
    assert abs(np.mean(rows) - 1) < 0.2 and abs(np.std(rows) - 2) < 0.2 and rows == [r[0] for r in spark.range(2000).select(st.gaussian(5, 1.0, 2.0)).collect()]


def test_text_and_angles(spark):
    df = spark.createDataFrame([("1 2.5 x 3",), ("",)], "s string")
    assert [r[0] for r in df.select(tx.numbers_from_string(F.col("s"))).collect()] == [[1, 2.5], []]
    row = spark.createDataFrame([(' \t"a\r\nb;c,d" ',)], "s string").select(tx.strip_spaces(F.col("s")), tx.strip_newlines(F.col("s")), tx.replace_any(F.col("s"), ";,", "_"), tx.strip_quotes(tx.strip_spaces(F.col("s")))).first()
    assert row[0] == '"a\r\nb;c,d"' and row[1] == ' \t"ab;c,d" ' and row[2] == ' \t"a\r\nb_c_d" ' and row[3] == "a\r\nb;c,d"
    angles = spark.createDataFrame([(t / 3, p / 2) for t in range(-9, 20) for p in range(-9, 10)], "t double, p double")
    for r in angles.select("t", "p", *(c.alias(n) for c, n in zip(g.standard_spherical(F.col("t"), F.col("p")), "uv", strict=True))).collect():
        place = lambda t, p: (math.sin(t) * math.cos(p), math.sin(t) * math.sin(p), math.cos(t))
        assert 0 <= r["u"] <= math.pi and 0 <= r["v"] < 2 * math.pi + 1e-9 and np.allclose(place(r["t"], r["p"]), place(r["u"], r["v"]))


def test_stream_moments(spark, tmp_path):
    rng = np.random.default_rng(10)
    p = rng.normal(size=(30, 3))
    for i in range(3):
        table(spark, p[10 * i : 10 * i + 10]).withColumn("s", F.lit("a")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("pid long, x double, y double, z double, s string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    moments.start(stream, ["s"], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    row = moments.current(spark, f"{tmp_path}/out", ["s"]).first()
    assert row["n"] == 30 and np.allclose([row["c" + c] for c in "xyz"], p.mean(0))
    assert row["cov_xy"] == pytest.approx(np.cov(p.T, bias=True)[0, 1])


def test_spread_and_parities(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    seeds = spark.createDataFrame([(5,), (300,)], "node long")
    assert sorted(r[0] for r in graph.spread(seeds, links).collect()) == [*range(41), 300]
    odd = spark.createDataFrame([(0, 1, True), (1, 2, True), (2, 3, False)], "a long, b long, odd boolean")
    got = {r["node"]: r["flip"] for r in graph.parities(odd, spark.range(4).select(F.col("id").alias("node"))).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False}

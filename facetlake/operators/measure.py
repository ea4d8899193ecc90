"""Aggregates of clouds and meshes: moments, areas, angles, fits, the surface report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import statistics as st
from ..model import Mesh
from ..sharing import numbered, settled
from .clip import edges
from .spatial import neighbour_distances

XYZ = ("x", "y", "z")
PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def bounds(points: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Bounds, volume and diagonal of the bounding box of each group."""
    box = points.groupBy(*by).agg(*(f(c).alias(n + c) for c in XYZ for n, f in (("min_", F.min), ("max_", F.max))))
    sides = [F.col("max_" + c) - F.col("min_" + c) for c in XYZ]
    return box.withColumn("volume", sides[0] * sides[1] * sides[2]).withColumn("diagonal", F.sqrt(sum((s * s for s in sides[1:]), sides[0] * sides[0])))


def scene_bounds(clouds: list[DataFrame], include_origin: bool = True) -> DataFrame:
    """Bounds of all clouds together; with ``include_origin`` the origin counts as a point."""
    rows = clouds[0].select(*XYZ)
    for c in clouds[1:]:
        rows = rows.unionByName(c.select(*XYZ))
    box = rows.agg(*(f(c).alias(n + c) for c in XYZ for n, f in (("min_", F.min), ("max_", F.max))))
    if not include_origin:
        return box
    return box.select(*((F.least if n == "min_" else F.greatest)(F.coalesce(F.col(n + c), F.lit(0.0)), F.lit(0.0)).alias(n + c) for c in XYZ for n in ("min_", "max_")))


def center_of_mass(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(*(F.avg(c).alias("c" + c) for c in XYZ))


def center_distance(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, sdev) of the distances from each group's centre of mass."""
    rows = points.join(center_of_mass(points, by), by) if by else points.join(F.broadcast(center_of_mass(points, by)))
    rows = rows.withColumn("d", g.norm(g.sub(g.vector(*XYZ), g.vector("cx", "cy", "cz"))))
    return rows.groupBy(*by).agg(F.avg("d").alias("mean"), st.sdev(F.col("d")).alias("sdev"))


def covariance(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, cx, cy, cz, cov_xx .. cov_zz): mean and population covariance."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias("c" + c) for c in XYZ), *(F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in PAIRS))


def merged_covariance(parts: DataFrame, by: list[str]) -> DataFrame:
    """Pooled rows of ``covariance`` of disjoint chunks: the covariance of all their points."""
    w = Window.partitionBy(*by)
    total = F.sum("n").over(w)
    rows = parts.select(*by, "n", *(F.col("c" + c) for c in XYZ), *(F.col(f"cov_{a}{b}") for a, b in PAIRS), *((F.sum(F.col("n") * F.col("c" + c)).over(w) / total).alias("m" + c) for c in XYZ))
    pooled = lambda a, b: F.sum(F.col("n") * (F.col(f"cov_{a}{b}") + (F.col("c" + a) - F.col("m" + a)) * (F.col("c" + b) - F.col("m" + b)))) / F.sum("n")
    return rows.groupBy(*by).agg(F.sum("n").alias("N"), *(F.max("m" + c).alias("c" + c) for c in XYZ), *(pooled(a, b).alias(f"cov_{a}{b}") for a, b in PAIRS)).withColumnRenamed("N", "n")


def pca(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, eigenvalues descending, axes in columns) of a cloud; the largest part of each axis is positive."""
    row = covariance(points, []).first()
    cov = np.array([[row["cov_" + "".join(sorted(a + b))] or 0.0 for b in XYZ] for a in XYZ])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(3)])
    return np.array([row["c" + c] or 0.0 for c in XYZ]), values, axes


def fit_plane(points: DataFrame, size: float = 1.0) -> np.ndarray:
    """Three points (origin, point1, point2) of the least-squares plane: the two main axes, scaled by sqrt(eigenvalue) * size."""
    mean, values, axes = pca(points)
    u, v = (axes[:, i] * np.sqrt(max(values[i], 0)) * size for i in (0, 1))
    origin = mean - (u + v) / 2
    return np.array([origin, origin + u, origin + v])


def principal_transform(points: DataFrame, rotate: bool = True, translate: bool = True, scaled: bool = False) -> np.ndarray:
    """4x4 that takes the unit frame to the principal axes (right-handed), spread by the standard deviations, at the mean."""
    mean, values, axes = pca(points)
    m = np.eye(4)
    if np.linalg.det(axes) < 0:
        axes[:, 2] = -axes[:, 2]
    part = axes if rotate else np.eye(3)
    m[:3, :3] = part * np.sqrt(np.maximum(values, 0)) if scaled else part
    if translate:
        m[:3, 3] = mean
    return m


def line_intersection(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y, z): the place nearest to all lines (px.. to qx..) of each group; no row where a line has no length or all are parallel."""
    p, d = g.vector("px", "py", "pz"), g.sub(g.vector("qx", "qy", "qz"), g.vector("px", "py", "pz"))
    u = g.normalised(d)
    pu = g.dot(p, u)
    m = {(i, j): F.sum((1.0 if i == j else 0.0) - u[i] * u[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)}
    r = [F.sum(p[i] - u[i] * pu).alias(f"r{i}") for i in range(3)]
    rows = lines.groupBy(*by).agg(*m.values(), *r, F.min(g.dot(d, d)).alias("least")).where("least > 0")
    c = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    cols = [tuple(c(i, j) for i in range(3)) for j in range(3)]
    rhs = tuple(F.col(f"r{i}") for i in range(3))
    det = g.dot(cols[0], g.cross(cols[1], cols[2]))
    by_column = [g.dot(rhs, g.cross(cols[1], cols[2])), g.dot(cols[0], g.cross(rhs, cols[2])), g.dot(cols[0], g.cross(cols[1], rhs))]
    solved = rows.select(*by, *(F.when(F.abs(det) > 1e-12, F.try_divide(v, det)).alias(x) for v, x in zip(by_column, XYZ, strict=True)))
    return solved.where("x is not null")


def ransac_intersection(lines: DataFrame, iterations: int = 100, limit2: float = 400.0, seed: int = 0) -> DataFrame | None:
    """Intersection of the lines (lid, px.. to qx..) in agreement with the best of seeded pairs; None unless over half agree.

    A line agrees where its squared distance from the seeds' intersection is under ``limit2``. Pairs come from a seeded
    generator, so a run can be repeated.
    """
    rng = np.random.default_rng(seed)
    n = lines.count()
    if n < 2:
        return None
    picks = np.array([rng.choice(n, 2, replace=False) for _ in range(iterations)])
    spark = lines.sparkSession
    order = numbered(lines, "at", "lid")
    seeds = spark.createDataFrame([(i, int(k)) for i, pair in enumerate(picks) for k in pair], "trial int, at long")
    found = line_intersection(order.join(F.broadcast(seeds), "at"), ["trial"])
    p, u = g.vector("px", "py", "pz"), g.normalised(g.sub(g.vector("qx", "qy", "qz"), g.vector("px", "py", "pz")))
    w = g.sub(g.vector("x", "y", "z"), p)
    off = g.cross(w, u)
    near = lines.join(F.broadcast(found)).where(g.dot(off, off) < limit2)
    best = near.groupBy("trial").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trial").first()
    if best is None or 2 * best["n"] <= n:
        return None
    return line_intersection(near.where(F.col("trial") == best["trial"]), [])


def triangle_sides(mesh: Mesh) -> DataFrame:
    """(tid, cid, la, lb, lc, area): lengths opposite to each corner and area."""
    t = mesh.placed_triangles()
    a, b, c = (g.vector(k + "x", k + "y", k + "z") for k in "abc")
    length = lambda p, q: g.norm(g.sub(p, q))
    return t.select("tid", "cid", length(b, c).alias("la"), length(c, a).alias("lb"), length(a, b).alias("lc"), (0.5 * g.norm(g.cross(g.sub(b, a), g.sub(c, a)))).alias("area"))


def surface_area(mesh: Mesh) -> DataFrame:
    """One row (area) over triangles and strips' triangles; polygons of more corners count as fans."""
    return triangle_sides(mesh).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def triangle_angles(mesh: Mesh) -> DataFrame:
    """(tid, cid, aa, ab, ac): corner angles in degrees; triangles with two equal corners are left out."""
    t = mesh.placed_triangles()
    a, b, c = (g.vector(k + "x", k + "y", k + "z") for k in "abc")
    corner = lambda p, q, r: g.angle_degrees(g.sub(q, p), g.sub(r, p))
    return t.select("tid", "cid", corner(a, b, c).alias("aa"), corner(b, c, a).alias("ab"), corner(c, a, b).alias("ac")).where("aa is not null and ab is not null and ac is not null")


def minimum_angles(mesh: Mesh) -> DataFrame:
    return triangle_angles(mesh).select("tid", "cid", F.least("aa", "ab", "ac").alias("angle"))


def mean_minimum_angle(mesh: Mesh) -> DataFrame:
    """One row (angle): the mean over triangles of the least corner angle, in degrees; 0 without triangles."""
    return minimum_angles(mesh).agg(F.coalesce(F.avg("angle"), F.lit(0.0)).alias("angle"))


def edge_lengths(mesh: Mesh) -> DataFrame:
    """(a, b, length) of the distinct undirected edges."""
    rows = edges(mesh).select("a", "b").distinct()
    for k in "ab":
        rows = rows.join(mesh.points.select(F.col("pid").alias(k), *(F.col(c).alias(k + c) for c in XYZ)), k)
    return rows.select("a", "b", g.norm(g.sub(g.vector("ax", "ay", "az"), g.vector("bx", "by", "bz"))).alias("length"))


def edge_regularity(mesh: Mesh) -> DataFrame:
    return edge_lengths(mesh).agg(F.count("*").alias("edges"), F.avg("length").alias("mean"), st.sdev(F.col("length")).alias("sdev"))


def polygon_area(polygon: DataFrame, by: list[str]) -> DataFrame:
    """(by, area): half the length of the sum of cross products of following points, without the closing term: repeat the first point."""
    w = Window.partitionBy(*by).orderBy("ord")
    rows = polygon.select(*by, *XYZ, *(F.lead(c).over(w).alias("e" + c) for c in XYZ)).where("ex is not null")
    s = g.cross(g.vector(*XYZ), g.vector("ex", "ey", "ez"))
    summed = rows.groupBy(*by).agg(*(F.sum(v).alias("s" + c) for v, c in zip(s, XYZ, strict=True)))
    return summed.select(*by, (0.5 * g.norm(g.vector("sx", "sy", "sz"))).alias("area"))


def section_segments(mesh: Mesh, origin, normal) -> DataFrame:
    """(tid, e, f, ex, ey, ez, fx, fy, fz): where a plane cuts the triangles; e and f are the cut edges (lesser and greater end)."""
    t = mesh.placed_triangles()
    o, n = g.vector(*origin), g.vector(*normal)
    places = {k: g.vector(k + "x", k + "y", k + "z") for k in "abc"}
    t = t.withColumns({"f" + k: g.dot(g.sub(p, o), n) for k, p in places.items()})
    hits = []
    for p, q in ("ab", "bc", "ca"):
        s = F.try_divide(F.col("f" + p), F.col("f" + p) - F.col("f" + q))
        at = g.add(places[p], g.scale(g.sub(places[q], places[p]), s))
        edge = F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
        hits.append(F.when((F.col("f" + p) > 0) != (F.col("f" + q) > 0), F.struct(edge.alias("edge"), *(v.alias(c) for v, c in zip(at, XYZ, strict=True)))))
    found = t.select("tid", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("h")).where("size(h) = 2")
    return found.select("tid", *(F.col("h")[i]["edge"].alias(e) for i, e in enumerate("ef")), *(F.col("h")[i][c].alias(e + c) for i, e in enumerate("ef") for c in XYZ))


def section_loops(mesh: Mesh, origin, normal) -> DataFrame:
    """(loop, segments, area) of the closed loops in which a plane cuts a surface.

    Segments meet in the edges that they cut. Each is turned so that it goes on where another one ends (by parities, in few rounds),
    whichever way the triangles are turned; half the sum of cross products then is the area. Where a loop crosses an edge of more
    or less than two triangles it isn't closed and is left out.
    """
    from .graph import parities

    seg = settled(numbered(section_segments(mesh, origin, normal), "s", "tid"))
    ends = seg.select("s", F.explode(F.array(F.struct(F.col("e").alias("edge"), F.lit(False).alias("head")), F.struct(F.col("f").alias("edge"), F.lit(True).alias("head")))).alias("p")).select("s", "p.edge", "p.head")
    meet = ends.groupBy("edge").agg(F.count("*").alias("n"), F.min(F.struct("s", "head")).alias("m"), F.max(F.struct("s", "head")).alias("k"))
    links = meet.where("n = 2").select(F.col("m.s").alias("a"), F.col("k.s").alias("b"), (F.col("m.head") == F.col("k.head")).alias("odd"))
    of = settled(parities(links, seg.select(F.col("s").alias("node"))).withColumnRenamed("node", "s"))
    broken = ends.join(meet.where("n <> 2").select("edge"), "edge", "left_semi").join(of, "s").select("label").distinct()
    rows = seg.join(of, "s").join(broken, "label", "left_anti")
    e, f = (g.sub(g.vector(*(k + c for c in XYZ)), g.vector(*origin)) for k in "ef")
    turn = F.when(F.col("flip"), -1.0).otherwise(1.0)
    summed = rows.groupBy(F.col("label").alias("loop")).agg(F.count("*").alias("segments"), *(F.sum(turn * v).alias("s" + c) for v, c in zip(g.cross(e, f), XYZ, strict=True)))
    return summed.select("loop", "segments", (0.5 * g.norm(g.vector("sx", "sy", "sz"))).alias("area"))


def section_area(mesh: Mesh, origin, normal) -> DataFrame:
    """One row (area): that of the largest closed loop in which a plane cuts a surface, 0 without one."""
    return section_loops(mesh, origin, normal).agg(F.coalesce(F.max("area"), F.lit(0.0)).alias("area"))


def nn_statistics(points: DataFrame) -> DataFrame:
    """One row: count, least, greatest, mean, sdev, median, 5 % and 95 % of the nearest-neighbour distances."""
    d = neighbour_distances(points).withColumn("_g", F.lit(0))
    parts = st.fractiles(d, ["_g"], "distance", {"median": 0.5, "p05": 0.05, "p95": 0.95})
    rest = d.groupBy("_g").agg(F.count("*").alias("n"), F.min("distance").alias("min"), F.max("distance").alias("max"), F.avg("distance").alias("mean"), st.sdev(F.col("distance")).alias("sdev"))
    return rest.join(parts, "_g").drop("_g")


def poly_info(mesh: Mesh) -> DataFrame:
    """One row: points, verts, lines, polys, strips."""
    kinds = mesh.cells.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("verts", "lines", "polys", "strips")))
    return mesh.points.agg(F.count("*").alias("points")).join(F.broadcast(kinds))


def surface_report(points: DataFrame, by: list[str]) -> DataFrame:
    """Per group: points, scalar statistics with order statistics, bounds and volume of the points' box."""
    s = F.col("scalar")
    stats = points.groupBy(*by).agg(
        F.count("*").alias("points"),
        F.min(s).alias("scalar_min"),
        F.max(s).alias("scalar_max"),
        F.avg(s).alias("scalar_mean"),
        st.sdev(s).alias("scalar_sdev"),
        st.rms(s).alias("scalar_rms"),
        *(f(c).alias(n + c) for c in XYZ for n, f in (("min_", F.min), ("max_", F.max))),
    )
    stats = stats.withColumn("volume", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z")))
    order = st.fractiles(points, by, "scalar", {"scalar_median": 0.5, "scalar_p05": 0.05, "scalar_p95": 0.95})
    return stats.join(order, by, "left")


def mesh_report(mesh: Mesh) -> DataFrame:
    """(section, key, value) rows about one mesh: cell kinds, arrays, scalar and cell-scalar statistics, bounds."""
    spark = mesh.points.sparkSession
    one = mesh.points.withColumn("_g", F.lit(0))
    parts = [spark.createDataFrame([("arrays", c, 1.0) for c in mesh.points.columns if c not in ("pid", *XYZ)] or [("arrays", "none", 0.0)], "section string, key string, value double")]
    parts.append(mesh.cells.groupBy("kind").agg(F.count("*").cast("double").alias("value")).select(F.lit("cells").alias("section"), F.col("kind").alias("key"), "value"))

    def tall(df: DataFrame, section: str) -> DataFrame:
        columns = [c for c in df.columns if c != "_g"]
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns))).alias("r")).select(F.lit(section).alias("section"), "r.*")

    if mesh.has_scalar:
        parts.append(tall(surface_report(one, ["_g"]), "points"))
    else:
        parts.append(tall(bounds(mesh.points), "bounds"))
    if "cell_scalar" in mesh.cells.columns:
        s = F.col("cell_scalar")
        parts.append(tall(mesh.cells.agg(F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("mean"), st.sdev(s).alias("sdev")), "cell scalars"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(r, c, value) of the product of two matrices in that form; missing cells are 0."""
    left = a.select("r", F.col("c").alias("k"), F.col("value").alias("p"))
    right = b.select(F.col("r").alias("k"), "c", F.col("value").alias("q"))
    return left.join(right, "k").groupBy("r", "c").agg(F.sum(F.col("p") * F.col("q")).alias("value"))


def matrix_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("c").alias("r"), F.col("r").alias("c"), "value")


def small_cov_compat(a: DataFrame) -> DataFrame:
    """A A^T / (columns - 1), without removal of the means."""
    n = a.agg((F.max("c") + 1).alias("n"))
    return matrix_product(a, matrix_transpose(a)).join(F.broadcast(n)).select("r", "c", F.try_divide("value", F.col("n") - 1).alias("value"))


def difference_stats(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    d = F.col(x) - F.col(y)
    return pairs.groupBy(*by).agg(F.sum(d * d).alias("sum_sq_diff"), F.avg(F.abs(d)).alias("mean_abs_diff"), st.correlation(F.col(x), F.col(y)).alias("correlation"))


def index_range(values: DataFrame, index: str, value: str, low: int, high: int) -> DataFrame:
    """Mean and sdev of the values with low <= index < high."""
    return values.where((F.col(index) >= low) & (F.col(index) < high)).agg(F.avg(value).alias("mean"), st.sdev(F.col(value)).alias("sdev"))



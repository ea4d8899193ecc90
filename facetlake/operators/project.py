"""Per-row operators: placement, mirroring, normals, planes, lines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Mesh

XYZ, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")


def _put(df: DataFrame, names, values) -> DataFrame:
    return df.withColumns(dict(zip(names, values, strict=True)))


def apply_transform(mesh: Mesh, matrix) -> Mesh:
    """Points by a 4x4 matrix, normals by the inverse transpose of its 3x3 part, then normalised."""
    m = np.array(matrix, float).reshape(4, 4)
    p = [F.col(c) for c in XYZ]
    df = mesh.points
    if mesh.has_normals:
        n, t = [F.col(c) for c in NORMAL], np.linalg.inv(m[:3, :3]).T
        turned = tuple(sum((float(t[i, j]) * n[j] for j in range(1, 3)), float(t[i, 0]) * n[0]) for i in range(3))
        df = _put(df, NORMAL, g.normalised(turned))
    return mesh.with_points(_put(df, XYZ, [float(m[i, 0]) * p[0] + float(m[i, 1]) * p[1] + float(m[i, 2]) * p[2] + float(m[i, 3]) for i in range(3)]))


def mirror(mesh: Mesh, origin, normal) -> Mesh:
    """Reflect in a plane; normals become mirrored(p) - mirrored(p - n) negated twice: the tip p - n is mirrored, then normalised."""
    o, n = g.vector(*origin), np.array(normal, float) / np.linalg.norm(normal)
    n = g.vector(*n.tolist())
    flip = lambda p: g.sub(p, g.scale(n, 2 * g.dot(g.sub(p, o), n)))
    p = g.vector(*XYZ)
    df = mesh.points
    if mesh.has_normals:
        tip = flip(g.sub(p, g.vector(*NORMAL)))
        return mesh.with_points(_put(df, XYZ + NORMAL, (*flip(p), *g.normalised(g.sub(tip, flip(p))))))
    return mesh.with_points(_put(df, XYZ, flip(p)))


def flip_x(mesh: Mesh) -> Mesh:
    """x becomes -x; normals, where there are, should be computed anew."""
    return mesh.with_points(mesh.points.withColumn("x", -F.col("x")))


def normal_lines(mesh: Mesh, share: float = 0.01) -> DataFrame:
    """(pid, x, y, z): two rows a point, itself and the tip of its normal of 1 % of the diagonal; ids interleave."""
    box = mesh.points.agg(*(F.max(c) - F.min(c) for c in XYZ)).toDF("dx", "dy", "dz").select((share * F.sqrt(F.expr("dx * dx + dy * dy + dz * dz"))).alias("len"))
    p, n = g.vector(*XYZ), g.vector(*NORMAL)
    ends = F.array(*(F.struct((F.col("pid") * 2 + k).alias("pid"), *((a + b * F.col("len") * k).alias(c) for a, b, c in zip(p, n, XYZ, strict=True))) for k in (0, 1)))
    return mesh.points.join(F.broadcast(box)).select(F.explode(ends).alias("e")).select("e.*")


def normals_from_point(mesh: Mesh, camera) -> Mesh:
    return mesh.with_points(_put(mesh.points, NORMAL, g.normalised(g.sub(g.vector(*camera), g.vector(*XYZ)))))


def animate(mesh: Mesh, moves: DataFrame, t: float) -> Mesh:
    """p + t * d by equal pid; ValueError where the counts differ. ``moves`` has (pid, x, y, z)."""
    if mesh.points.count() != moves.count():
        raise ValueError("points and displacements differ in number")
    d = moves.select("pid", *(F.col(c).alias("d" + c) for c in XYZ))
    return mesh.with_points(_put(mesh.points.join(d, "pid"), XYZ, [F.col(c) + t * F.col("d" + c) for c in XYZ]).drop("dx", "dy", "dz"))


def center_of_mass(points: DataFrame) -> DataFrame:
    """One row (cx, cy, cz); zeros for no points."""
    return points.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias("c" + c) for c in XYZ))


def to_origin(mesh: Mesh) -> Mesh:
    df = mesh.points.join(F.broadcast(center_of_mass(mesh.points)))
    return mesh.with_points(_put(df, XYZ, [F.col(c) - F.col("c" + c) for c in XYZ]).drop("cx", "cy", "cz"))


def normalise_size(mesh: Mesh, size: float) -> tuple[Mesh, DataFrame]:
    """scale * (p - CM) with scale = size / longest side, and the row (cx, cy, cz, scale)."""
    longest = F.greatest(*(F.max(c) - F.min(c) for c in XYZ))
    how = mesh.points.agg(*(F.avg(c).alias("c" + c) for c in XYZ), g.divided(F.lit(float(size)), longest, 1.0).alias("scale"))
    df = mesh.points.join(F.broadcast(how))
    return mesh.with_points(_put(df, XYZ, [F.col("scale") * (F.col(c) - F.col("c" + c)) for c in XYZ]).drop("cx", "cy", "cz", "scale")), how


def plane_parameters(o: g.Vector, p1: g.Vector, p2: g.Vector) -> tuple[Column, ...]:
    """(A, B, C, D, side): plane through three points with a 4-vector of norm 1, and the mean of two edge lengths."""
    a, b = g.sub(p1, o), g.sub(p2, o)
    n = g.cross(a, b)
    d = -g.dot(n, o)
    size = F.sqrt(g.dot(n, n) + d * d)
    return (*(g.divided(x, size) for x in (*n, d)), (g.norm(a) + g.norm(b)) / 2)


def matrix_from_line(p1, p2, theta: float) -> np.ndarray:
    """4x4: z axis onto the line from p1 to p2, placed at p1, after a turn by theta degrees about it."""
    p1, d = np.array(p1, float), np.array(p2, float) - np.array(p1, float)
    z = d / np.linalg.norm(d)
    x = np.cross([0, 1, 0] if abs(z[1]) < 0.9 else [1, 0, 0], z)
    x /= np.linalg.norm(x)
    turn = math.radians(theta)
    spin = np.array([[math.cos(turn), -math.sin(turn), 0], [math.sin(turn), math.cos(turn), 0], [0, 0, 1]])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = np.column_stack((x, np.cross(z, x), z)) @ spin, p1
    return m


def side_of(p: g.Vector, origin: g.Vector, normal: g.Vector) -> Column:
    """Positive in front of the plane, negative behind."""
    return g.dot(g.sub(p, origin), normal)


def grid_id(ix: Column, iy: Column, iz: Column, dx: int, dy: int) -> Column:
    return ix + iy * dx + iz * dx * dy


def grid_xyz(vid: Column, dx: int, dy: int) -> tuple[Column, Column, Column]:
    return vid % dx, F.floor(vid / dx) % dy, F.floor(vid / (dx * dy))


def polygon_basis(polygon: DataFrame, by: list[str]) -> DataFrame:
    """(by, ox..oz centroid, v1x.., v2x.., nx..): basis of the plane of each polygon (by, ord, x, y, z), from points 0, N/3, 2N/3."""
    n = F.count("*").over(Window.partitionBy(*by))
    rows = polygon.withColumn("n", n)
    pick = lambda at, c: F.max(F.when(F.col("ord") == at, F.col(c)))
    some = rows.groupBy(*by).agg(*(F.avg(c).alias("o" + c) for c in XYZ), *(pick(at, c).alias(name + c) for name, at in (("p", F.lit(0)), ("q", F.floor(F.col("n") / 3)), ("r", F.floor(2 * F.col("n") / 3))) for c in XYZ))
    p, q, r = (g.vector(*(k + c for c in XYZ)) for k in "pqr")
    v1 = g.normalised(g.sub(q, p))
    normal = g.normalised(g.cross(v1, g.sub(r, p)))
    v2 = g.cross(v1, normal)
    return some.select(*by, "ox", "oy", "oz", *(v.alias(k + c) for k, w in (("v1", v1), ("v2", v2), ("n", normal)) for v, c in zip(w, XYZ, strict=True)))


def polygon_2d(polygon: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, px, py): polygon points in the basis of their plane, about the centroid."""
    rows = polygon.join(polygon_basis(polygon, by), by)
    d = g.sub(g.vector(*XYZ), g.vector("ox", "oy", "oz"))
    return rows.select(*by, "ord", g.dot(d, g.vector("v1x", "v1y", "v1z")).alias("px"), g.dot(d, g.vector("v2x", "v2y", "v2z")).alias("py"))


def segments_of(line: DataFrame, by: list[str]) -> DataFrame:
    """(by, seg, x, y, z, ex, ey, ez, len, before): pieces between following points of each line (by, ord, x, y, z)."""
    w = Window.partitionBy(*by).orderBy("ord")
    rows = line.select(*by, F.col("ord").alias("seg"), *XYZ, *(F.lead(c).over(w).alias("e" + c) for c in XYZ)).where("ex is not null")
    rows = rows.withColumn("len", g.norm(g.sub(g.vector("ex", "ey", "ez"), g.vector(*XYZ))))
    past = Window.partitionBy(*by).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("len").over(past), F.lit(0.0)))


def walk(line: DataFrame, by: list[str], distance: float) -> DataFrame:
    """(by, seg, t, x, y, z): the place at an arc length from each line's start; no row where the line is shorter."""
    found = segments_of(line, by).where((F.col("before") <= distance) & (F.lit(distance) < F.col("before") + F.col("len")))
    t = (F.lit(float(distance)) - F.col("before")) / F.col("len")
    return found.select(*by, "seg", t.alias("t"), *((F.col(c) + t * (F.col("e" + c) - F.col(c))).alias(c) for c in XYZ))


def plane_crossing(line: DataFrame, by: list[str], origin, normal) -> DataFrame:
    """(by, seg, t, x, y, z): the first place where each line crosses a plane."""
    o, n = g.vector(*origin), g.vector(*normal)
    rows = segments_of(line, by)
    a, b = side_of(g.vector(*XYZ), o, n), side_of(g.vector("ex", "ey", "ez"), o, n)
    rows = rows.withColumn("t", F.try_divide(a, a - b)).where((F.col("t") >= 0) & (F.col("t") <= 1))
    first = rows.groupBy(*by).agg(F.min_by(F.struct("seg", "t", *XYZ, "ex", "ey", "ez"), "seg").alias("s")).select(*by, "s.*")
    return first.select(*by, "seg", "t", *((F.col(c) + F.col("t") * (F.col("e" + c) - F.col(c))).alias(c) for c in XYZ))


#: Fixed: the ramps by number, as (from, to) of hue, saturation and brightness: rainbow, blue to skin, grey to blue, inverse
#: rainbow, dark grey to golden, hot, grey.
RAMPS = [
    ((2 / 3, 0.0), (1.0, 1.0), (1.0, 1.0)),
    ((240 / 360, 0.0), (0.7, 0.3), (1.0, 0.93)),
    ((0.3, 0.6), (0.0, 0.8), (0.5, 0.8)),
    ((0.0, 2 / 3), (1.0, 1.0), (1.0, 1.0)),
    ((50 / 360, 50 / 360), (0.0, 0.85), (0.5, 0.8)),
    ((0.0, 60 / 360), (1.0, 1.0), (0.5, 1.0)),
    ((0.0, 0.0), (0.0, 0.0), (0.2, 0.8)),
]


def color_ramp(value: Column, low: float, high: float, ramp: int = 0) -> Column:
    """A value as rgb (0..255) on one of the RAMPS, in even steps of hue, saturation and brightness; clamped to the range."""
    at = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    h, s, v = (a + at * (b - a) for a, b in RAMPS[ramp])
    k = lambda n: F.pmod(n + h * 6, F.lit(6.0))
    part = lambda n: F.round(255 * (v - v * s * F.greatest(F.least(k(n), 4 - k(n), F.lit(1.0)), F.lit(0.0)))).cast("smallint")
    return F.array(part(5.0), part(3.0), part(1.0))


def next_color(index: Column, palette: list[list[int]]) -> Column:
    """Palette colours in turn."""
    colors = F.array(*(F.array(*(F.lit(v) for v in c)) for c in palette))
    return F.element_at(colors, (index % len(palette) + 1).cast("int"))

"""Primitives as tables made from ranges."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Mesh

#: Corners of each face of a hexahedron; l/r is low/high x, b/t is low/high y, n/f is low/high z.
TRAPEZOID_FACES = [
    ["lbn", "rbn", "rbf", "lbf"],
    ["ltn", "ltf", "rtf", "rtn"],
    ["lbn", "lbf", "ltf", "ltn"],
    ["rbf", "rbn", "rtn", "rtf"],
    ["lbf", "rbf", "rtf", "ltf"],
    ["rbn", "lbn", "ltn", "rtn"],
]


def faces(spark: SparkSession, corners: dict[str, tuple[float, float, float]], named: list[list[str]], normals: list[tuple[float, float, float]]) -> Mesh:
    rows = [(4 * f + k, *map(float, corners[c]), *map(float, normals[f])) for f, face in enumerate(named) for k, c in enumerate(face)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double")
    cells = spark.createDataFrame([(f, "polys", [4 * f + k for k in range(4)]) for f in range(len(named))], "cid long, kind string, pids array<long>")
    return Mesh(points, cells)


def trapezoid(spark: SparkSession, xl: float, yl: float, zl: float, alpha: float, beta: float, cap: bool = True, center=(0.0, 0.0, 0.0)) -> Mesh:
    """A trapezoid prism: the upper face is shorter by tan(90 - angle) * yl at each side; 24 or, open, 16 points."""
    a, b = math.radians(alpha), math.radians(beta)
    da, db = math.tan(math.pi / 2 - a) * yl, math.tan(math.pi / 2 - b) * yl
    corners = {}
    for x in "lr":
        for y in "bt":
            for z in "nf":
                shift = 0 if y == "b" else da if x == "l" else -db
                corners[x + y + z] = (center[0] + (xl / 2 if x == "r" else -xl / 2) + shift, center[1] + (yl / 2 if y == "t" else -yl / 2), center[2] + (zl / 2 if z == "f" else -zl / 2))
    normals = [(0, -1, 0), (0, 1, 0), (-math.sin(a), math.cos(a), 0), (math.sin(b), math.cos(b), 0), (0, 0, 1), (0, 0, -1)]
    n = 6 if cap else 4
    return faces(spark, corners, TRAPEZOID_FACES[:n], normals[:n])


def cube(spark: SparkSession, xl: float = 1.0, yl: float = 1.0, zl: float = 1.0, center=(0.0, 0.0, 0.0)) -> Mesh:
    """A box of 6 quads with points of their own; in order -x, +x, -y, +y, -z, +z."""
    half = (xl / 2, yl / 2, zl / 2)
    corners = {f"{i}{j}{k}": tuple(c + (h if b else -h) for c, h, b in zip(center, half, (i, j, k), strict=True)) for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    named = [["000", "001", "011", "010"], ["100", "110", "111", "101"], ["000", "100", "101", "001"], ["010", "011", "111", "110"], ["000", "010", "110", "100"], ["001", "101", "111", "011"]]
    return faces(spark, corners, named, [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)])


def sphere(spark: SparkSession, radius: float = 1.0, theta=(0.0, 360.0), phi=(0.0, 180.0), theta_res: int = 50, phi_res: int = 50, center=(0.0, 0.0, 0.0)) -> Mesh:
    """A full or partial sphere by latitude: poles where phi reaches 0 or 180, and rings between.

    Point ids: north pole, south pole (where there are), then ring by ring. A whole turn of theta is closed.
    """
    north, south = phi[0] <= 0, phi[1] >= 180
    closed = abs(theta[1] - theta[0]) >= 360
    rings = max(1, phi_res - north - south)
    across = theta_res if closed else theta_res + 1
    d_phi = (phi[1] - phi[0]) / max(1, phi_res - 1)
    d_theta = (theta[1] - theta[0]) / theta_res
    first = int(north) + int(south)
    i, j = F.floor(F.col("id") / across), F.col("id") % across
    p = F.radians(F.lit(float(phi[0])) + (i + int(north)) * d_phi)
    t = F.radians(F.lit(float(theta[0])) + j * d_theta)
    unit = (F.sin(p) * F.cos(t), F.sin(p) * F.sin(t), F.cos(p))
    ring = spark.range(rings * across).select((F.col("id") + first).alias("pid"), *(u.alias(c) for u, c in zip(unit, ("nx", "ny", "nz"), strict=True)))
    poles = [(0, 0.0, 0.0, 1.0)] * north + [(int(north), 0.0, 0.0, -1.0)] * south
    both = ring.unionByName(spark.createDataFrame(poles, "pid long, nx double, ny double, nz double")) if poles else ring
    points = both.select("pid", *((F.col(n) * float(radius) + float(c)).alias(x) for n, c, x in zip(("nx", "ny", "nz"), center, "xyz", strict=True)), "nx", "ny", "nz")
    i, j = F.floor(F.col("id") / theta_res), F.col("id") % theta_res
    nxt = (j + 1) % across
    a, b = first + i * across + j, first + i * across + nxt
    parts = []
    if north:
        parts.append(spark.range(theta_res).select(F.lit(0).alias("part"), F.col("id").alias("k"), F.array(F.lit(0).cast("long"), first + F.col("id"), first + (F.col("id") + 1) % across).alias("pids")))
    if rings > 1:
        quads = spark.range((rings - 1) * theta_res).select(F.lit(1).alias("part"), F.col("id").alias("k"), a.alias("a"), b.alias("b"))
        parts.append(quads.select("part", (2 * F.col("k")).alias("k"), F.array("a", F.col("a") + across, F.col("b")).alias("pids")))
        parts.append(quads.select("part", (2 * F.col("k") + 1).alias("k"), F.array(F.col("b"), F.col("a") + across, F.col("b") + across).alias("pids")))
    if south:
        last = first + (rings - 1) * across
        parts.append(spark.range(theta_res).select(F.lit(2).alias("part"), F.col("id").alias("k"), F.array(last + F.col("id"), F.lit(int(north)).cast("long"), last + (F.col("id") + 1) % across).alias("pids")))
    cells, sizes = parts[0], {0: theta_res if north else 0, 1: 2 * (rings - 1) * theta_res, 2: theta_res}
    for part in parts[1:]:
        cells = cells.unionByName(part)
    start = F.when(F.col("part") == 0, 0).when(F.col("part") == 1, sizes[0]).otherwise(sizes[0] + sizes[1])
    return Mesh(points, cells.select((start + F.col("k")).cast("long").alias("cid"), F.lit("polys").alias("kind"), F.transform("pids", lambda x: x.cast("long")).alias("pids")))


def cylinder(spark: SparkSession, radius: float = 0.5, height: float = 1.0, res: int = 12, cap: bool = True, center=(0.0, 0.0, 0.0)) -> Mesh:
    """A cylinder about the y axis: 2 * res points of the side, and 2 * res more for two polygon caps."""
    k = F.col("id") % res
    level = F.floor(F.col("id") / res)  # side low, side high, cap low, cap high
    t = F.radians(k * (360.0 / res))
    up = F.when(level % 2 == 1, 1.0).otherwise(-1.0)
    side = level < 2
    points = spark.range(res * (4 if cap else 2)).select(
        F.col("id").alias("pid"),
        (F.cos(t) * radius + center[0]).alias("x"),
        (up * (height / 2) + center[1]).alias("y"),
        (-F.sin(t) * radius + center[2]).alias("z"),
        F.when(side, F.cos(t)).otherwise(0.0).alias("nx"),
        F.when(side, 0.0).otherwise(up).alias("ny"),
        F.when(side, -F.sin(t)).otherwise(0.0).alias("nz"),
    )
    nxt = (F.col("id") + 1) % res
    cells = spark.range(res).select(F.col("id").alias("cid"), F.lit("polys").alias("kind"), F.array(F.col("id"), nxt, nxt + res, F.col("id") + res).alias("pids"))
    if cap:
        rows = [(res, "polys", [3 * res - 1 - i for i in range(res)]), (res + 1, "polys", [3 * res + i for i in range(res)])]
        cells = cells.unionByName(spark.createDataFrame(rows, "cid long, kind string, pids array<long>"))
    return Mesh(points, cells)


def plane_grid(spark: SparkSession, n: int, size: float = 1.0) -> Mesh:
    """n x n quads in the plane z = 0."""
    w = n + 1
    points = spark.range(w * w).select(F.col("id").alias("pid"), ((F.col("id") % w) * (size / n)).alias("x"), (F.floor(F.col("id") / w) * (size / n)).alias("y"), F.lit(0.0).alias("z"))
    a = F.floor(F.col("id") / n) * w + F.col("id") % n
    return Mesh(points, spark.range(n * n).select(F.col("id").alias("cid"), F.lit("polys").alias("kind"), F.array(a, a + 1, a + 1 + w, a + w).alias("pids")))


def pca_blob(spark: SparkSession, points: DataFrame, res: int = 50) -> Mesh:
    """The unit sphere on the principal axes of a cloud, spread by the standard deviations along them."""
    from .measure import principal_transform
    from .project import apply_transform

    return apply_transform(sphere(spark, theta_res=res, phi_res=res), principal_transform(points, scaled=True))


def stamped(shape: Mesh, at: DataFrame) -> Mesh:
    """A shape, sized and moved, at each of the rows (of, cx, cy, cz, size); the shape is small and its ids are dense from 0.

    Point and cell ids are those of the shape after ``of`` times their number, so that equal shapes stay apart.
    """
    n, m = shape.points.count(), shape.cells.count()
    more = [c for c in ("nx", "ny", "nz") if shape.has_normals]
    at = at.select("of", "cx", "cy", "cz", "size")
    points = at.join(F.broadcast(shape.points)).select((F.col("of") * n + F.col("pid")).alias("pid"), *((F.col("c" + c) + F.col("size") * F.col(c)).alias(c) for c in "xyz"), *more)
    cells = at.join(F.broadcast(shape.cells)).select((F.col("of") * m + F.col("cid")).alias("cid"), "kind", F.transform("pids", lambda p: F.col("of") * n + p).alias("pids"))
    return Mesh(points, cells)


def glyphs(mesh: Mesh, radius: float = 0.0, res: int = 20) -> Mesh:
    """A sphere at every point; radius 0 stands for 0.5 % of the diagonal of the bounds. The sphere's size is fixed by ``res``."""
    ball = sphere(mesh.points.sparkSession, 1.0, theta_res=res, phi_res=res)
    box = mesh.points.agg(*(F.max(c) - F.min(c) for c in "xyz")).toDF("dx", "dy", "dz")
    size = box.select((F.lit(float(radius)) if radius > 0 else 0.005 * F.sqrt(F.expr("dx * dx + dy * dy + dz * dz"))).alias("size"))
    return stamped(ball, mesh.points.select(F.col("pid").alias("of"), *(F.col(c).alias("c" + c) for c in "xyz")).join(F.broadcast(size)))

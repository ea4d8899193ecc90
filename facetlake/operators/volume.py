"""Volumes as tables of voxels: grids, distance fields, bands, smoothing, isosurfaces."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Mesh
from ..sharing import numbered, removed, settled
from .clip import edge_uses, edges
from .index import placed
from .spatial import knn, nearest_triangle, radius_join

XYZ = ("x", "y", "z")
INDEX = ("ix", "iy", "iz")


@dataclass(frozen=True)
class Grid:
    dims: tuple[int, int, int]
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float]

    def voxels(self, spark: SparkSession) -> DataFrame:
        """(vid, ix, iy, iz, x, y, z) of every sample."""
        dx, dy, dz = self.dims
        rows = spark.range(dx * dy * dz).select(F.col("id").alias("vid"), (F.col("id") % dx).cast("int").alias("ix"), (F.floor(F.col("id") / dx) % dy).cast("int").alias("iy"), F.floor(F.col("id") / (dx * dy)).cast("int").alias("iz"))
        return rows.withColumns({c: self.origin[k] + F.col(i) * self.spacing[k] for k, (c, i) in enumerate(zip(XYZ, INDEX, strict=True))})

    def inside(self) -> Column:
        out = F.lit(True)
        for i, n in zip(INDEX, self.dims, strict=True):
            out = out & (F.col(i) >= 0) & (F.col(i) < n)
        return out

    def vid(self) -> Column:
        return (F.col("ix") + F.col("iy") * self.dims[0] + F.col("iz") * (self.dims[0] * self.dims[1])).cast("long")


def _box(points: DataFrame) -> tuple[list[float], list[float], int]:
    row = points.agg(*(f(c) for c in XYZ for f in (F.min, F.max)), F.count("*")).first()
    if not row[6]:
        raise ValueError("no points")
    return [float(row[i]) for i in (0, 2, 4)], [float(row[i]) for i in (1, 3, 5)], row[6]


def grid_by_count(points: DataFrame, spacing: float = 0.0) -> Grid:
    """Spacing cbrt(volume / n) unless given, a border of three samples, int(extent / spacing) samples an axis."""
    lo, hi, n = _box(points)
    if spacing <= 0:
        spacing = math.prod(h - a for a, h in zip(lo, hi, strict=True)) ** (1 / 3) / n ** (1 / 3)
    lo, hi = [a - 3 * spacing for a in lo], [h + 3 * spacing for h in hi]
    return Grid(tuple(int((h - a) / spacing) for a, h in zip(lo, hi, strict=True)), (spacing,) * 3, tuple(lo))


def grid_by_side(points: DataFrame, side: int = 16, pad: int = 5) -> Grid:
    """``side`` voxels on the shortest side and ``pad`` around; an axis of s voxels has s + 1 samples."""
    lo, hi, _ = _box(points)
    spacing = min(h - a for a, h in zip(lo, hi, strict=True)) / side
    if spacing <= 0:
        raise ValueError("the points are flat")
    dims = tuple(int((h - a) / spacing) + 2 * pad + 1 for a, h in zip(lo, hi, strict=True))
    return Grid(dims, (spacing,) * 3, tuple(a - pad * spacing for a in lo))


#: Fixed: modes of the oriented distance: what is combined and how.
MODES = {
    "signed_mean": ("signed", "mean"),
    "projected_mean": ("projected", "mean"),
    "projected_median": ("projected", "median"),
    "signed_median": ("signed", "median"),
    "unsigned_median": ("unsigned", "median"),
    "nearest_signed": ("signed", "nearest"),
    "nearest_projected": ("projected", "nearest"),
    "nearest_unsigned": ("unsigned", "nearest"),
}


def oriented_distance(voxels: DataFrame, points: DataFrame, mode: str = "projected_median", k: int = 5, radius: float | None = None, outside_sign: int = -1, surface: Mesh | None = None) -> DataFrame:
    """(vid, value, ref_pid) from the k nearest oriented points, or all within ``radius`` (k nearest where there are none).

    Mode ``unsigned_surface`` is the distance to the polygons of ``surface``; ref_pid is the first corner of the nearest one.

    Distances along or signed by the normals are positive in front of them; ``outside_sign`` -1 turns that round. Medians are
    sorted[int(n / 2)] and ref_pid is the point that gave it; for means it is the nearest point.
    """
    if mode == "unsigned_surface":
        near = nearest_triangle(voxels.select(F.col("vid").alias("pid"), *XYZ), surface)
        return near.select(F.col("id").alias("vid"), F.sqrt("d2").alias("value"), F.col("a").alias("ref_pid"))
    kind, how = MODES[mode]
    at = voxels.select(F.col("vid").alias("pid"), *XYZ)
    if radius is None:
        near = knn(at, points, 1 if how == "nearest" else k).select("id", "other", "d2")
    else:
        close = settled(radius_join(at, points, radius))
        rest = at.join(close.select(F.col("id").alias("pid")).distinct(), "pid", "left_anti")
        near = close.unionByName(knn(rest, points, k).select("id", "other", "d2"))
    rows = near.join(points.select(F.col("pid").alias("other"), *(F.col(c).alias("p" + c) for c in XYZ), *(c for c in ("nx", "ny", "nz") if kind != "unsigned")), "other").join(at.select(F.col("pid").alias("id"), *XYZ), "id")
    if kind == "unsigned":
        value = F.sqrt("d2")
    else:
        along = g.dot(g.sub(g.vector(*XYZ), g.vector("px", "py", "pz")), g.vector("nx", "ny", "nz"))
        value = along if kind == "projected" else F.when(along < 0, -1.0).otherwise(1.0) * F.sqrt("d2")
        value = value * float(outside_sign)
    rows = rows.select("id", "other", "d2", value.alias("v"))
    first = F.min_by("other", F.struct("d2", "other"))
    if how == "median":
        held = F.sort_array(F.collect_list(F.struct("v", "other")))
        got = rows.groupBy("id").agg(F.element_at(held, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("m"))
        return got.select(F.col("id").alias("vid"), F.col("m.v").alias("value"), F.col("m.other").alias("ref_pid"))
    return rows.groupBy(F.col("id").alias("vid")).agg((F.avg("v") if how == "mean" else F.min_by("v", F.struct("d2", "other"))).alias("value"), first.alias("ref_pid"))


def weight(distance: Column, spacing: float) -> Column:
    """1 at the surface, 0 from max(3, 2 * spacing) on."""
    return 1 - F.least(F.greatest(F.abs(distance) / max(3.0, 2 * spacing), F.lit(0.0)), F.lit(1.0))


def band(points: DataFrame, grid: Grid, high: float) -> DataFrame:
    """(vid): voxels in a box of max(2, high / spacing + 1) samples each way around a point, both ends included."""
    rows = points
    for k, (c, i) in enumerate(zip(XYZ, INDEX, strict=True)):
        reach = max(2, int(high / grid.spacing[k] + 1))
        at = F.floor((F.col(c) - grid.origin[k]) / grid.spacing[k] + 0.5)
        rows = rows.withColumn(i, F.explode(F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(grid.dims[k] - 1)))))
        rows = rows.select(*(x for x in rows.columns if x in (*XYZ, *INDEX))).distinct() if k < 2 else rows
    return rows.where(grid.inside()).select(grid.vid().alias("vid")).distinct()


def band_distance(grid: Grid, points: DataFrame, high: float, before: DataFrame | None = None, **options) -> DataFrame:
    """(vid, value, weight): distances within the band; elsewhere the value ``before`` (vid, value), or 0, with weight 0."""
    spark = points.sparkSession
    voxels = grid.voxels(spark)
    near = oriented_distance(voxels.join(band(points, grid, high), "vid", "left_semi"), points, **options)
    rows = voxels.select("vid").join(near.select("vid", F.col("value").alias("new")), "vid", "left")
    old = F.lit(0.0)
    if before is not None:
        rows, old = rows.join(before.select("vid", F.col("value").alias("old")), "vid", "left"), F.coalesce("old", F.lit(0.0))
    return rows.select("vid", F.coalesce("new", old).alias("value"), F.when(F.col("new").isNull(), 0.0).otherwise(weight(F.col("new"), grid.spacing[0])).alias("weight"))


def mesh_distance(voxels: DataFrame, mesh: Mesh, outside_sign: int = 1) -> DataFrame:
    """(vid, value): distance to the closest place, signed by the vertex normal with the largest weight there."""
    mesh = _with_normals(mesh)
    at = voxels.select(F.col("vid").alias("pid"), *XYZ)
    return _signed(nearest_triangle(at, mesh), at, mesh, outside_sign)


def _with_normals(mesh: Mesh) -> Mesh:
    from .graph import vertex_normals

    return mesh if mesh.has_normals else vertex_normals(mesh, orient=True)


def _signed(near: DataFrame, at: DataFrame, mesh: Mesh, outside_sign: int) -> DataFrame:
    """(vid, value) of closest places, signed by the normal of the corner with the largest weight."""
    top = F.greatest("wa", "wb", "wc")
    near = near.withColumn("corner", F.when(F.col("wa") == top, F.col("a")).when(F.col("wb") == top, F.col("b")).otherwise(F.col("c")))
    rows = near.join(mesh.points.select(F.col("pid").alias("corner"), "nx", "ny", "nz"), "corner").join(at.select(F.col("pid").alias("id"), *XYZ), "id")
    side = g.dot(g.vector("nx", "ny", "nz"), g.sub(g.vector(*XYZ), g.vector("cx", "cy", "cz")))
    return rows.select(F.col("id").alias("vid"), (F.when(side < 0, -1.0).otherwise(1.0) * F.sqrt("d2") * float(outside_sign)).alias("value"))


def mesh_distance_sure(voxels: DataFrame, mesh: Mesh, outside_sign: int = -1) -> DataFrame:
    """(vid, value): as ``mesh_distance``, but signed by the normal mixed with the place's weights, and only where the nearest
    triangle has one neighbour at each of its three edges; near borders and branches all voxels are outside."""
    mesh = _with_normals(mesh)
    at = voxels.select(F.col("vid").alias("pid"), *XYZ)
    near = nearest_triangle(at, mesh)
    lone = edges(mesh).join(edge_uses(mesh).where("cells <> 2").select("a", "b"), ["a", "b"], "left_semi").select("cid").distinct()
    for k in "abc":
        near = near.join(mesh.points.select(F.col("pid").alias(k), *(F.col("n" + x).alias(f"n{k}{x}") for x in XYZ)), k)
    rows = near.join(lone.withColumn("lone", F.lit(True)), "cid", "left").join(at.select(F.col("pid").alias("id"), *XYZ), "id")
    mixed = tuple(sum((F.col("w" + k) * F.col(f"n{k}{x}") for k in "bc"), F.col("wa") * F.col(f"na{x}")) for x in XYZ)
    inside = (g.dot(mixed, g.sub(g.vector(*XYZ), g.vector("cx", "cy", "cz"))) < 0) & F.col("lone").isNull()
    return rows.select(F.col("id").alias("vid"), (F.when(inside, -1.0).otherwise(1.0) * F.sqrt("d2") * float(outside_sign)).alias("value"))


#: The value of a voxel that no triangle's box reaches: the root of the largest double.
UNTOUCHED = math.sqrt(sys.float_info.max)


def mesh_distance_boxes(grid: Grid, mesh: Mesh, least: float = 1.5, outside_sign: int = 1) -> DataFrame:
    """(vid, value) of every voxel, from the triangles whose boxes it lies in; UNTOUCHED where there is none.

    A triangle's box has its middle and reaches 1.5 times its size, ``least`` at least, each way; its last sample on an axis, and
    that of the grid, are left out. Of several triangles the nearest counts, of equally near ones that with the lesser cell id.
    """
    mesh = _with_normals(mesh)
    columns = [F.col("tid.k").cast("long").alias("k"), "cid", *"abc", *(F.col(p + x).cast("double").alias(p + x) for p in "abc" for x in XYZ)]
    rows = placed(mesh.placed_triangles().select(*columns), tuple(p + x for p in "abc" for x in XYZ))
    for i, x, n, step, first in zip(INDEX, XYZ, grid.dims, grid.spacing, grid.origin, strict=True):
        low, high = F.least(*(p + x for p in "abc")), F.greatest(*(p + x for p in "abc"))
        middle, reach = (low + high) / 2, F.greatest(F.lit(float(least)), 1.5 * (high - low))
        rows = rows.withColumn("lo" + i, F.greatest(((middle - reach - first) / step).cast("int"), F.lit(0)))
        rows = rows.withColumn("hi" + i, F.least(((middle + reach - first) / step).cast("int") + 1, F.lit(n - 1)) - 1)
    for m, i in enumerate(reversed(INDEX)):
        rows = rows.where(F.col("hi" + i) >= F.col("lo" + i)).withColumn(i, F.explode(F.sequence("lo" + i, "hi" + i))).drop("lo" + i, "hi" + i)
        rows = rows.repartition("iz", "cid", "k") if m == 0 else rows  # a huge triangle's slices go to many tasks
    spots = rows.select(grid.vid().alias("id"), "cid", "k", *"abc", *((F.col(i) * step + first).alias(x) for i, x, step, first in zip(INDEX, XYZ, grid.spacing, grid.origin, strict=True)), *(p + x for p in "abc" for x in XYZ))
    names = ("id", "cid", "k", "a", "b", "c", "d2", "cx", "cy", "cz", "wa", "wb", "wc")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, a, b, c = (np.column_stack([batch.column(k + x).to_numpy() for x in XYZ]) for k in ("", "a", "b", "c"))
            at, w = g.closest_places(p, a, b, c)
            more = [((at - p) ** 2).sum(1), *at.T, *w.T]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names[:6]), *(pa.array(np.ascontiguousarray(v)) for v in more)], list(names))

    found = spots.mapInArrow(probe, ", ".join(f"{c} {'long' if i < 6 else 'double'}" for i, c in enumerate(names)))
    best = found.groupBy("id").agg(F.min(F.struct("d2", "cid", "k", "cx", "cy", "cz", "a", "b", "c", "wa", "wb", "wc")).alias("s")).select("id", "s.*")
    voxels = grid.voxels(mesh.points.sparkSession)
    near = _signed(best, voxels.select(F.col("vid").alias("pid"), *XYZ), mesh, outside_sign)
    return voxels.select("vid").join(near, "vid", "left").select("vid", F.coalesce("value", F.lit(UNTOUCHED)).alias("value"))


def layers(known: DataFrame, grid: Grid) -> DataFrame:
    """(vid, layer) of every voxel: steps to the nearest known voxel (vid), where a step leads to one of the 26 around.

    Steps are the largest difference of the three indexes, so one pass along each axis does: a line of voxels takes the least of
    max(difference along it, what its places have so far). A line is as long as a side of the grid.
    """
    dx, dy, _ = grid.dims
    rows = known.select((F.col("vid") % dx).cast("int").alias("ix"), (F.floor(F.col("vid") / dx) % dy).cast("int").alias("iy"), F.floor(F.col("vid") / (dx * dy)).cast("int").alias("iz"), F.lit(0).alias("layer"))
    for axis, n in zip(INDEX, grid.dims, strict=True):
        others = [i for i in INDEX if i != axis]

        def along(batches: Iterator[pa.RecordBatch], n=n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for line in range(batch.num_rows):
                    held = batch.column(2)[line].values
                    at = np.full(n, np.iinfo(np.int32).max, np.int64)
                    at[held.field(0).to_numpy()] = held.field(1).to_numpy()
                    out = pa.array(nearest_along(at).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(line, 1), batch.column(1).slice(line, 1), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), out)], [*others, "line"])

        lines = rows.groupBy(*others).agg(F.collect_list(F.struct(axis, "layer")).alias("held"))
        rows = lines.mapInArrow(along, f"{others[0]} int, {others[1]} int, line array<int>").select(*others, F.posexplode("line").alias(axis, "layer"))
    return rows.select(grid.vid().alias("vid"), "layer")


def nearest_along(at: np.ndarray) -> np.ndarray:
    """For each place of a line the least max(distance along the line, number there), by least numbers in windows that double."""
    n = len(at)
    table = [at]
    while (width := 1 << len(table)) <= n:
        table.append(np.minimum(table[-1][: n - width + 1], table[-1][width // 2 : n - width // 2 + 1]))
    table = [np.pad(t, (0, n - len(t)), constant_values=np.iinfo(np.int64).max) for t in table]
    stacked, place = np.stack(table), np.arange(n)
    low, high = np.zeros(n, np.int64), np.full(n, max(n, 0), np.int64)  # the answer lies in (low - 1, high]; beyond the line it is the least number
    while (low < high).any():
        r = (low + high) // 2
        a, b = np.maximum(place - r, 0), np.minimum(place + r, n - 1)
        k = np.frexp(b - a + 1.0)[1] - 1
        least = np.minimum(stacked[k, a], stacked[k, b + 1 - (1 << k)])
        low, high = np.where(least <= r, low, r + 1), np.where(least <= r, r, high)
    return np.where(low < n, low, np.maximum(at.min(), n))


def mesh_distance_band(grid: Grid, mesh: Mesh, reach: float, outside_sign: int = 1) -> DataFrame:
    """(vid, value): mesh distance within ``reach`` of the points; the rest is flooded from the band, the least voxel id wins.

    A voxel takes the value of the neighbour (26 around) with the least id among those one step nearer to the band.
    """
    voxels = grid.voxels(mesh.points.sparkSession)
    start = voxels.join(band(mesh.points, grid, reach), "vid", "left_semi")
    return flooded(settled(mesh_distance(start, mesh, outside_sign)), grid)


def flooded(known: DataFrame, grid: Grid) -> DataFrame:
    """(vid, value) of every voxel from the known ones: each points to its neighbour with the least id in the layer before.

    Along these pointers values come by doubling jumps, so tables grow with the logarithm of the layers.
    """
    of = settled(layers(known, grid))
    dx, dy = grid.dims[0], grid.dims[1]
    f = of.select("vid", (F.col("layer") + 1).alias("layer"), (F.col("vid") % dx).alias("ix"), (F.floor(F.col("vid") / dx) % dy).alias("iy"), F.floor(F.col("vid") / (dx * dy)).alias("iz"))
    for i in INDEX:
        f = f.withColumn(i, F.explode(F.array(F.col(i) - 1, F.col(i), F.col(i) + 1)))
    nearer = f.where(grid.inside()).groupBy(grid.vid().alias("to"), "layer").agg(F.min("vid").alias("from"))
    pointer = of.join(nearer.withColumnRenamed("to", "vid"), ["vid", "layer"], "left").select("vid", "layer", F.when(F.col("layer") == 0, F.col("vid")).otherwise(F.col("from")).alias("to"))
    jump, reached = settled(pointer), 1
    most = of.agg(F.max("layer")).first()[0] or 0
    while reached < most:
        new = settled(jump.join(jump.select(F.col("vid").alias("to"), F.col("to").alias("to2")), "to").select("vid", F.col("to2").alias("to")))
        removed(jump)
        jump, reached = new, 2 * reached
    out = settled(jump.join(known.select(F.col("vid").alias("to"), "value"), "to").select("vid", "value"))
    removed(of, jump)
    return out


def trilinear(points: DataFrame, voxels: DataFrame, grid: Grid, clamp: bool = True) -> DataFrame:
    """Points with the volume's value there as scalar, in [0, 1] with ``clamp``; null outside the grid."""
    rows = points.select("pid", *XYZ)
    for k, (c, i) in enumerate(zip(XYZ, INDEX, strict=True)):
        at = (F.col(c) - grid.origin[k]) / grid.spacing[k]
        low = F.least(F.floor(at), F.lit(grid.dims[k] - 2))
        rows = rows.where(at.between(0, grid.dims[k] - 1)).withColumn("f" + i, at - low).withColumn("lo" + i, low)
    corner = F.explode(F.array(*(F.array(*(F.lit(b) for b in (i, j, k))) for i in (0, 1) for j in (0, 1) for k in (0, 1)))).alias("b")
    rows = rows.select("*", corner)
    share = F.lit(1.0)
    for k, i in enumerate(INDEX):
        rows = rows.withColumn(i, F.col("lo" + i) + F.col("b")[k])
        share = share * F.when(F.col("b")[k] == 1, F.col("f" + i)).otherwise(1 - F.col("f" + i))
    rows = rows.where(grid.inside()).select("pid", grid.vid().alias("vid"), share.alias("w")).join(voxels.select("vid", "value"), "vid")
    got = rows.groupBy("pid").agg(F.sum(F.col("w") * F.col("value")).alias("_v"), F.count("*").alias("_n")).where("_n = 8")
    value = F.least(F.greatest(F.col("_v"), F.lit(0.0)), F.lit(1.0)) if clamp else F.col("_v")
    return points.drop("scalar").join(got.select("pid", value.alias("scalar")), "pid", "left")


def _stencil(voxels: DataFrame, grid: Grid, weights: dict[tuple[int, int, int], float]) -> DataFrame:
    """(vid, s): weighted sums over neighbours; indexes beyond the border are moved to it."""
    rows = voxels.select("vid", *INDEX, F.explode(F.array(*(F.struct(*(F.lit(v).alias("d" + i) for v, i in zip(o, INDEX, strict=True)), F.lit(float(w)).alias("w")) for o, w in weights.items()))).alias("o"))
    at = {i: F.least(F.greatest(F.col(i) + F.col("o.d" + i), F.lit(0)), F.lit(n - 1)) for i, n in zip(INDEX, grid.dims, strict=True)}
    take = (at["ix"] + at["iy"] * grid.dims[0] + at["iz"] * (grid.dims[0] * grid.dims[1])).cast("long")
    pulled = rows.select(F.col("vid").alias("to"), take.alias("vid"), F.col("o.w").alias("w")).join(voxels.select("vid", "value"), "vid")
    return pulled.groupBy(F.col("to").alias("vid")).agg(F.sum(F.col("w") * F.col("value")).alias("s"))


def laplacian_kernel() -> dict[tuple[int, int, int], float]:
    """The 6-neighbour Laplacian."""
    out = {(0, 0, 0): -6.0}
    for k in range(3):
        for s in (-1, 1):
            out[tuple(s if i == k else 0 for i in range(3))] = 1.0
    return out


def double_laplacian_kernel() -> dict[tuple[int, int, int], float]:
    """Weights by which the neighbours must be averaged so that the Laplacian of the Laplacian is 0: they sum to 1."""
    one, out = laplacian_kernel(), {}
    for a, p in one.items():
        for b, q in one.items():
            o = tuple(i + j for i, j in zip(a, b, strict=True))
            out[o] = out.get(o, 0.0) + p * q
    middle = out.pop((0, 0, 0))
    return {o: -w / middle for o, w in out.items() if w}


def smooth_double_laplacian(voxels: DataFrame, grid: Grid, iterations: int = 1, relax: float = 0.5) -> DataFrame:
    """Rounds of value += relax * (double-Laplacian average - value), all voxels at once."""
    for _ in range(iterations):
        s = _stencil(voxels, grid, double_laplacian_kernel())
        voxels = settled(voxels.join(s, "vid").withColumn("value", F.col("value") + relax * (F.col("s") - F.col("value"))).drop("s"))
    return voxels


def smooth_mean(voxels: DataFrame, grid: Grid) -> DataFrame:
    """Each value becomes the mean of its six neighbours."""
    six = {o: 1 / 6 for o in laplacian_kernel() if any(o)}
    return voxels.join(_stencil(voxels, grid, six), "vid").withColumn("value", F.col("s")).drop("s")


def implicit_closest(points: DataFrame, f: Callable[[g.Vector], Column], steps: int = 20, h: float = 1e-4) -> DataFrame:
    """Points moved onto f = 0 by ``steps`` damped Newton steps along the numeric gradient; f takes and returns columns.

    A step goes half way and at most as far as |f| says for a distance field.
    """
    rows = points
    for i in range(steps):
        p = g.vector(*XYZ)
        slope = tuple((f(g.add(p, tuple(F.lit(h if j == k else 0.0) for j in range(3)))) - f(g.add(p, tuple(F.lit(-h if j == k else 0.0) for j in range(3))))) / (2 * h) for k in range(3))
        rows = rows.withColumns({"_f": f(p), **{"_g" + c: s for c, s in zip(XYZ, slope, strict=True)}})
        gg = g.dot(g.vector("_gx", "_gy", "_gz"), g.vector("_gx", "_gy", "_gz"))
        by = 0.5 * g.divided(F.col("_f"), F.greatest(gg, F.sqrt(gg)))
        rows = rows.withColumns({c: F.col(c) - by * F.col("_g" + c) for c in XYZ}).select(*points.columns)
        rows = settled(rows) if i % 5 == 4 else rows
    return rows


#: Six tetrahedra around the long diagonal of a cube; corner k has bits x, y, z = 1, 2, 4.
TETRAHEDRA = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]


def isosurface(voxels: DataFrame, grid: Grid, level: float = 0.0) -> Mesh:
    """Triangles where the value crosses ``level``, by tetrahedra of the grid's cells; every crossed edge gives one shared point.

    Triangles are turned so that their normals point to higher values.
    """
    corner = F.explode(F.array(*(F.array(*(F.lit((k >> b) & 1) for b in range(3))) for k in range(8)))).alias("o")
    rows = voxels.select(*INDEX, "vid", "value", corner)
    rows = rows.select(*((F.col(i) - F.col("o")[b]).alias(i) for b, i in enumerate(INDEX)), (F.col("o")[0] + 2 * F.col("o")[1] + 4 * F.col("o")[2]).alias("k"), "vid", "value")
    for i, n in zip(INDEX, grid.dims, strict=True):
        rows = rows.where((F.col(i) >= 0) & (F.col(i) < n - 1))
    cubes = rows.groupBy(*INDEX).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.sort_array(F.collect_list(F.struct("k", "vid", "value"))).alias("v")).where((F.col("least") <= level) & (F.col("most") > level))
    tets = cubes.select(F.explode(F.array(*(F.array(*(F.get("v", F.lit(k)) for k in t)) for t in TETRAHEDRA))).alias("t"))
    up = F.filter("t", lambda x: x["value"] > level)
    down = F.filter("t", lambda x: x["value"] <= level)
    tets = tets.select(up.alias("u"), down.alias("d")).where("size(u) > 0 and size(d) > 0")
    edge = lambda a, i, b, j: F.struct(F.least(F.get(a, F.lit(i))["vid"], F.get(b, F.lit(j))["vid"]).alias("p"), F.greatest(F.get(a, F.lit(i))["vid"], F.get(b, F.lit(j))["vid"]).alias("q"))
    one = F.array(F.array(*(edge("u", 0, "d", j) for j in range(3))))
    three = F.array(F.array(*(edge("d", 0, "u", j) for j in range(3))))
    two = F.array(F.array(edge("u", 0, "d", 0), edge("u", 0, "d", 1), edge("u", 1, "d", 1)), F.array(edge("u", 0, "d", 0), edge("u", 1, "d", 1), edge("u", 1, "d", 0)))
    tri = tets.select(F.get("u", F.lit(0))["vid"].alias("high"), F.get("d", F.lit(0))["vid"].alias("low"), F.explode(F.when(F.size("u") == 1, one).when(F.size("u") == 3, three).otherwise(two)).alias("e"))
    tri = settled(tri)
    ids = settled(numbered(tri.select(F.explode("e").alias("e")).distinct().select("e", "e.p", "e.q"), "pid", "p", "q"))
    at = lambda k: voxels.select(F.col("vid").alias(k), F.col("value").alias("v" + k), *(F.col(c).alias(k + c) for c in XYZ))
    t = (level - F.col("vp")) / (F.col("vq") - F.col("vp"))
    points = settled(ids.join(at("p"), "p").join(at("q"), "q").select("pid", "e", *((F.col("p" + c) + t * (F.col("q" + c) - F.col("p" + c))).alias(c) for c in XYZ)))
    named = tri.withColumn("r", F.struct("high", "low", "e"))
    for i, k in enumerate("abc"):
        named = named.withColumn("_e", F.get("e", F.lit(i))).join(points.select(F.col("e").alias("_e"), F.col("pid").alias(k), *(F.col(c).alias(k + c) for c in XYZ)), "_e").drop("_e")
    for k in ("high", "low"):
        named = named.join(voxels.select(F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in XYZ)), k)
    a, b, c = (g.vector(k + "x", k + "y", k + "z") for k in "abc")
    n = g.cross(g.sub(b, a), g.sub(c, a))
    rise = g.sub(g.vector("highx", "highy", "highz"), g.vector("lowx", "lowy", "lowz"))
    pids = F.when(g.dot(n, rise) >= 0, F.array("a", "b", "c")).otherwise(F.array("a", "c", "b"))
    cells = numbered(named.where("a <> b and b <> c and c <> a").select(pids.alias("pids")), "cid", "pids").select("cid", F.lit("polys").alias("kind"), "pids")
    return Mesh(points.drop("e"), cells)


def isosurface_from(voxels: DataFrame, grid: Grid, seed, level: float = 0.0) -> Mesh:
    """The part of the isosurface connected to its point nearest to ``seed``."""
    from .graph import closest_region

    return closest_region(isosurface(voxels, grid, level), seed)

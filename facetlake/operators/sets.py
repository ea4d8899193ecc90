"""Unions, samples and orders of whole clouds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Mesh, cloud
from ..sharing import numbered
from .project import NORMAL, XYZ, apply_transform


def merge(source: Mesh, target: Mesh, source_matrix=None, target_matrix=None) -> Mesh:
    """Points of both (each placed) as loose points; normals only where both have them; scalars and polygons are dropped."""
    a = apply_transform(source, source_matrix) if source_matrix is not None else source
    b = apply_transform(target, target_matrix) if target_matrix is not None else target
    columns = [*XYZ, *(NORMAL if a.has_normals and b.has_normals else ())]
    rows = a.points.select(F.lit(0).alias("_s"), F.col("pid").alias("_p"), *columns).unionByName(b.points.select(F.lit(1).alias("_s"), F.col("pid").alias("_p"), *columns))
    return cloud(numbered(rows, "pid", "_s", "_p").select("pid", *columns))


def merge_all(meshes: list[Mesh]) -> Mesh:
    """Points of all meshes in turn, unplaced; normals and scalars where all have them. ValueError for none."""
    if not meshes:
        raise ValueError("an empty scene has nothing to merge")
    columns = [*XYZ, *(NORMAL if all(m.has_normals for m in meshes) else ()), *(("scalar",) if all(m.has_scalar for m in meshes) else ())]
    parts = [m.points.select(F.lit(i).alias("_s"), F.col("pid").alias("_p"), *columns) for i, m in enumerate(meshes)]
    return cloud(numbered(reduce(DataFrame.unionByName, parts), "pid", "_s", "_p").select("pid", *columns))


def weld(mesh: Mesh) -> Mesh:
    """Points with equal coordinates become the one with the lowest id; ids are renumbered, polygons of fewer than 3 ids go."""
    first = mesh.points.groupBy(*XYZ).agg(F.min("pid").alias("keep"))
    of = mesh.points.select("pid", *XYZ).join(first, list(XYZ)).select("pid", "keep")
    ids = numbered(mesh.points.join(first.select(F.col("keep").alias("pid")), "pid", "left_semi").withColumnRenamed("pid", "_old"), "pid", "_old")
    names = of.join(ids.select(F.col("_old").alias("keep"), F.col("pid").alias("new")), "keep").select("pid", "new")
    corner = mesh.corners().join(names, "pid").groupBy("cid", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "new"))), lambda v: v["new"]).alias("pids"))
    cells = corner.where("kind <> 'polys' or size(array_distinct(pids)) >= 3")
    return Mesh(ids.select(*mesh.points.columns), cells.select("cid", "kind", "pids"))


def append(a: Mesh, b: Mesh) -> Mesh:
    """Both meshes side by side; ids of b follow those of a."""
    top = a.points.agg((F.coalesce(F.max("pid"), F.lit(-1)) + 1).alias("_p"))
    cells = a.cells.agg((F.coalesce(F.max("cid"), F.lit(-1)) + 1).alias("_c"))
    columns = [c for c in a.points.columns if c in b.points.columns]
    moved = b.points.join(F.broadcast(top)).withColumn("pid", F.col("pid") + F.col("_p")).select(*columns)
    more = b.cells.join(F.broadcast(top)).join(F.broadcast(cells)).select((F.col("cid") + F.col("_c")).alias("cid"), "kind", F.transform("pids", lambda p: p + F.col("_p")).alias("pids"))
    return Mesh(a.points.select(*columns).unionByName(moved), a.cells.select("cid", "kind", "pids").unionByName(more))


def subsample(mesh: Mesh, n: int) -> Mesh:
    """Every (size / n)-th point, index int(i * step); a copy of the mesh where n is at least its size."""
    size = mesh.points.count()
    if n >= size:
        return mesh
    if n <= 0:
        return cloud(mesh.points.where("false"))
    dense = numbered(mesh.points, "_place", "pid")
    # Index k is picked by the first i with int(i * size / n) = k, in whole numbers: i = ceil(k * n / size).
    i = F.floor((F.col("_place") * n + size - 1) / size)
    rows = dense.withColumn("_i", i).where((F.col("_i") < n) & (F.floor(F.col("_i") * size / n) == F.col("_place")))
    return cloud(rows.drop("pid").withColumnRenamed("_i", "pid").select(*mesh.points.columns))


def stride(points: DataFrame, most: int) -> DataFrame:
    """Points with pid % (n // most) = 0, ``most`` of them at most."""
    step = max(1, points.count() // most)
    return points.where((F.col("pid") % step == 0) & (F.col("pid") < step * most))


def sort_pairs(pairs: DataFrame, x: str, y: str, reverse: bool = False) -> DataFrame:
    way = (F.desc if reverse else F.asc)
    return pairs.orderBy(way(x), way(y))


def largest_group(rows: DataFrame, by: str) -> DataFrame:
    """(by, n): the group with most rows, the lowest of equal ones."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(1)


def chunk_bounds(parts: int, size: int) -> list[int]:
    """Borders of ``parts`` equal chunks of 0 .. size; the last takes what is left over."""
    step = size // parts
    return [i * step for i in range(parts)] + [size]

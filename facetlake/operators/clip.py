"""Filters and clips: planes, scalar ranges, cell clean-up, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Mesh, cloud
from ..sharing import numbered
from .project import side_of
from ..functions import geometry as g


def threshold_points(points: DataFrame, low: float, high: float) -> DataFrame:
    """Points with low < scalar <= high."""
    return points.where((F.col("scalar") > low) & (F.col("scalar") <= high))


def cut_points(points: DataFrame, origin, normal) -> DataFrame:
    """Points in front of a plane."""
    return points.where(side_of(g.vector("x", "y", "z"), g.vector(*origin), g.vector(*normal)) > 0)


def clip(mesh: Mesh, value: Column) -> Mesh:
    """The part of a mesh where ``value`` (of point columns) is positive.

    Triangles across the border are cut there: numeric point columns are interpolated on the cut edges, and each cut edge gives
    one new point that both its triangles share. Loose points are kept where positive. Points that no cell needs are dropped.
    """
    numeric = [c for c, t in mesh.points.dtypes if c != "pid" and t in ("double", "float")]
    valued = mesh.points.withColumn("_f", value)
    whole = valued.where("_f > 0").select("pid", *numeric)
    at = valued.select("pid", "_f")
    tri = mesh.triangles()
    for c in "abc":
        tri = tri.join(at.select(F.col("pid").alias(c), F.col("_f").alias("f" + c)), c)
    keys = F.array(*(F.struct(F.col(c).alias("p"), F.col("f" + c).alias("f")) for c in "abc"))
    tri = tri.select("tid", keys.alias("v")).where(F.exists("v", lambda x: x["f"] > 0))
    edge = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    nxt = lambda i: F.element_at("v", F.when(i == 2, 1).otherwise(i + 2))
    kept = F.flatten(
        F.transform(
            "v",
            lambda x, i: F.concat(
                F.when(x["f"] > 0, F.array(edge(x["p"], x["p"]))).otherwise(F.array().cast("array<struct<p:bigint,q:bigint>>")),
                F.when((x["f"] > 0) != (nxt(i)["f"] > 0), F.array(edge(x["p"], nxt(i)["p"]))).otherwise(F.array().cast("array<struct<p:bigint,q:bigint>>")),
            ),
        )
    )
    rings = tri.select("tid", kept.alias("ring"))
    fan = rings.select("tid", F.explode(F.sequence(F.lit(1), F.size("ring") - 2)).alias("k"), "ring")
    corner = F.array(F.get("ring", F.lit(0)), F.get("ring", F.col("k")), F.get("ring", F.col("k") + 1))
    pieces = fan.select("tid", "k", corner.alias("ring"))
    nodes = pieces.select(F.explode("ring").alias("e")).distinct()
    loose = mesh.cells.where("kind = 'verts'").select(F.explode("pids").alias("p")).join(whole.select(F.col("pid").alias("p")), "p", "left_semi")
    nodes = nodes.unionByName(loose.select(F.struct("p", F.col("p").alias("q")).alias("e"))).distinct()
    ids = numbered(nodes.select("e", F.col("e.p").alias("p"), F.col("e.q").alias("q")), "pid", "p", "q")
    a = valued.select(F.col("pid").alias("p"), F.col("_f").alias("fa"), *(F.col(c).alias("a_" + c) for c in numeric))
    b = valued.select(F.col("pid").alias("q"), F.col("_f").alias("fb"), *(F.col(c).alias("b_" + c) for c in numeric))
    t = F.when(F.col("p") == F.col("q"), 0.0).otherwise(F.try_divide(F.col("fa"), F.col("fa") - F.col("fb")))
    points = ids.join(a, "p").join(b, "q").select("pid", *((F.col("a_" + c) + t * (F.col("b_" + c) - F.col("a_" + c))).alias(c) for c in numeric))
    named = pieces.select("tid", "k", F.posexplode("ring").alias("ord", "e")).join(ids.select("e", "pid"), "e")
    polys = named.groupBy("tid", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "pid"))), lambda x: x["pid"]).alias("pids"))
    verts = loose.distinct().join(ids.where("p = q").select("p", "pid"), "p").select(F.array("pid").alias("pids"))
    cells = verts.select(F.lit(0).alias("o"), F.lit("verts").alias("kind"), "pids").unionByName(polys.select(F.lit(1).alias("o"), F.lit("polys").alias("kind"), "pids"))
    return Mesh(points, numbered(cells, "cid", "o", "pids").select("cid", "kind", "pids"))


def cut_with_plane(mesh: Mesh, origin, normal) -> Mesh:
    return clip(mesh, side_of(g.vector("x", "y", "z"), g.vector(*origin), g.vector(*normal)))


def scalar_threshold(mesh: Mesh, low: float, high: float) -> Mesh:
    """The part with low < scalar <= high; on surfaces the two borders are cut one after the other."""
    polys = mesh.cells.where("kind in ('polys', 'strips')").limit(1).count()
    if not polys:
        points = threshold_points(mesh.points, low, high)
        return cloud(numbered(points.withColumnRenamed("pid", "_old"), "pid", "_old").drop("_old"))
    return clip(clip(mesh, F.col("scalar") - low), high - F.col("scalar"))


def edges(mesh: Mesh) -> DataFrame:
    """(cid, a, b): undirected edges of polygons, one row a use, a < b."""
    ring = mesh.cells.where("kind = 'polys'").select("cid", F.posexplode("pids").alias("i", "p"), "pids")
    q = F.element_at("pids", (F.when(F.col("i") + 1 == F.size("pids"), 0).otherwise(F.col("i") + 1) + 1).cast("int"))
    return ring.select("cid", F.least("p", q).alias("a"), F.greatest("p", q).alias("b")).where("a <> b")


def edge_uses(mesh: Mesh) -> DataFrame:
    """(a, b, cells): how many cells use each edge."""
    return edges(mesh).groupBy("a", "b").agg(F.count("*").alias("cells"))


def remove_non_manifold(mesh: Mesh) -> Mesh:
    """Triangles each of whose edges is shared with at most one other cell; points stay, attributes go."""
    bad = edges(mesh).join(edge_uses(mesh).where("cells > 2"), ["a", "b"], "left_semi").select("cid").distinct()
    kept = mesh.cells.where("kind = 'polys' and size(pids) = 3").join(bad, "cid", "left_anti")
    return Mesh(mesh.points.select("pid", "x", "y", "z"), kept.select("cid", "kind", "pids"))


def flipped_plane(origin, normal) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The same plane seen from its other side."""
    return tuple(map(float, origin)), tuple(-float(x) for x in normal)


def compact(mesh: Mesh) -> Mesh:
    """Drop points in no cell and number the others anew in order; all attributes go along."""
    used = mesh.corners().select("pid").distinct()
    ids = numbered(mesh.points.join(used, "pid", "left_semi").withColumnRenamed("pid", "_old"), "pid", "_old")
    corner = mesh.corners().join(ids.select(F.col("_old").alias("pid"), F.col("pid").alias("_new")), "pid")
    pids = corner.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_new"))), lambda x: x["_new"]).alias("pids"))
    cells = mesh.cells.drop("pids").join(pids, "cid").select(*mesh.cells.columns)
    return Mesh(ids.drop("_old").select(*mesh.points.columns), cells)


def crop_seeds(points: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Scalar 2 for points of scalar 0 within ``tolerance`` of one of the six bounds."""
    box = points.agg(*(f(c).alias(n + c) for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    near = None
    for c in "xyz":
        hit = (F.abs(F.col(c) - F.col("lo" + c)) < tolerance) | (F.abs(F.col(c) - F.col("hi" + c)) < tolerance)
        near = hit if near is None else near | hit
    rows = points.join(F.broadcast(box))
    return rows.withColumn("scalar", F.when((F.col("scalar") == 0) & near, 2.0).otherwise(F.col("scalar"))).select(*points.columns)


def inside_planes(p: g.Vector, planes: list[tuple]) -> Column:
    """Whether a point is in front of every plane (origin, normal)."""
    out = F.lit(True)
    for origin, normal in planes:
        out = out & (side_of(p, g.vector(*origin), g.vector(*normal)) > 0)
    return out


def contained(a: Column, b: Column) -> Column:
    """Whether all ids of array a are in b."""
    return F.size(F.array_except(a, b)) == 0


def contained_pairs(mesh: Mesh) -> DataFrame:
    """(i, j): ordered pairs of different cells where the ids of i are all in j, by shared ids."""
    corner = mesh.corners().select("cid", "pid").distinct()
    a = corner.join(corner.groupBy("cid").agg(F.count("*").alias("n")), "cid").select(F.col("cid").alias("i"), "pid", "n")
    b = corner.select(F.col("cid").alias("j"), "pid")
    return a.join(b, "pid").where("i <> j").groupBy("i", "j", "n").agg(F.count("*").alias("m")).where("m = n").select("i", "j")


def consistency(mesh: Mesh) -> str:
    """Empty for a sound surface, else what is wrong."""
    n = mesh.points.limit(3).count()
    if n < 3:
        return f"only {n} points"
    bad = edge_uses(mesh).where("cells > 2").count()
    return f"{bad} non-manifold edges" if bad else ""


def feature_edges(mesh: Mesh, boundary: bool = True, non_manifold: bool = True, manifold: bool = False, sharp: bool = False, angle: float = 30.0) -> DataFrame:
    """(a, b, type): edges of one cell, of more than two, of two, and of two whose normals differ by more than ``angle``."""
    uses = edge_uses(mesh)
    kind = F.when(F.col("cells") == 1, "boundary").when(F.col("cells") > 2, "nonmanifold").otherwise("manifold")
    rows = uses.select("a", "b", kind.alias("type"))
    wanted = [k for k, on in (("boundary", boundary), ("nonmanifold", non_manifold), ("manifold", manifold)) if on]
    out = rows.where(F.col("type").isin(*wanted)) if wanted else rows.where("false")
    if sharp:
        faces = face_normals(mesh)
        both = edges(mesh).join(uses.where("cells = 2"), ["a", "b"]).join(faces, "cid")
        turn = both.groupBy("a", "b").agg(F.min_by(F.struct("nx", "ny", "nz"), "cid").alias("m"), F.max_by(F.struct("nx", "ny", "nz"), "cid").alias("n"))
        c = g.dot(*(tuple(F.col(f"{v}.{x}") for x in ("nx", "ny", "nz")) for v in "mn"))
        hard = turn.where(c < F.cos(F.radians(F.lit(float(angle))))).select("a", "b", F.lit("sharp").alias("type"))
        out = out.join(hard.select("a", "b"), ["a", "b"], "left_anti").unionByName(hard)
    return out


def face_normals(mesh: Mesh) -> DataFrame:
    """(cid, nx, ny, nz): unit normals of polygons, area-weighted over their triangles."""
    t = mesh.placed_triangles()
    a, b, c = (g.vector(k + "x", k + "y", k + "z") for k in "abc")
    n = g.cross(g.sub(b, a), g.sub(c, a))
    summed = t.select("cid", *(v.alias(k) for v, k in zip(n, ("nx", "ny", "nz"), strict=True))).groupBy("cid").agg(*(F.sum(k).alias(k) for k in ("nx", "ny", "nz")))
    return summed.select("cid", *(v.alias(k) for v, k in zip(g.normalised(g.vector("nx", "ny", "nz")), ("nx", "ny", "nz"), strict=True)))


def first_stop(lines: DataFrame, stop: Column, order: str = "line") -> DataFrame:
    """Rows before the first one where ``stop`` holds."""
    first = lines.where(stop).agg(F.min(order).alias("_stop"))
    return lines.join(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def running_segment(lines: DataFrame, marker: Column, order: str, by: list[str]) -> DataFrame:
    """Rows with ``segment``: how many marker rows there have been in the group so far."""
    w = Window.partitionBy(*by).orderBy(order)
    return lines.withColumn("segment", F.sum(marker.cast("long")).over(w))

"""Decimation by edge collapse in rounds of independent sets.

Each point has a quadric, the sum of squared distances to the planes of its triangles (and, at borders, to planes that stand on
them). An edge costs what the sum of both ends' quadrics is at the place that it would collapse to. A round lets every edge
collapse at once that costs least among all edges at its ends and at their neighbours: no two of those touch one triangle, so what
was checked for one still holds after the others. The points of a long mesh so take about as many rounds as those of a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Mesh
from ..sharing import numbered, removed, settled
from .clip import compact

XYZ = ("x", "y", "z")
#: The ten different numbers of a symmetric 4 x 4 quadric.
QUADRIC = tuple(f"q{i}{j}" for i in range(4) for j in range(i, 4))
#: Weight of the planes on border edges, and how far a normal may turn (cosine).
BORDER, TURN = 10.0, 0.2


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides. A round joins tables of the mesh's size some twenty times: broadcasts would bring each of
    them to the driver, again in every round."""
    return left.join(right.hint("merge"), on, how)


def plane_quadric(n: g.Vector, p: g.Vector, weight) -> dict:
    """The quadric of the plane through p with unit normal n."""
    row = (*n, -g.dot(n, p))
    return {f"q{i}{j}": row[i] * row[j] * weight for i in range(4) for j in range(i, 4)}


def placed(tri: DataFrame, points: DataFrame) -> DataFrame:
    """Triangles (t, a, b, c) with the coordinates of their corners."""
    for k in "abc":
        tri = met(tri, points.select(F.col("pid").alias(k), *(F.col(x).alias(k + x) for x in XYZ)), k)
    return tri


def sides(tri: DataFrame) -> DataFrame:
    """(u, v, w, t): edges u < v of each triangle with the corner w across."""
    pairs = (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))
    return tri.select("t", F.explode(F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.col(r).alias("w")) for p, q, r in pairs))).alias("s")).select("s.u", "s.v", "s.w", "t")


def quadrics(tri: DataFrame, points: DataFrame) -> DataFrame:
    """(pid, quadric): planes of triangles by their area, and planes on border edges."""
    t = placed(tri, points)
    a, b, c = (g.vector(*(k + x for x in XYZ)) for k in "abc")
    n = g.cross(g.sub(b, a), g.sub(c, a))
    flat = t.select(F.explode(F.array(*"abc")).alias("pid"), *(v.alias(k) for k, v in plane_quadric(g.normalised(n), a, g.norm(n) / 2).items()))
    lone = sides(tri).groupBy("u", "v").agg(F.count("*").alias("n"), F.min("t").alias("t")).where("n = 1")
    edge = met(lone, t.select("t", *(v.alias("n" + x) for v, x in zip(g.normalised(n), XYZ, strict=True))), "t")
    for k in "uv":
        edge = met(edge, points.select(F.col("pid").alias(k), *(F.col(x).alias(k + x) for x in XYZ)), k)
    u, v = (g.vector(*(k + x for x in XYZ)) for k in "uv")
    along = g.sub(v, u)
    wall = g.normalised(g.cross(along, g.vector("nx", "ny", "nz")))
    stand = edge.select(F.explode(F.array("u", "v")).alias("pid"), *(x.alias(k) for k, x in plane_quadric(wall, u, BORDER * g.dot(along, along)).items()))
    return flat.unionByName(stand).groupBy("pid").agg(*(F.sum(k).alias(k) for k in QUADRIC))


def _costs(move: bool):
    """(u, v, border, cost, x, y, z): where an edge's quadric is least, or the better of its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.column_stack([batch.column(k).to_numpy() for k in QUADRIC])
            full = np.empty((len(q), 4, 4))
            for m, (i, j) in enumerate((i, j) for i in range(4) for j in range(i, 4)):
                full[:, i, j] = full[:, j, i] = q[:, m]
            u, v = (np.column_stack([batch.column(k + x).to_numpy() for x in XYZ]) for k in "uv")
            tries = [u, v]
            if move:
                middle, a = (u + v) / 2, full[:, :3, :3]
                with np.errstate(all="ignore"):
                    step = np.linalg.pinv(a, rcond=1e-3, hermitian=True) @ (-full[:, :3, 3] - np.einsum("nij,nj->ni", a, middle))[:, :, None]
                best = middle + step[:, :, 0]
                reach = ((v - u) ** 2).sum(1, keepdims=True)
                best = np.where(np.isfinite(best).all(1, keepdims=True) & (((best - middle) ** 2).sum(1, keepdims=True) <= reach), best, middle)
                tries = [best, middle, u, v]
            places = np.stack(tries)
            h = np.concatenate([places, np.ones((*places.shape[:2], 1))], axis=2)
            cost = np.maximum(np.einsum("tni,nij,tnj->tn", h, full, h), 0)
            k = cost.argmin(0)
            at = places[k, np.arange(len(q))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "border")), pa.array(cost[k, np.arange(len(q))]), *(pa.array(np.ascontiguousarray(at[:, i])) for i in range(3))], ["u", "v", "border", "cost", *XYZ])

    return run


def candidates(tri: DataFrame, points: DataFrame, move: bool) -> DataFrame:
    """(u, v, border, cost, x, y, z) of the edges whose collapse keeps the surface's kind and turns no triangle over.

    An edge of two triangles (one at a border) may go where its ends have just the corners across as common neighbours, no triangle
    lies across both, and not both ends are on borders unless the edge is.
    """
    side = settled(sides(tri))
    edge = settled(side.groupBy("u", "v").agg(F.count("*").alias("cells")))
    both = edge.select(F.col("u").alias("p"), F.col("v").alias("q")).unionByName(edge.select(F.col("v").alias("p"), F.col("u").alias("q")))
    near = lambda k: both.select(F.col("p").alias(k), F.col("q").alias("w"))
    common = met(met(edge, near("u"), "u"), near("v"), ["v", "w"]).groupBy("u", "v").agg(F.count("*").alias("common"))
    across = lambda k: tri.select("t", F.explode(F.array(*(F.struct(F.col(p).alias("at"), F.least(q, r).alias("p"), F.greatest(q, r).alias("q")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))))).alias("s")).select(F.col("s.at").alias(k), "s.p", "s.q")
    lids = met(met(edge, across("u"), "u"), across("v"), ["v", "p", "q"]).select("u", "v").distinct()
    rim = edge.where("cells <> 2").select(F.explode(F.array("u", "v")).alias("pid")).distinct().withColumn("rim", F.lit(True))
    ok = met(met(edge.where("cells <= 2"), common, ["u", "v"]).where("common = cells"), lids, ["u", "v"], "left_anti")
    for k in "uv":
        ok = met(ok, rim.select(F.col("pid").alias(k), F.col("rim").alias("rim" + k)), k, "left")
    ok = ok.where("cells = 1 or rimu is null or rimv is null").select("u", "v", (F.col("cells") == 1).alias("border"), "rimu", "rimv")
    # A point on a border keeps its place where the other end is inside.
    for k in "uv":
        ok = met(ok, points.select(F.col("pid").alias(k), *(F.col(x).alias(k + x) for x in XYZ), *(F.col(q).alias(k + q) for q in QUADRIC)), k)
    ok = ok.select("u", "v", "border", *(k + x for k in "uv" for x in XYZ), *((F.col("u" + q) + F.col("v" + q)).alias(q) for q in QUADRIC), "rimu", "rimv")
    cost = ok.drop("rimu", "rimv").mapInArrow(_costs(move), "u long, v long, border boolean, cost double, x double, y double, z double")
    held = ok.where("not border and (rimu is not null or rimv is not null)").select("u", "v", *(F.when(F.col("rimu").isNotNull(), F.col("u" + x)).otherwise(F.col("v" + x)).alias("f" + x) for x in XYZ), *QUADRIC)
    at = (*(F.col("f" + x) for x in XYZ), F.lit(1.0))
    value = sum((F.col(f"q{i}{j}") * at[i] * at[j] * (1 if i == j else 2) for i in range(4) for j in range(i, 4)), F.lit(0.0))
    held = held.select("u", "v", *("f" + x for x in XYZ), F.greatest(value, F.lit(0.0)).alias("fcost"))
    cost = settled(met(cost, held, ["u", "v"], "left").select("u", "v", "border", F.coalesce("fcost", "cost").alias("cost"), *(F.coalesce("f" + x, x).alias(x) for x in XYZ)))
    # Triangles around the ends that stay must not turn.
    t = placed(tri, points)
    a, b, c = (g.vector(*(k + x for x in XYZ)) for k in "abc")
    spots = t.select("t", *"abc", *(k + x for k in "abc" for x in XYZ), F.explode(F.array(*"abc")).alias("end"))
    ends = cost.select("u", "v", *(F.col(x).alias("n" + x) for x in XYZ), F.explode(F.array("u", "v")).alias("end"))
    moved = met(spots, ends, "end")
    gone = F.lit(0)
    for k in "abc":
        gone = gone + (F.col(k).isin(F.col("u"), F.col("v"))).cast("int")
    moved = moved.where(gone == 1)
    new = [tuple(F.when(F.col(k) == F.col("end"), F.col("n" + x)).otherwise(F.col(k + x)) for x in XYZ) for k in "abc"]
    was, now = g.cross(g.sub(b, a), g.sub(c, a)), g.cross(g.sub(new[1], new[0]), g.sub(new[2], new[0]))
    turned = moved.where(g.dot(was, now) <= TURN * g.norm(was) * g.norm(now)).select("u", "v").distinct()
    out = settled(met(cost, turned, ["u", "v"], "left_anti"))
    removed(side, edge, cost)
    return out


def independent(edges: DataFrame, tri: DataFrame) -> DataFrame:
    """The candidates that cost least among those at their ends and at all neighbours of these; ties by ids."""
    key = F.struct("cost", "u", "v")
    own = edges.select(key.alias("key"), F.explode(F.array("u", "v")).alias("pid")).groupBy("pid").agg(F.min("key").alias("key"))
    link = sides(tri).select("u", "v").distinct()
    both = link.select(F.col("u").alias("pid"), F.col("v").alias("o")).unionByName(link.select(F.col("v").alias("pid"), F.col("u").alias("o")))
    near = met(both, own.select(F.col("pid").alias("o"), "key"), "o").select("pid", "key").unionByName(own)
    least = near.groupBy("pid").agg(F.min("key").alias("key"))
    first = edges.withColumn("key", key)
    for k in "uv":
        first = met(first, least.select(F.col("pid").alias(k), F.col("key").alias("key" + k)), k)
    return first.where("key = keyu and key = keyv").drop("key", "keyu", "keyv")


def decimate(mesh: Mesh, factor: float = 0.5, method: str = "quadric", most_rounds: int = 100) -> Mesh:
    """The mesh with about the share ``factor`` of its triangles taken away.

    ``quadric`` moves the point that is left to where the quadrics are least (Garland, Heckbert 1997), ``progressive`` keeps one of
    the two ends. Closed surfaces stay closed, borders stay borders; rounds end at the target, or where no edge may collapse.
    Points of no triangle go, only places are kept; triangles with a repeated corner go first.
    """
    if method not in ("quadric", "progressive"):
        raise ValueError(f"no decimation {method}")
    tri = mesh.triangles().where("a <> b and b <> c and c <> a").select(*(F.col(k).cast("long").alias(k) for k in "abc"), "tid")
    tri = settled(numbered(tri, "t", "tid").select("t", *"abc"))
    points = mesh.points.select(F.col("pid").cast("long").alias("pid"), *(F.col(x).cast("double").alias(x) for x in XYZ))
    points = settled(met(points, quadrics(tri, points), "pid"))
    total = left = tri.count()
    target = total - int(total * factor)
    for _ in range(most_rounds):
        if left <= target:
            break
        some = candidates(tri, points, method == "quadric")
        chosen = settled(independent(some, tri))
        gone = chosen.agg(F.count_if("border"), F.count("*")).first()
        if not gone[1]:
            removed(some, chosen)
            break
        if left - (2 * gone[1] - gone[0]) < target:  # the last round: the cheapest, as many as are needed
            size = F.when(F.col("border"), 1).otherwise(2)
            ranked = numbered(chosen.withColumn("size", size), "place", "cost", "u", "v")
            most = (left - target + 1) // 2 if not gone[0] else left - target
            some_less = settled(ranked.where(F.col("place") < most).drop("place", "size"))
            removed(ranked, chosen)
            chosen = some_less
        names = chosen.select(F.col("v").alias("pid"), F.col("u").alias("to"))
        step = tri
        for k in "abc":
            step = met(step, names.select(F.col("pid").alias(k), F.col("to").alias("to" + k)), k, "left").withColumn(k, F.coalesce("to" + k, k)).drop("to" + k)
        new_tri = settled(step.where("a <> b and b <> c and c <> a").select("t", *"abc"))
        other = points.select(F.col("pid").alias("v"), *(F.col(q).alias("v" + q) for q in QUADRIC))
        moved = met(chosen.select(F.col("u").alias("pid"), "v", *(F.col(x).alias("n" + x) for x in XYZ)), other, "v").drop("v")
        kept = met(met(points, names.select("pid"), "pid", "left_anti"), moved, "pid", "left")
        new_points = settled(kept.select("pid", *(F.coalesce("n" + x, x).alias(x) for x in XYZ), *((F.col(q) + F.coalesce(F.col("v" + q), F.lit(0.0))).alias(q) for q in QUADRIC)))
        removed(tri, points, some, chosen)
        tri, points = new_tri, new_points
        left = tri.count()
    cells = tri.select(F.col("t").alias("cid"), F.lit("polys").alias("kind"), F.array(*"abc").alias("pids"))
    return compact(Mesh(points.select("pid", *XYZ), cells))

"""Joins in space: radius, nearest, k nearest, nearest triangle, and what is built on them.

The radius join uses a uniform grid: points get the key of their cell, one side is copied to the neighbouring cells, and an
equi-join on the key is followed by the exact test; cells with very many points are dealt to several keys. Nearest searches use an
adaptive index (``index``); where the searched side is counted and small, every task gets it whole and searches in blocks instead.
Both ways give the same rows. Points without a finite place have no answer and are nobody's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Mesh, cloud
from ..sharing import numbered, settled
from .index import HIGH, LOW, TRIED, Index, Regions, Tree, placed

XYZ = ("x", "y", "z")
CELL = ("gx", "gy", "gz")
#: Points or triangles that a task may hold whole, pairs up to which that is worth it, and pairs worked on at once.
BLOCK_ROWS, BLOCK_PAIRS, BLOCK_AT_ONCE = 100_000, 4_000_000_000, 1_000_000
#: Regions that places are dealt to where they look for triangles, places that are compared together, and planes tried first.
TRIANGLE_REGIONS, TOGETHER, TRIED_FIRST = 32, 32, 16
#: Regions that points are dealt to where those within a radius are counted, and rows that are held against all regions at once.
RADIUS_REGIONS, REGION_ROWS = 64, 2000
#: A triangle is bounded by its box alone where the sine of its first corner is less: rounding moves places along a thinner one. For
#: the others, rounding of distances as a share of coordinates.
FLAT, PLANE_SLACK = 1e-3, 1e-8
#: Points of a grid cell that meet under one key.
DENSE = 4096
#: Points of a cell that are tried first when cells are linked.
FEW = 16
#: Cells that a border edge is as long as, on average.
EDGE_PIECES = 16


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def _gridded(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({k: _cell(c, size) for k, c in zip(CELL, XYZ, strict=True)})


def _spread(df: DataFrame, size: float) -> DataFrame:
    """Each row in its own and the 26 neighbouring cells."""
    for k, c in zip(CELL, XYZ, strict=True):
        df = df.withColumn(k, F.explode(F.sequence(_cell(c, size) - 1, _cell(c, size) + 1)))
    return df


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(id, other, d2) for points (pid, x, y, z) of left and right within ``radius``, itself included.

    Cells with over DENSE points of either side are dealt: the right points of a cell to chunks, the left ones that look into it to
    blocks, and each chunk meets each block under a key of its own. Points without a finite place are left out.
    """
    a = _spread(placed(left.select(F.col("pid").alias("id"), *XYZ)), radius)
    b = _gridded(placed(right.select(F.col("pid").alias("other"), *XYZ)), radius).select("other", *CELL, *(F.col(c).alias("o" + c) for c in XYZ))
    counts = a.select(*CELL, F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(b.select(*CELL, F.lit(0).alias("p"), F.lit(1).alias("q"))).groupBy(*CELL).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    dense = settled(counts.where((F.greatest("p", "q") > DENSE) & (F.least("p", "q") > 0)).select(*CELL, F.ceil(F.col("p") / DENSE).cast("int").alias("blocks"), F.ceil(F.col("q") / DENSE).cast("int").alias("chunks")))
    keys = list(CELL)
    if dense.limit(1).count():
        one = F.lit(1)

        def dealt(rows: DataFrame, own: str, of: str, other: str, many: str) -> DataFrame:
            rows = rows.join(dense, list(CELL), "left")
            mine = F.pmod(F.xxhash64(own), F.coalesce(of, one)).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(many), one) - 1))
            return rows.withColumn("block" if of == "blocks" else "chunk", mine).withColumn(other, every).drop("blocks", "chunks")

        a, b = dealt(a, "id", "blocks", "chunk", "chunks"), dealt(b, "other", "chunks", "block", "blocks")
        keys += ["block", "chunk"]
    d2 = g.distance2(g.vector(*XYZ), g.vector("ox", "oy", "oz"))
    return a.join(b, keys).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("id", "other", "d2")


def connecting_links(points: DataFrame, radius: float) -> DataFrame:
    """(a, b): links within ``radius`` (over 0) between points, with the same components as all such links, but no more than about
    the points and the pairs of neighbouring cells.

    In cells whose diagonal is under the radius every point is linked to the least one. Neighbouring cells are linked by one pair
    of a few of their points where there is one; only those that no such links connect are compared whole, in chunks.
    """
    size, limit = radius / math.sqrt(3) * (1 - 1e-6), radius * radius
    rows = settled(_gridded(placed(points.select("pid", *(F.col(c).cast("double").alias(c) for c in XYZ))), size))
    box = {k + c: f(c) for c in XYZ for k, f in (("l", F.min), ("h", F.max))}
    few = rows.groupBy(*CELL, F.pmod(F.xxhash64("pid"), F.lit(FEW)).alias("_part")).agg(F.count("*").alias("n"), F.min(F.struct("pid", *XYZ)).alias("one"), *(v.alias(k) for k, v in box.items()))
    cells = settled(few.groupBy(*CELL).agg(F.sum("n").alias("n"), F.min("one.pid").alias("cell"), F.collect_list("one").alias("few"), *((F.min if k[0] == "l" else F.max)(k).alias(k) for k in box)))
    stars = rows.join(cells.select(*CELL, "cell"), list(CELL)).where("pid <> cell").select(F.col("cell").alias("a"), F.col("pid").alias("b"))

    ahead = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    to = F.explode(F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(CELL, o, strict=True))) for o in ahead))).alias("to")
    side = lambda k: [F.col(c).alias(k + c) for c in ("cell", "n", "few", *box)]
    both = cells.select(*side("p"), to).select("*", "to.*").join(cells.select(*CELL, *side("q")), list(CELL))
    apart = sum((F.pow(F.greatest(F.col("ql" + c) - F.col("ph" + c), F.col("pl" + c) - F.col("qh" + c), F.lit(0.0)), 2) for c in XYZ), F.lit(0.0))
    pairs = settled(both.where(apart <= limit * (1 + 1e-12)).drop("to", *CELL))
    tried = pairs.select("pcell", "qcell", F.explode("pfew").alias("p"), "qfew").select("pcell", "qcell", "p", F.explode("qfew").alias("q"))
    at = lambda k: g.vector(*(f"{k}.{c}" for c in XYZ))
    sure = settled(tried.where(g.distance2(at("p"), at("q")) <= limit).groupBy("pcell", "qcell").agg(F.min(F.struct(F.col("p.pid").alias("a"), F.col("q.pid").alias("b"))).alias("m")))
    from .graph import components

    of = components(cells.select(F.col("cell").alias("node")), sure.select(F.col("pcell").alias("a"), F.col("qcell").alias("b")))
    open_ = pairs.drop("pfew", "qfew").join(sure, ["pcell", "qcell"], "left_anti")
    for k in "pq":
        open_ = open_.join(of.select(F.col("node").alias(k + "cell"), F.col("label").alias(k + "of")), k + "cell")
    open_ = settled(open_.where("pof <> qof"))
    links = stars.unionByName(sure.select("m.a", "m.b"))
    if not open_.limit(1).count():
        return links

    def dealt(k: str, o: str, own: str, other: str) -> DataFrame:
        """Points of the cells k that lie near enough to the box of the other cell, in chunks of about DENSE."""
        mine = rows.join(cells.select(*CELL, F.col("cell").alias(k + "cell")), list(CELL)).drop(*CELL).join(open_, k + "cell")
        off = sum((F.pow(F.greatest(F.col(o + "l" + c) - F.col(c), F.col(c) - F.col(o + "h" + c), F.lit(0.0)), 2) for c in XYZ), F.lit(0.0))
        part = F.pmod(F.xxhash64("pid"), F.ceil(F.col(k + "n") / DENSE)).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(o + "n") / DENSE) - 1)).alias(other)
        return mine.where(off <= limit * (1 + 1e-12)).select("pcell", "qcell", part, every, F.struct("pid", *XYZ).alias(k))

    met = dealt("p", "q", "block", "chunk").join(dealt("q", "p", "chunk", "block"), ["pcell", "qcell", "block", "chunk"])
    found = met.where(g.distance2(at("p"), at("q")) <= limit).groupBy("pcell", "qcell").agg(F.min(F.struct(F.col("p.pid").alias("a"), F.col("q.pid").alias("b"))).alias("m"))
    return links.unionByName(found.select("m.a", "m.b"))


def knn(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(id, rank from 1, other, d2): the k nearest points of right for each of left, ties by lower id; fewer where right has fewer.

    Points of left without a finite place have no rows, those of right are never found.
    """
    left = placed(left.select(F.col("pid").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in XYZ)))
    right = placed(right.select(F.col("pid").cast("long").alias("pid"), *(F.col(c).cast("double").alias(c) for c in XYZ)))
    n = right.count()
    if not n:
        return left.select("id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("other"), F.lit(0.0).alias("d2")).where("false")
    if n <= BLOCK_ROWS and n * left.count() <= BLOCK_PAIRS:
        return knn_in_blocks(left, right, k)
    index = Index.of(right.select("pid", *(F.col(c).alias(b) for bounds in (LOW, HIGH) for c, b in zip(XYZ, bounds, strict=True))))

    def work(points: pa.Table, items: pa.Table) -> pa.Table:
        items = items.sort_by("pid")
        held = [items.column(c).to_numpy() for c in ("pid", *LOW)]
        parts = [_nearest_of(*(c.to_numpy() for c in points.select(["id", *XYZ]).slice(at, step).columns), held, k) for step in [max(1, BLOCK_AT_ONCE // max(1, len(items)))] for at in range(0, len(points) if len(items) else 0, step)]
        return pa.Table.from_batches(parts, schema=_FOUND)

    near = index.met(left, work, "id long, rank int, other long, d2 double", k=k)
    w = Window.partitionBy("id").orderBy("d2", "other")
    found = settled(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "other", "d2"))
    index.remove()
    return found


_FOUND = pa.schema([("id", pa.int64()), ("rank", pa.int32()), ("other", pa.int64()), ("d2", pa.float64())])


def _nearest_of(ids: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, held: list[np.ndarray], k: int) -> pa.RecordBatch:
    """The k nearest of held points (ids in order, x, y, z) for a block of points, ties by lower id."""
    others, *xyz = held
    most = min(k, len(others))
    d = [a[:, None] - b[None] for a, b in zip((x, y, z), xyz, strict=True)]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    last = np.partition(d2, most - 1, axis=1)[:, most - 1]
    row, col = np.nonzero(d2 <= last[:, None])  # ties of the last one too, lower ids first
    order = np.lexsort((col, d2[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, rank = (x[rank < most] for x in (row, col, rank))
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((rank + 1).astype(np.int32)), pa.array(others[col]), pa.array(d2[row, col])], schema=_FOUND)


def knn_in_blocks(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """As ``knn`` where right (placed) has at most BLOCK_ROWS points: tasks hold all of them and compare blocks of left (id) with them."""
    sent = left.sparkSession.sparkContext.broadcast([c.to_numpy() for c in right.select("pid", *XYZ).toArrow().sort_by("pid").columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_AT_ONCE // len(sent.value[0]))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield _nearest_of(*(c.to_numpy(zero_copy_only=False) for c in batch.slice(at, step).columns), sent.value, k)

    return left.mapInArrow(run, "id long, rank int, other long, d2 double")


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, other, d2): the nearest point of right, ties by lower id."""
    return knn(left, right, 1).drop("rank")


_NEAR = ("id", "cid", "d2", "cx", "cy", "cz", "a", "b", "c", "wa", "wb", "wc", "k")
_WHOLE = ("id", "cid", "a", "b", "c", "k")
_PLACES = ", ".join(f"{c} {'long' if c in _WHOLE else 'double'}" for c in _NEAR)


def nearest_triangle(points: DataFrame, mesh: Mesh) -> DataFrame:
    """(id, cid, d2, cx, cy, cz, a, b, c, wa, wb, wc): the closest place on the polygons, ties by lower cell id.

    Points without a finite place have no rows; triangles with such a corner are no one's. Triangles are found by an index of their
    bounds, or where they are few by tasks that hold all of them.
    """
    columns = [F.col("tid.k").cast("long").alias("k"), "cid", *"abc", *(F.col(k + x).cast("double").alias(k + x) for k in "abc" for x in XYZ)]
    tri = settled(placed(mesh.placed_triangles().select(*columns), tuple(k + x for k in "abc" for x in XYZ)))
    whole = placed(points.select(F.col("pid").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in XYZ)))
    n = tri.count()
    if not n:
        return whole.select("id", *(F.lit(0).cast("long" if c in _WHOLE else "double").alias(c) for c in _NEAR[1:-1])).where("false")
    if n <= BLOCK_ROWS and n * whole.count() <= BLOCK_PAIRS:
        return nearest_triangle_in_blocks(whole, tri)
    regions = Regions.of(whole, TRIANGLE_REGIONS)
    if regions is None:
        return nearest_triangle_in_blocks(whole, tri.limit(1))
    tree, share = regions.tree, min(1.0, TRIED / n)
    reach = _reach(tree, _held((tri.sample(share, 7) if share < 1 else tri).toArrow()))

    def work(some: pa.Table, items: pa.Table) -> pa.Table:
        parts = [_closest_of(*(c.to_numpy() for c in some.select(["id", *XYZ]).columns), _held(items))] if len(items) and len(some) else []
        return pa.Table.from_batches(parts, schema=_PLACED)

    near = regions.met(tri.withColumn("key", F.xxhash64("cid", "k")), "key", lambda batch: _touched(_held(pa.Table.from_batches([batch]), False), tree, reach), work, _PLACES)
    best = near.groupBy("id").agg(F.min(F.struct("d2", "cid", "k", "cx", "cy", "cz", "a", "b", "c", "wa", "wb", "wc")).alias("s"))
    found = settled(best.select("id", *(F.col("s." + c).alias(c) for c in _NEAR[1:-1])))
    regions.remove()
    return found


_PLACED = pa.schema([(c, pa.int64() if c in _WHOLE else pa.float64()) for c in _NEAR])


def _held(tri: pa.Table, sort: bool = True) -> dict[str, np.ndarray]:
    """Triangles as arrays, in the order of cells, with their bounds, the planes they lie in (n, n . a; zeros where they are too thin to
    have a sure one) and how far rounding may put a place off its plane."""
    tri = tri.sort_by([("cid", "ascending"), ("k", "ascending")]) if sort else tri
    t = {c: np.column_stack([tri.column(c + x).to_numpy() for x in XYZ]) for c in "abc"}
    lo, hi = np.minimum(np.minimum(t["a"], t["b"]), t["c"]), np.maximum(np.maximum(t["a"], t["b"]), t["c"])
    u, v = t["b"] - t["a"], t["c"] - t["a"]
    with np.errstate(all="ignore"):
        n = np.cross(u, v)
        size = np.sqrt((n * n).sum(1))
        sure = (size > FLAT * np.sqrt((u * u).sum(1) * (v * v).sum(1))) & (size > 1e-200) & (size < 1e200)
        n = np.where(sure[:, None], n / size[:, None], 0.0)
    held = {"lo": lo, "hi": hi, "sure": sure, "n": n, "at": np.where(sure, (n * np.where(sure[:, None], t["a"], 0)).sum(1), 0.0), "slack": PLANE_SLACK * np.maximum(np.abs(lo), np.abs(hi)).max(1)}
    return t | held | {"cid": tri.column("cid").to_numpy(), "k": tri.column("k").to_numpy(), "ids": np.column_stack([tri.column(c).to_numpy() for c in "abc"])}


def _least_off(low: np.ndarray, high: np.ndarray, t: dict[str, np.ndarray], k: np.ndarray) -> np.ndarray:
    """A distance that no place of the boxes (one, or one a triangle) is nearer than to the triangles ``k``: by bounds and planes."""
    middle, half = low / 2 + high / 2, high / 2 - low / 2
    gap = np.maximum(np.maximum(t["lo"][k] - high, low - t["hi"][k]), 0)
    n = t["n"][k]
    slack = t["slack"][k] + PLANE_SLACK * np.maximum(np.abs(low), np.abs(high)).max(-1)
    dot = lambda a, b: np.einsum("ij,ij->i" if b.ndim > 1 else "ij,j->i", a, b)
    plane = np.abs(dot(n, middle) - t["at"][k]) - dot(np.abs(n), half)
    return np.maximum(np.sqrt(dot(gap, gap)), plane) - slack


def _exact(p: np.ndarray, t: dict[str, np.ndarray], k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared distances, closest places, weights) of places and the triangles ``k``, pair by pair."""
    place, w = g.closest_places(p, t["a"][k], t["b"][k], t["c"][k])
    return ((place - p) ** 2).sum(axis=1), place, w


def _closest_of(ids: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, t: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The closest place on held triangles for a block of points, ties by lower cell id.

    Points are halved until few are together. Each part keeps the triangles that a bound of its box doesn't rule out; for what is
    left the distances to planes, then those to bounds, say which pairs are compared exactly.
    """
    p = np.column_stack((x, y, z))
    best, d2, place, w = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros((len(p), 3)), np.zeros((len(p), 3))
    todo = [(np.arange(len(p)), np.arange(len(t["cid"])))] if len(p) else []
    while todo:
        some, tri = todo.pop()
        at = p[some]
        low, high = at.min(0), at.max(0)
        middle = low / 2 + high / 2
        near = _least_off(middle, middle, t, tri)
        first = tri[np.argpartition(near, min(TRIED_FIRST, len(tri)) - 1)[:TRIED_FIRST]]
        most = np.where(t["sure"][first], np.sqrt(_exact(np.broadcast_to(middle, (len(first), 3)), t, first)[0]) + t["slack"][first], np.inf).min() + PLANE_SLACK * np.abs(middle).max()
        tri = tri[_least_off(low, high, t, tri) <= (most + np.sqrt(((high - middle) ** 2).sum())) * (1 + 1e-9)]
        if len(some) > 1 and (len(some) > TOGETHER or len(some) * len(tri) > BLOCK_AT_ONCE):
            half = np.argpartition(at[:, int(np.argmax(high - low))], len(some) // 2)
            todo += [(some[half[: len(some) // 2]], tri), (some[half[len(some) // 2 :]], tri)]
            continue
        n = t["n"][tri]
        off = np.abs(at[:, :1] * n[:, 0] + at[:, 1:2] * n[:, 1] + at[:, 2:] * n[:, 2] - t["at"][tri]) - t["slack"][tri] - PLANE_SLACK * np.abs(at).max(1)[:, None]
        first = np.argpartition(off, min(TRIED_FIRST, len(tri)) - 1, axis=1)[:, :TRIED_FIRST]
        bound = np.sqrt(_exact(np.repeat(at, first.shape[1], axis=0), t, tri[first.ravel()])[0].reshape(first.shape).min(1))
        bound = np.minimum(bound, most + np.sqrt(((at - middle) ** 2).sum(1))) * (1 + 1e-9)
        row, col = np.nonzero(off <= bound[:, None])
        kept = _least_off(at[row], at[row], t, tri[col]) <= bound[row]
        row, col = row[kept], col[kept]
        found, places, weights = _exact(at[row], t, tri[col])
        order = np.lexsort((col, found, row))
        order = order[np.searchsorted(row[order], np.arange(len(some)))]
        best[some], d2[some], place[some], w[some] = tri[col[order]], found[order], places[order], weights[order]
    values = [ids, t["cid"][best], d2, *place.T, *t["ids"][best].T, *w.T, t["k"][best]]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], schema=_PLACED)


def _reach(tree: Tree, t: dict[str, np.ndarray]) -> np.ndarray:
    """For each node of a tree of places a distance within which every one of them has one of the triangles."""
    reach = np.full(len(tree.axis), np.inf)
    leaves = np.flatnonzero((tree.axis < 0) & (tree.rows > 0))
    middle = tree.low[leaves] / 2 + tree.high[leaves] / 2
    t = {k: v[t["sure"]] for k, v in t.items()}
    if len(t["cid"]):
        found = _closest_of(leaves, *(np.ascontiguousarray(c) for c in middle.T), t | {"cid": np.arange(len(t["cid"]))})
        d = np.sqrt(found.column("d2").to_numpy()) + t["slack"][found.column("cid").to_numpy()] + PLANE_SLACK * np.abs(middle).max(1)
        reach[leaves] = (d + np.sqrt(((tree.high[leaves] - middle) ** 2).sum(1))) * (1 + 1e-9)
    for node in range(len(tree.axis) - 1, -1, -1):  # children come after their parent
        if tree.axis[node] >= 0:
            reach[node] = reach[tree.below[node] : tree.below[node] + 2].max()
    return reach


def _touched(t: dict[str, np.ndarray], tree: Tree, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangle, leaf): leaves with places that a triangle may be the nearest of."""
    tri, node, found = np.arange(len(t["cid"])), np.zeros(len(t["cid"]), np.int64), []
    while len(tri):
        kept = tree.rows[node] > 0
        tri, node = tri[kept], node[kept]
        kept = _least_off(tree.low[node], tree.high[node], t, tri) <= reach[node]
        tri, node = tri[kept], node[kept]
        leaf = tree.axis[node] < 0
        at, of = tri[leaf], node[leaf]
        middle = tree.low[of] / 2 + tree.high[of] / 2
        off = np.sqrt(_exact(middle, t, at)[0]) - np.sqrt(((tree.high[of] - middle) ** 2).sum(1))
        near = ~t["sure"][at] | (off * (1 - 1e-9) - t["slack"][at] - PLANE_SLACK * np.abs(middle).max(1, initial=0) <= reach[of])
        found.append((at[near], of[near]))
        below = tree.below[node[~leaf]]
        tri, node = np.repeat(tri[~leaf], 2), np.column_stack((below, below + 1)).ravel()
    return tuple(np.concatenate(v) if found else np.zeros(0, np.int64) for v in (zip(*found, strict=True) if found else ((), ())))


def nearest_triangle_in_blocks(points: DataFrame, tri: DataFrame) -> DataFrame:
    """As ``nearest_triangle`` for at most BLOCK_ROWS placed triangles: tasks hold all of them."""
    sent = points.sparkSession.sparkContext.broadcast(_held(tri.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _closest_of(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), sent.value)

    return points.mapInArrow(run, _PLACES).drop("k")


def compare(source: Mesh, target: Mesh, signed: bool = True, near: DataFrame | None = None) -> DataFrame:
    """(pid, distance): distance of each source point to the target; the sign is that of the interpolated target normal times P - cp.

    ``near`` is what ``nearest_triangle`` found, where that is known.
    """
    near = nearest_triangle(source.points, target) if near is None else near
    if not signed:
        return near.select(F.col("id").alias("pid"), F.sqrt("d2").alias("distance"))
    if not target.has_normals:
        from .graph import vertex_normals

        target = vertex_normals(target)
    for k in "abc":
        near = near.join(target.points.select(F.col("pid").alias(k), *(F.col("n" + x).alias(f"n{k}{x}") for x in XYZ)), k)
    n = tuple(sum((F.col("w" + k) * F.col(f"n{k}{x}") for k in "bc"), F.col("wa") * F.col(f"na{x}")) for x in XYZ)
    rows = near.join(source.points.select(F.col("pid").alias("id"), *XYZ), "id")
    side = g.dot(n, g.sub(g.vector(*XYZ), g.vector("cx", "cy", "cz")))
    return rows.select(F.col("id").alias("pid"), (F.when(side < 0, -1.0).otherwise(1.0) * F.sqrt("d2")).alias("distance"))


def on_border(near: DataFrame, target: Mesh, tolerance: float = 1e-9) -> DataFrame:
    """(id) of ``nearest_triangle`` rows whose place lies on a border edge (squared distance under ``tolerance``)."""
    from .clip import feature_edges

    border = feature_edges(target, True, False).select("a", "b")
    for k in "ab":
        border = border.join(target.points.select(F.col("pid").alias(k), *(F.col(x).alias(k + x) for x in XYZ)), k)
    start, end = g.vector("ax", "ay", "az"), g.vector("bx", "by", "bz")
    border = settled(placed(border.drop("a", "b"), ("ax", "ay", "az", "bx", "by", "bz")).withColumn("long", g.norm(g.sub(end, start))))
    reach = math.sqrt(tolerance)
    # Edges are cut to pieces about as long as a cell; a piece is in all cells that its bounds, widened by the tolerance, touch.
    size = max((border.agg(F.avg("long")).first()[0] or 0.0) / EDGE_PIECES, 4 * reach)
    if not size:
        return near.select("id").where("false")
    n = F.greatest(F.ceil(F.col("long") / size), F.lit(1).cast("long"))
    pieces = border.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    wide = reach * (1 + 1e-9) + size * 1e-9
    for key, x in zip(CELL, XYZ, strict=True):
        p, q = (F.col("a" + x) + (F.col("b" + x) - F.col("a" + x)) * (F.col("k") + i) / F.col("n") for i in (0, 1))
        pieces = pieces.withColumn(key, F.explode(F.sequence(F.floor((F.least(p, q) - wide) / size), F.floor((F.greatest(p, q) + wide) / size))))
    at = g.vector("cx", "cy", "cz")
    places = near.select("id", "cx", "cy", "cz", *(F.floor(F.col("c" + x) / size).alias(key) for key, x in zip(CELL, XYZ, strict=True)))
    hit = places.join(pieces.drop("long", "n", "k"), list(CELL)).where(g.distance2(at, g.closest_on_segment(at, start, end)) < tolerance)
    return hit.select("id").distinct()


def compare_inside(source: Mesh, target: Mesh, signed: bool = True, tolerance: float = 1e-9, most: int | None = None) -> DataFrame:
    """As ``compare``, without the points whose closest place is on a border of the target.

    With ``most``, evenly spaced points by id are compared only, that many at most.
    """
    if most is not None:
        places = numbered(source.points, "_place", "pid")
        step = max(1, places.count() // most)
        source = source.with_points(places.where((F.col("_place") % step == 0) & (F.col("_place") < step * most)).drop("_place"))
    near = settled(nearest_triangle(source.points, target))
    inside = near.join(on_border(near, target, tolerance), "id", "left_anti")
    return compare(source, target, signed, inside)


def project_surface(source: Mesh, target: Mesh) -> tuple[Mesh, DataFrame]:
    """Source points moved to their closest places on the target, and the moves (pid, x, y, z)."""
    near = nearest_triangle(source.points, target).select(F.col("id").alias("pid"), "cx", "cy", "cz")
    rows = source.points.join(near, "pid")
    moved = rows.withColumns({x: F.col("c" + x) for x in XYZ}).select(*source.points.columns)
    return source.with_points(moved), rows.select("pid", *((F.col("c" + x) - F.col(x)).alias(x) for x in XYZ))


def closest_points_within(source: Mesh, target: DataFrame, radius: float) -> Mesh:
    """Distinct nearest source points within ``radius`` of target points, in order of first hit, with the polygons they span."""
    best = nearest(target, source.points).where(F.col("d2") <= radius * radius).select("id", F.col("other").alias("old"))
    hits = best.groupBy("old").agg(F.min("id").alias("first"))
    ids = numbered(hits, "pid", "first", "old")
    points = source.points.withColumnRenamed("pid", "old").join(ids.select("old", "pid"), "old").select(*source.points.columns)
    corner = source.corners().where("kind = 'polys'").join(ids.select(F.col("old").alias("pid"), F.col("pid").alias("new")), "pid", "left")
    cells = corner.groupBy("cid", "kind").agg(F.bool_and(F.col("new").isNotNull()).alias("all"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "new"))), lambda v: v["new"]).alias("pids"))
    return Mesh(points, cells.where("all").select("cid", "kind", "pids"))


def mark_covered(target: DataFrame, source: DataFrame, radius: float = 1.0) -> DataFrame:
    """Target points with scalar 1 where a source point is within ``radius``, else 0."""
    hit = nearest(target, source).where(F.col("d2") <= radius * radius).select(F.col("id").alias("pid")).distinct().withColumn("_hit", F.lit(1.0))
    return target.join(hit, "pid", "left").withColumn("scalar", F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def mark_sphere(points: DataFrame, center, radius: float, value: float = 1.0) -> DataFrame:
    """The scalar of points within a sphere becomes ``value``; a missing scalar column is 0 first."""
    old = F.col("scalar").cast("double") if "scalar" in points.columns else F.lit(0.0)
    inside = g.distance2(g.vector("x", "y", "z"), g.vector(*center)) <= radius * radius
    return points.withColumn("scalar", F.when(inside, float(value)).otherwise(old))


def radius_totals(points: DataFrame, radius: float, value: str | None = None) -> DataFrame:
    """(id, n, total, known): for each point (pid, x, y, z) the number of points within ``radius``, itself included, the sum of their
    ``value`` and the number of those that have one. Points without a finite place are left out.

    No pairs are listed. What lies within the radius of a whole region of points is summed once for it; only the others are copied
    to the region, and there parts of it take sums in the same way before few points are compared one by one.
    """
    rows = placed(points.select(F.col("pid").alias("id"), *(F.col(c).cast("double").alias(c) for c in XYZ), (F.col(value) if value else F.lit(0.0)).cast("double").alias("value")))
    regions = Regions.of(rows, RADIUS_REGIONS)
    kinds = dict(rows.dtypes)
    if regions is None:
        return rows.select("id", F.lit(1).cast("long").alias("n"), F.col("value").alias("total"), F.lit(1).cast("long").alias("known"))
    tree, limit = regions.tree, radius * radius
    # Farther or nearer than this no rounding of a distance matters.
    sure_in, sure_out = limit * (1 - 1e-9), limit * (1 + 1e-9)
    leaves = np.flatnonzero((tree.axis < 0) & (tree.rows > 0))

    def sides(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of each row and leaf, whether it is surely within the radius of all places there, and whether it may be of some."""
        p = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ])[:, None]
        near2, far2 = _box_distances(p, tree.low[leaves], tree.high[leaves])
        return far2 <= sure_in, near2 <= sure_out

    def partly(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        inside, some = sides(batch)
        row, leaf = np.nonzero(some & ~inside)
        return row, leaves[leaf]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known, total = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64), np.zeros(len(leaves))
        for batch in batches:
            for at in range(0, batch.num_rows, REGION_ROWS):
                some = batch.slice(at, REGION_ROWS)
                inside, (v, has) = sides(some)[0], _values(some.column("value"))
                n += inside.sum(0)
                known += inside[has].sum(0)
                total += _summed(inside, v)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (leaves, n, total, known)], ["leaf", "n", "total", "known"])

    def work(some: pa.Table, items: pa.Table) -> pa.Table:
        if not len(some) or not len(items):
            return _TOTALS.empty_table().select(["place", "n", "total", "known"])
        p, q = (np.column_stack([t.column(c).to_numpy() for c in XYZ]) for t in (some, items))
        found = _totals_of(p, q, *_values(items.column("value")), limit, sure_in, sure_out)
        return pa.table({"place": some.column("id"), "n": found[0], "total": found[1], "known": found[2]}).cast(pa.schema([pa.field("place", some.schema.field("id").type), *list(_TOTALS)[1:]]))

    part = regions.met(rows.withColumn("key", F.xxhash64("id", *XYZ)), "key", partly, work, f"place {kinds['id']}, n long, total double, known long").withColumnRenamed("place", "id")
    bulk = rows.mapInArrow(whole, "leaf long, n long, total double, known long").groupBy("leaf").agg(*(F.sum(c).alias(c) for c in ("n", "total", "known")))
    each = regions.places().join(F.broadcast(bulk), "leaf").select("id", "n", "total", "known")
    return part.unionByName(each)


_TOTALS = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), ("known", pa.int64())])


def _box_distances(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared least and most distances of places from boxes."""
    gap, far = np.maximum(np.maximum(low - p, p - high), 0), np.maximum(np.abs(p - low), np.abs(high - p))
    return np.einsum("...i,...i->...", gap, gap), np.einsum("...i,...i->...", far, far)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for null, and which are not null."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.fill_null(0.0).to_numpy(), ~np.asarray(column.is_null())


def _summed(chosen: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each column of a choice (rows by columns) the sum of the chosen rows' values; NaN and infinite ones count where chosen."""
    odd = ~np.isfinite(v)
    total = np.einsum("ij,i->j", chosen, np.where(odd, 0.0, v))
    return total + np.where(chosen[odd], v[odd][:, None], 0.0).sum(0) if odd.any() else total


def _totals_of(p: np.ndarray, q: np.ndarray, v: np.ndarray, has: np.ndarray, limit: float, sure_in: float, sure_out: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, total, known) over the items q with values v within the radius of each place p."""
    n, total, known = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p), np.int64)
    todo = [(np.arange(len(p)), np.arange(len(q)))]
    while todo:
        some, items = todo.pop()
        at = p[some]
        low, high = at.min(0), at.max(0)
        near2, far2 = _box_distances(q[items], low, high)
        inside = items[far2 <= sure_in]
        n[some] += len(inside)
        total[some] += v[inside].sum()
        known[some] += has[inside].sum()
        items = items[(near2 <= sure_out) & (far2 > sure_in)]
        if not len(items):
            continue
        if len(some) > 1 and (len(some) > TOGETHER or len(some) * len(items) > BLOCK_AT_ONCE):
            half = np.argpartition(at[:, int(np.argmax(high - low))], len(some) // 2)
            todo += [(some[half[: len(some) // 2]], items), (some[half[len(some) // 2 :]], items)]
            continue
        d = [at[:, k] - q[items, k][:, None] for k in range(3)]
        within = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= limit
        n[some] += within.sum(0)
        known[some] += within[has[items]].sum(0)
        total[some] += _summed(within, v[items])
    return n, total, known


def local_density(points: DataFrame, radius: float = 1.0, compat: bool = False) -> DataFrame:
    """(pid, density): points within ``radius`` by the volume of the sphere; ``compat`` leaves its third out."""
    volume = 4 * math.pi * radius**3 / (1 if compat else 3)
    return radius_totals(points, radius).groupBy(F.col("id").alias("pid")).agg((F.sum("n") / volume).alias("density"))


def smooth_scalar(points: DataFrame, radius: float) -> DataFrame:
    """Points with the mean scalar of their neighbours within ``radius``, themselves included."""
    if dict(points.dtypes)["scalar"].startswith("array"):
        raise ValueError("colours can't be averaged as scalars")
    mean = radius_totals(points, radius, "scalar").groupBy(F.col("id").alias("pid")).agg(F.try_divide(F.sum("total"), F.sum("known")).alias("scalar"))
    return points.drop("scalar").join(mean, "pid")


def neighbour_distances(points: DataFrame) -> DataFrame:
    """(pid, distance) to the second of the two nearest points (itself is one), zeros left out."""
    return knn(points, points, 2).where("rank = 2 and d2 > 0").select(F.col("id").alias("pid"), F.sqrt("d2").alias("distance"))


def nearest_to_plane(points: DataFrame, origin, normal) -> DataFrame:
    """(pid, distance): the point with the least unsigned distance, ties by lower id."""
    d = F.abs(g.dot(g.sub(g.vector("x", "y", "z"), g.vector(*origin)), g.normalised(g.vector(*normal))))
    return points.agg(F.min(F.struct(d.alias("distance"), "pid")).alias("s")).select("s.pid", "s.distance").where("pid is not null")


def landmark_overlap(a: DataFrame, b: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Landmarks at the same position in both collections where both are active, of the given ids only."""
    other = b.select("lm_pos", F.col("active").alias("_a"), *(F.col(c).alias("o" + c) for c in XYZ))
    rows = a.join(other, "lm_pos").where("active <> 0 and _a <> 0").drop("_a")
    return rows.where(F.col("id").isin(ids)) if ids is not None else rows


def selected_landmarks(landmarks: DataFrame, ids: list[int]) -> DataFrame:
    """The landmarks of an id list, in its order (column ``at``)."""
    wanted = landmarks.sparkSession.createDataFrame(list(enumerate(ids)), "at int, id int")
    return landmarks.join(F.broadcast(wanted), "id")


def picked(mesh: Mesh, pid: int) -> DataFrame:
    """One row of text about a point."""
    parts = [F.format_string("id %d, position %.6f %.6f %.6f", "pid", *XYZ)]
    if mesh.has_scalar:
        parts.append(F.format_string("scalar %.6f", F.col("scalar").cast("double")))
    if mesh.has_texture:
        parts.append(F.format_string("texture %.6f %.6f", F.col("u").cast("double"), F.col("v").cast("double")))
    return mesh.points.where(F.col("pid") == pid).select(F.concat_ws(", ", *parts).alias("text"))


def random_resample(mesh: Mesh, n: int = 1000, border: float = 5.0, seed: int = 0, normals: bool = False) -> Mesh:
    """n uniform places in the bounds widened by ``border``, moved to the closest place on the surface.

    ``normals`` gives them the unit normal that the corners' normals have there; a surface without normals gets them first.
    """
    spark = mesh.points.sparkSession
    box = mesh.points.agg(*(f(c).alias(k + c) for c in XYZ for k, f in (("lo", F.min), ("hi", F.max))))
    rows = spark.range(n).select(F.col("id").alias("pid"), *(F.rand(seed + i).alias("r" + c) for i, c in enumerate(XYZ))).join(F.broadcast(box))
    places = settled(rows.select("pid", *((F.col("lo" + c) - border + F.col("r" + c) * (F.col("hi" + c) - F.col("lo" + c) + 2 * border)).alias(c) for c in XYZ)))
    near = nearest_triangle(places, mesh)
    found = [F.col("id").alias("pid"), *(F.col("c" + c).alias(c) for c in XYZ)]
    if not normals:
        return cloud(near.select(*found))
    if not mesh.has_normals:
        from .graph import vertex_normals

        mesh = vertex_normals(mesh)
    for k in "abc":
        near = near.join(mesh.points.select(F.col("pid").alias(k), *(F.col("n" + x).alias(f"n{k}{x}") for x in XYZ)), k)
    mixed = tuple(sum((F.col("w" + k) * F.col(f"n{k}{x}") for k in "bc"), F.col("wa") * F.col(f"na{x}")) for x in XYZ)
    return cloud(near.select(*found, *(v.alias("n" + x) for v, x in zip(g.normalised(mixed), XYZ, strict=True))))

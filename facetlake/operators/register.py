"""Registration: landmark transforms and iterative closest points. Sums are Spark aggregates, 4x4 algebra is the driver's."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Mesh
from ..sharing import numbered, settled
from .clip import feature_edges
from .project import apply_transform
from .sets import stride
from .spatial import compare, nearest, nearest_triangle, on_border

XYZ = ("x", "y", "z")


def landmark_transform(pairs: DataFrame, mode: str = "rigid") -> np.ndarray:
    """4x4 that takes (x, y, z) to (tx, ty, tz) with least squares; mode ``rigid``, ``similarity`` or ``affine``.

    Horn's quaternion form (1987) from sums of centred products. No pairs give the identity, one a translation; two, or pairs in
    line, the least turn that fits. Affine needs four pairs not in a plane, else it is a similarity.
    """
    means = pairs.agg(F.count("*").alias("n"), *(F.avg(c).alias("m" + c) for c in (*XYZ, "tx", "ty", "tz"))).first()
    if not means["n"]:
        return np.eye(4)
    a = {c: F.col(c) - float(means["m" + c]) for c in (*XYZ, "tx", "ty", "tz")}
    sums = {f"{p}_{q}": F.sum(a[p] * a[q]) for p in XYZ for q in ("tx", "ty", "tz")} | {f"{p}_{q}": F.sum(a[p] * a[q]) for p in XYZ for q in XYZ} | {"tt": F.sum(sum((a[t] * a[t] for t in ("ty", "tz")), a["tx"] * a["tx"]))}
    row = pairs.agg(*(v.alias(k) for k, v in sums.items())).first()
    s = np.array([[row[f"{p}_{q}"] for q in ("tx", "ty", "tz")] for p in XYZ])
    c = np.array([[row[f"{p}_{q}"] for q in XYZ] for p in XYZ])
    mean, target = (np.array([means["m" + k] for k in names]) for names in (XYZ, ("tx", "ty", "tz")))
    m = np.eye(4)
    if mode == "affine" and means["n"] >= 4 and np.linalg.matrix_rank(c, tol=1e-9 * max(1e-300, np.abs(c).max())) == 3:
        part = np.linalg.solve(c, s).T
    else:
        part = rotation(s)
        if mode != "rigid" and np.trace(c) > 0:
            part = part * np.sqrt(row["tt"] / np.trace(c))
    m[:3, :3], m[:3, 3] = part, target - part @ mean
    return m


def rotation(s: np.ndarray) -> np.ndarray:
    """The rotation that fits the products s[i][j] = sum of source i times target j."""
    if not np.abs(s).max() > 0:
        return np.eye(3)
    if np.linalg.matrix_rank(s, tol=1e-9 * np.abs(s).max()) < 2:  # in line: the least turn from one direction to the other
        u, _, vt = np.linalg.svd(s)
        a, b = u[:, 0], vt[0]
        v, cos = np.cross(a, b), float(a @ b)
        if cos < -1 + 1e-12:
            p = np.cross(a, [1, 0, 0] if abs(a[0]) < 0.9 else [0, 1, 0])
            p /= np.linalg.norm(p)
            return 2 * np.outer(p, p) - np.eye(3)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        return np.eye(3) + k + k @ k / (1 + cos)
    n = np.empty((4, 4))
    d = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    n[0, 0], n[0, 1:], n[1:, 0] = np.trace(s), d, d
    n[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    w, x, y, z = np.linalg.eigh(n)[1][:, -1]
    return np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])


@dataclass(frozen=True)
class IcpOptions:
    """Parameters of a registration, with the usual defaults."""

    landmarks: int = 1000
    iterations: int = 100
    stop: float = 0.001
    mode: str = "rigid"
    match_centroids: bool = False
    skip_border: bool = False
    points_first: bool = False


def icp(source: Mesh, target: Mesh, options: IcpOptions = IcpOptions()) -> np.ndarray:  # noqa: B008
    """4x4 that moves the source onto the target: closest places, least-squares fit, repeat.

    Ends where the mean distance changes by less than ``stop``. With ``skip_border``, pairs that land on the target's border are
    left out and the landmarks grow from 3 % over 5 % and 10 % to all at 10, 20 and 30 % of the iterations. ``points_first`` pairs
    with the target's points until the mean distance settles, then with places on its surface. The result is refitted at the
    end from all marks to where the steps together have put them, so that rounding in many steps leaves a pure turn and shift.
    """
    # Dense places, of the points and again of the marks: a stride goes by them, whatever the ids are.
    dense = lambda rows: numbered(rows.withColumnRenamed("pid", "_id"), "pid", "_id").select("pid", *XYZ)
    marks = settled(dense(stride(dense(source.points.select("pid", *XYZ)), min(options.landmarks, max(1, source.points.count())))))
    total, m, last = marks.count(), np.eye(4), None
    if options.match_centroids:
        a, b = (df.agg(*(F.avg(c) for c in XYZ)).first() for df in (source.points, target.points))
        m[:3, 3] = np.array(b) - np.array(a)
    phase = "points" if options.points_first else "surface"
    for i in range(options.iterations):
        share = 1.0 if not options.skip_border else next((s for limit, s in ((0.1, 0.03), (0.2, 0.05), (0.3, 0.1)) if i < limit * options.iterations), 1.0)
        some = stride(marks, max(1, int(share * total))) if share < 1 else marks
        moved = settled(apply_transform(Mesh(some, None), m).points)
        if phase == "points":
            near = nearest(moved, target.points).join(target.points.select(F.col("pid").alias("other"), *(F.col(c).alias("c" + c) for c in XYZ)), "other")
            if options.skip_border:
                near = near.join(settled(border_points(target)), "other", "left_anti")
        else:
            near = nearest_triangle(moved, target)
            if options.skip_border:
                near = settled(near)
                near = near.join(on_border(near, target), "id", "left_anti")
        pairs = settled(near.select(F.col("id").alias("pid"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("cz").alias("tz"), "d2").join(moved, "pid"))
        mean = pairs.agg(F.avg(F.sqrt("d2"))).first()[0]
        if mean is None:
            break
        m = landmark_transform(pairs, options.mode) @ m
        last, before = mean if share == 1.0 else None, last
        if share == 1.0 and (mean < 1e-12 or before is not None and abs(before - mean) < options.stop):
            if phase == "surface":
                break
            phase, last = "surface", None
    return refitted(marks, m, options.mode)


def border_points(mesh: Mesh) -> DataFrame:
    """(other): points of border edges."""
    return feature_edges(mesh, True, False).select(F.explode(F.array("a", "b")).alias("other")).distinct()


def refitted(marks: DataFrame, m: np.ndarray, mode: str) -> np.ndarray:
    """The transform of the mode that takes the marks to where ``m`` puts them; ``m`` itself for fewer than three marks."""
    if marks.count() < 3:
        return m
    moved = apply_transform(Mesh(marks.select("pid", *XYZ), None), m).points
    pairs = marks.select("pid", *XYZ).join(moved.select("pid", *(F.col(c).alias("t" + c) for c in XYZ)), "pid")
    return landmark_transform(pairs, mode)


def align(source: Mesh, target: Mesh, options: IcpOptions = IcpOptions(), errors: bool = False) -> tuple[Mesh, np.ndarray, DataFrame | None]:  # noqa: B008
    """The moved source, its matrix, and with ``errors`` the distances that remain."""
    m = icp(source, target, options)
    moved = apply_transform(source, m)
    return moved, m, compare(moved, target) if errors else None

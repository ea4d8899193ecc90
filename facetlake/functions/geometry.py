"""Vectors as triples of columns: products, distances, closest points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(x, y, z) -> Vector:
    return tuple(F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vector, s) -> Vector:
    return tuple(p * s for p in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vector, b: Vector) -> Column:
    d = sub(a, b)
    return dot(d, d)


def divided(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, ``otherwise`` where b is 0 (plain division by 0 is an error)."""
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def normalised(a: Vector) -> Vector:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return tuple(F.coalesce(F.try_divide(p, n), p) for p in a)


def choose(when: Column, a: Vector, b: Vector) -> Vector:
    return tuple(F.when(when, p).otherwise(q) for p, q in zip(a, b, strict=True))


def closest_on_segment(p: Vector, a: Vector, b: Vector) -> Vector:
    """Closest point to p on the segment a b; a where they coincide."""
    ab = sub(b, a)
    t = F.least(F.greatest(divided(dot(sub(p, a), ab), dot(ab, ab)), F.lit(0.0)), F.lit(1.0))
    return add(a, scale(ab, t))


def closest_places(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest places to p on triangles a b c (rows of three numbers), and their weights of a, b and c.

    The projection where it falls inside, else the closest of the three sides. Weights of triangles in line are (1, 0, 0).
    """
    row = lambda x, y: np.einsum("ij,ij->i", x, y)
    ratio = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y != 0)

    def weights(q: np.ndarray) -> np.ndarray:
        u, v, w = b - a, c - a, q - a
        uu, uv, vv, wu, wv = row(u, u), row(u, v), row(v, v), row(w, u), row(w, v)
        area = uu * vv - uv * uv
        s, t = ratio(vv * wu - uv * wv, area), ratio(uu * wv - uv * wu, area)
        return np.stack((1 - s - t, s, t), axis=1)

    def on_side(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        d = r - q
        return q + d * np.clip(ratio(row(p - q, d), row(d, d)), 0, 1)[:, None]

    w = weights(p)
    n = np.cross(b - a, c - a)
    inside = (w >= 0).all(axis=1) & (row(n, n) > 0)
    sides = np.stack([on_side(q, r) for q, r in ((a, b), (b, c), (c, a))])
    best = ((sides - p) ** 2).sum(axis=2).argmin(axis=0)
    side = sides[best, np.arange(len(p))]
    at = np.where(inside[:, None], w[:, :1] * a + w[:, 1:2] * b + w[:, 2:] * c, side)
    return at, weights(at)


def angle_degrees(a: Vector, b: Vector) -> Column:
    """Angle between two vectors, null where one is zero."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


def positive_angle(a: Column) -> Column:
    """An angle in radians moved into [0, 2 pi]; 2 pi itself stays."""
    two = 2 * F.pi()
    return F.when((a >= 0) & (a <= two), a).otherwise(F.pmod(a, two))


def standard_spherical(theta: Column, phi: Column) -> tuple[Column, Column]:
    """(theta in [0, pi], phi in [0, 2 pi)) for the same direction: a theta beyond pi is mirrored and turns phi by pi."""
    two = 2 * F.pi()
    t = F.pmod(theta, two)
    over = t > F.pi()
    return F.when(over, two - t).otherwise(t), F.pmod(F.when(over, phi + F.pi()).otherwise(phi), two)

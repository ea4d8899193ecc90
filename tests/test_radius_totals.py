"""Counts and means within a radius, without lists of pairs, against brute force."""

import math

import numpy as np
import pytest

from facetlake.operators import index, spatial

from .test_index import NOWHERE, hard_cloud


def no_pairs(*args):
    raise AssertionError("pairs within the radius were listed")


@pytest.mark.parametrize("radius", [0.2, 0.9])
def test_density_and_mean_of_a_hard_cloud(spark, monkeypatch, radius):
    monkeypatch.setattr(spatial, "radius_join", no_pairs)
    for module, name, value in ((spatial, "RADIUS_REGIONS", 6), (spatial, "TOGETHER", 4), (spatial, "REGION_ROWS", 30), (index, "REGION_ITEMS", 40), (index, "REGION_PLACES", 16), (index, "AT_ONCE", 50)):
        monkeypatch.setattr(module, name, value)
    p = np.concatenate([hard_cloud(150, 7), [[0.5, 0.5, 0.5], [0.5, 0.5, 0.5 + radius]]])
    value = [None if i % 7 == 0 else float(i % 5) for i in range(len(p))]
    value[len(p) - 3 - 40] = math.nan
    rows = [(i, *map(float, at), v) for i, (at, v) in enumerate(zip(p, value, strict=True))] + [(1000 + i, *(None if v is None else float(v) for v in at), 1.0) for i, at in enumerate(NOWHERE)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double, scalar double")
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= radius * radius
    density = {r["pid"]: r["density"] for r in spatial.local_density(points, radius).collect()}
    assert density == {i: int(n) / (4 * math.pi * radius**3 / 3) for i, n in enumerate(near.sum(1))}
    mean = {r["pid"]: r["scalar"] for r in spatial.smooth_scalar(points, radius).collect()}
    for i, row in enumerate(near):
        known = [value[k] for k in np.flatnonzero(row) if value[k] is not None]
        expected = sum(known) / len(known) if known else None
        assert mean[i] == expected or (mean[i] != mean[i] and expected != expected), i
    assert set(mean) == set(range(len(p)))

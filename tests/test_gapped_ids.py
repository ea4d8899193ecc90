"""Registration and intersection of lines whose ids have gaps, below and above ten thousand rows."""

import numpy as np
import pytest
from facetlake.model import Mesh
from facetlake.operators import measure, register


@pytest.mark.parametrize("n", [200, 10_500])
def test_lines_with_gapped_ids_meet(spark, n):
    d = np.random.default_rng(1).normal(size=(n, 3))
    rows = [(1_000_000 + 7 * i, 1.0, 2.0, 3.0, *map(float, (1 + x, 2 + y, 3 + z))) for i, (x, y, z) in enumerate(d)]
    lines = spark.createDataFrame(rows, "lid long, px double, py double, pz double, qx double, qy double, qz double")
    (found,) = measure.ransac_intersection(lines, iterations=5).collect()
    assert (found["x"], found["y"], found["z"]) == pytest.approx((1, 2, 3))


@pytest.mark.parametrize("n", [500, 12_000])
def test_icp_rounds_have_their_share_of_marks(spark, monkeypatch, n):
    points = spark.createDataFrame([(50 + 3 * i, float(i % 100), float(i // 100), 0.0) for i in range(n)], "pid long, x double, y double, z double")
    seen = []

    def near(moved, target):
        seen.append(moved.count())
        return moved.selectExpr("pid as id", "x as cx", "y as cy", "z as cz", "0D as d2")

    monkeypatch.setattr(register, "nearest_triangle", near)
    monkeypatch.setattr(register, "on_border", lambda near, target: near.select("id").where("false"))
    mesh = Mesh(points, None)
    register.icp(mesh, mesh, register.IcpOptions(landmarks=400, iterations=10, skip_border=True))
    assert seen == [12, 20, 40, 400]

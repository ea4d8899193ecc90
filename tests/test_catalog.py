"""Every registered query over the smallest tables, against its SQL where it has some."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from facetlake.plans import catalog

from .conftest import SF, same


def cloud():
    """Places of the table's cloud, in the order of ids."""
    rows = sorted(pq.read_table(f"{SF}/embeddings.parquet").to_pylist(), key=lambda r: r["vec_id"])
    return np.array([r["embedding"][:3] for r in rows], float)


def ring(n):
    """Neighbours in the mesh that has a triangle over each three following points."""
    return [[j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < n] for i in range(n)]


def plain_axes(found):
    p = cloud()
    values, axes = np.linalg.eigh(np.cov(p.T, bias=True))
    found = found.sort_values("axis")
    assert np.allclose(found["mean"], p.mean(0))
    assert np.allclose(sorted(found["eigenvalue"]), values, rtol=1e-6) or np.allclose(sorted(found["eigenvalue"]), values * len(p) / (len(p) - 1), rtol=1e-6)
    got = found.sort_values("eigenvalue")[["x", "y", "z"]].to_numpy()
    assert np.allclose(np.abs((got * axes.T).sum(1)), 1)


def plain_low_pass(found):
    p = cloud()
    near = ring(len(p))
    for step in [0.5, -0.53] * 20:
        p = p + step * (np.array([p[k].mean(0) for k in near]) - p)
    assert np.allclose(found.sort_values("pid")[["x", "y", "z"]], p)


def plain_normals(found):
    p = cloud()
    found = found.set_index("pid").sort_index()
    assert len(found) == len(p)
    for i in range(0, len(p), 7):
        d = ((p - p[i]) ** 2).sum(1)
        near = [k for k in np.lexsort((np.arange(len(p)), d))[:6] if k != i]
        normal = np.linalg.eigh(np.cov(p[near].T, bias=True))[1][:, 0]
        assert abs(normal @ found.loc[i, ["nx", "ny", "nz"]].to_numpy(float)) == pytest.approx(1, abs=1e-6)


def plain_decimation(found):
    """Half of the triangles of a strip go; what is left lies within the cloud's bounds."""
    p = cloud()
    assert len(found) <= (len(p) - 2) - int(0.5 * (len(p) - 2)) + 2 and len(found) > 0.4 * len(p)
    size = p.max(0) - p.min(0)
    assert (found[["x", "y", "z"]].to_numpy() >= p.min(0) - size / 2).all() and (found[["x", "y", "z"]].to_numpy() <= p.max(0) + size / 2).all()


#: Plain versions of queries that SQL can't express.
PLAIN = {"principal_axes": plain_axes, "smooth_low_pass": plain_low_pass, "pca_normals": plain_normals, "quadric_decimate": plain_decimation}


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        same(found, duck.execute(catalog.ORACLES[name]).df())
    elif name in PLAIN:
        PLAIN[name](found)
    else:
        assert len(found) > 0 and not found.isna().all().any()


def test_entry_point(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.entry(spark).columns) > 1

"""No table of a mesh's size goes to the driver while edges collapse."""

from facetlake.operators import decimate

from .test_collapse_and_flood import arrays, mesh_of, sheet


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, settled = [], decimate.settled

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df, *more)

    monkeypatch.setattr(decimate, "settled", seen)
    xyz, tri = sheet(4, 0.5)
    assert len(arrays(decimate.decimate(mesh_of(spark, xyz, tri), 0.3))[1]) < len(tri)
    joins = [p for p in plans if "Join" in p and "_start" not in p]  # ``numbered`` broadcasts a row a partition
    assert len(joins) > 4 and not any("Broadcast" in p for p in joins)

"""Surfaces as tables: points, cells, and a scene that names them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the name of a derived surface ends in, by what it is derived with; braces are filled in.
SUFFIXES = {
    "mirror": "_mirror",
    "flip": "_flip",
    "line_normals": "_LineNormals",
    "close_holes": "_CloseHoles",
    "connect": "_connect{0}",
    "largest_region": "_largestregion",
    "outer_region": "_outersurface",
    "closest_region": "_closestPointRegion",
    "scalar_region": "_scalarRegion_{0}_{1}",
    "normals": "_normals",
    "scalar_smooth": "_ScalarSmooth_R{0}",
    "threshold": "_threshold_{0}_to_{1}",
    "merge": "_MergedWith_{0}",
    "compare": "_ComparedTo_{0}",
    "icp": "_ICPAlignedTo_{0}",
    "closest_points": "_ClosestPointsTo_{0}",
    "animate": "_animated",
    "project": "_ProjectedTo_{0}",
}

KINDS = ("verts", "lines", "polys", "strips")


@dataclass(frozen=True)
class Mesh:
    """points(pid, x, y, z[, scalar][, nx, ny, nz][, u, v][, rgb]) and cells(cid, kind, pids[, more])."""

    points: DataFrame
    cells: DataFrame

    @property
    def has_scalar(self) -> bool:
        return "scalar" in self.points.columns

    @property
    def has_normals(self) -> bool:
        return {"nx", "ny", "nz"} <= set(self.points.columns)

    @property
    def has_texture(self) -> bool:
        return {"u", "v"} <= set(self.points.columns)

    def with_points(self, points: DataFrame) -> Mesh:
        return replace(self, points=points)

    def drop_normals(self) -> Mesh:
        return self.with_points(self.points.drop("nx", "ny", "nz"))

    def drop_scalar(self) -> Mesh:
        return self.with_points(self.points.drop("scalar"))

    def corners(self) -> DataFrame:
        """(cid, kind, ord, pid): one row a vertex of a cell."""
        return self.cells.select("cid", "kind", F.posexplode("pids").alias("ord", "pid"))

    def triangles(self) -> DataFrame:
        """(tid, cid, a, b, c): polygons as fans from their first vertex; strips turn every second triangle."""
        size = F.size("pids")
        k = F.posexplode(F.when(size >= 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>")))
        rows = self.cells.where(F.col("kind").isin("polys", "strips")).select("cid", "kind", "pids", k.alias("k", "_k"))
        at = lambda i: F.element_at("pids", (i + 1).cast("int"))
        strip, odd = F.col("kind") == "strips", F.col("k") % 2 == 1
        a = F.when(strip, at(F.col("k"))).otherwise(at(F.lit(0)))
        b = F.when(strip & odd, at(F.col("k") + 2)).otherwise(at(F.col("k") + 1))
        c = F.when(strip & odd, at(F.col("k") + 1)).otherwise(at(F.col("k") + 2))
        return rows.select(F.struct("cid", "k").alias("tid"), "cid", a.alias("a"), b.alias("b"), c.alias("c"))

    def placed_triangles(self, *extra: str) -> DataFrame:
        """Triangles with the coordinates of their corners (ax .. cz), and ``extra`` point columns with the corner before them."""
        rows = self.triangles()
        for corner in "abc":
            columns = [F.col("pid").alias(corner), *(F.col(c).alias(corner + c) for c in ("x", "y", "z", *extra))]
            rows = rows.join(self.points.select(*columns), corner)
        return rows


@dataclass
class Surface:
    """A named mesh, its 4x4 placement (rows), and the state before the last cut."""

    name: str
    mesh: Mesh
    matrix: tuple[float, ...] = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    display: dict = field(default_factory=dict)
    before: tuple[str, Mesh, tuple[float, ...]] | None = None

    def store(self) -> None:
        self.before = (self.name, self.mesh, self.matrix)

    def undo(self) -> bool:
        """Back to the stored state, once."""
        if self.before is None:
            return False
        (self.name, self.mesh, self.matrix), self.before = self.before, None
        return True


class Scene:
    """Surfaces in order, with ids that stay when others go."""

    def __init__(self) -> None:
        self.surfaces: dict[int, Surface] = {}
        self.next_id = 0

    @classmethod
    def read(cls, spark: SparkSession, *paths: str) -> Scene:
        """The surfaces of files, in order; an OBJ with materials gives one for each material."""
        from .sources.readers import read_scene

        return read_scene(spark, *paths, scene=cls())

    def write(self, path: str, kind: str, **options) -> None:
        """All surfaces, placed, as one file."""
        from .sources.writers import write_scene

        write_scene(self, path, kind, **options)

    def add(self, name: str, mesh: Mesh) -> int:
        self.surfaces[self.next_id] = Surface(name, mesh)
        self.next_id += 1
        return self.next_id - 1

    def __getitem__(self, surface_id: int) -> Surface:
        if surface_id not in self.surfaces:
            raise KeyError(f"no surface {surface_id}")
        return self.surfaces[surface_id]

    def remove(self, surface_id: int) -> None:
        self[surface_id]
        del self.surfaces[surface_id]

    def position(self, surface_id: int) -> int:
        self[surface_id]
        return list(self.surfaces).index(surface_id)

    def put(self, surface_id: int, suffix: str, mesh: Mesh, replaced: bool) -> int:
        """A derived mesh: in place of the surface, or as a new one named by the suffix."""
        old = self[surface_id]
        if replaced:
            old.mesh = mesh
            return surface_id
        return self.add(old.name + suffix, mesh)

    def derive(self, surface_id: int, how: str, mesh: Mesh, *values, replaced: bool = False) -> int:
        """As ``put``, with the suffix that ``SUFFIXES`` has for an operation and its values (numbers, or names of other surfaces)."""
        if how not in SUFFIXES:
            raise ValueError(f"no derived name for {how}")
        return self.put(surface_id, SUFFIXES[how].format(*(f"{v:g}" if isinstance(v, float) else v for v in values)), mesh, replaced)

    def cut(self, surface_id: int, mesh: Mesh) -> int:
        """Replace a surface by its cut; the state before can be had back, the placement is reset, the suffix is added once."""
        s = self[surface_id]
        s.store()
        s.mesh, s.matrix = mesh, Surface.matrix
        s.name += "" if s.name.endswith("_cut") else "_cut"
        return surface_id

    def picker_names(self) -> list[str]:
        return [f"{i:03d} : {s.name}" for i, s in enumerate(self.surfaces.values(), 1)]


def cloud(points: DataFrame) -> Mesh:
    """A mesh of loose points, one vertex cell each."""
    return Mesh(points, points.select(F.col("pid").alias("cid"), F.lit("verts").alias("kind"), F.array("pid").alias("pids")))

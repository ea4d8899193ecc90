"""Registered queries over the test tables, and the same in SQL for DuckDB where SQL can say it.

``embeddings`` stands for a point cloud: the first three numbers are the place, the label is scalar and surface, vec_id the point
id. Its mesh has a triangle over each three consecutive ids. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import statistics as st
from ..functions import text as tx
from ..model import Mesh, cloud
from ..operators import clip, decimate, generate, graph, measure, project, register, sets, spatial, volume

XYZ = ("x", "y", "z")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The cloud and its mesh in SQL.
CLOUD = "p AS (SELECT label AS surface, vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label::DOUBLE AS scalar FROM embeddings)"
MOVED = "q AS (SELECT vec_id AS pid, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z FROM embeddings)"
TRI = "t AS (SELECT a.pid AS cid, a.pid AS a, b.pid AS b, c.pid AS c, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM p a JOIN p b ON b.pid = a.pid + 1 JOIN p c ON c.pid = a.pid + 2)"
RADIUS = 0.25


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedded(spark: SparkSession, sf_dir: str, first: int = 0) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("surface"), F.col("vec_id").alias("pid"), *(F.get("embedding", F.lit(first + i)).cast("double").alias(c) for i, c in enumerate(XYZ)), F.col("label").cast("double").alias("scalar"))


def strip_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    """A triangle over each three consecutive points."""
    points = embedded(spark, sf_dir).drop("surface")
    ids = points.select("pid")
    both = ids.join(ids.select((F.col("pid") - 1).alias("pid")), "pid", "left_semi").join(ids.select((F.col("pid") - 2).alias("pid")), "pid", "left_semi")
    cells = both.select(F.col("pid").alias("cid"), F.lit("polys").alias("kind"), F.array("pid", F.col("pid") + 1, F.col("pid") + 2).alias("pids"))
    return Mesh(points, cells)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros; all double columns where none are named."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


def r6(*names: str) -> str:
    return ", ".join(f"round({n.partition(' AS ')[0]}, 6) + 0.0 AS {n.partition(' AS ')[2] or n}" for n in names)


LINKS = f"l AS (SELECT a.pid AS a, b.pid AS b FROM p a JOIN p b ON a.pid <> b.pid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= {RADIUS * RADIUS})"
D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"

# Reports and order statistics


@query(f"""WITH {CLOUD}, s AS (SELECT surface, list_sort(list(scalar)) AS v, count(*) AS points, min(scalar) AS scalar_min, max(scalar) AS scalar_max, avg(scalar) AS scalar_mean, stddev_pop(scalar) AS scalar_sdev, sqrt(avg(scalar * scalar)) AS scalar_rms,
min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM p GROUP BY surface)
SELECT surface, points, {r6('scalar_min', 'scalar_max', 'scalar_mean', 'scalar_sdev', 'scalar_rms', 'min_x', 'max_x', 'min_y', 'max_y', 'min_z', 'max_z', '(max_x - min_x) * (max_y - min_y) * (max_z - min_z) AS volume', 'v[1 + floor(points * 0.5)::INT] AS scalar_median', 'v[1 + floor(points * 0.05)::INT] AS scalar_p05', 'v[1 + floor(points * 0.95)::INT] AS scalar_p95')} FROM s""")
def surface_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.surface_report(embedded(spark, sf_dir), ["surface"]))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n, count(*) AS points, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_pop(value) AS sdev, sqrt(avg(value * value)) AS rms FROM events GROUP BY event_type)
SELECT event_type, points, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(sdev, 6) AS sdev, round(rms, 6) AS rms, round(v[1 + floor(n * 0.5)::INT], 6) AS median, round(v[1 + floor(n * 0.05)::INT], 6) AS p05, round(v[1 + floor(n * 0.95)::INT], 6) AS p95 FROM s""")
def scalar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    stats = e.groupBy("event_type").agg(F.count("*").alias("points"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), st.sdev(v).alias("sdev"), st.rms(v).alias("rms"))
    return rounded(stats.join(st.fractiles(e, ["event_type"], "value", {"median": 0.5, "p05": 0.05, "p95": 0.95}), "event_type"))


@query("""WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, v[1 + floor(n * 0.5)::INT] AS median, v[1 + floor(n * 0.05)::INT] AS p05, v[1 + floor(n * 0.95)::INT] AS p95 FROM s""")
def fractiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.fractiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p05": 0.05, "p95": 0.95})


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sdev FROM r WHERE k BETWEEN floor(n * 0.1) AND floor(n * 0.9) GROUP BY l_returnflag""")
def robust_mean_sdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.robust_mean_sdev(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.1, 0.9), digits=4)


@query("""SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_quantity) AS unique_count, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance FROM lineitem GROUP BY l_returnflag""")
def min_max_unique_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min(q).alias("lo"), F.max(q).alias("hi"), F.count_distinct(q).alias("unique_count"), st.rms(q).alias("rms"), F.avg(q).alias("mean"), F.var_pop(q).alias("variance")), "rms", "mean", "variance")


@query("""SELECT l_returnflag, round(sum((l_quantity - l_extendedprice) * (l_quantity - l_extendedprice)) / 1e6, 3) AS sum_sq_millions, round(avg(abs(l_quantity - l_extendedprice)), 4) AS mean_abs_diff, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY l_returnflag""")
def difference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measure.difference_stats(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rows.select("l_returnflag", F.round(F.col("sum_sq_diff") / 1e6, 3).alias("sum_sq_millions"), F.round("mean_abs_diff", 4).alias("mean_abs_diff"), F.round("correlation", 6).alias("correlation"))


# Windows, sorts, samples


@query("""SELECT event_id, v[1 + (len(v) // 2)::INT] AS median FROM (SELECT event_id, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS v FROM events)""")
def windowed_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.windowed(table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), "value", ["event_type"], ["ts", "event_id"], 7, "median", "median").select("event_id", "median")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS average FROM events""")
def windowed_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.windowed(table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), "value", ["event_type"], ["ts", "event_id"], 7, "average", "average").select("event_id", "average"))


@query(f"WITH {CLOUD}, d AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS k, count(*) OVER () AS n FROM p), i AS (SELECT unnest(range(100)) AS i) SELECT i AS pid, x, y, z, scalar FROM i JOIN d ON k = (i * n) // 100")
def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.subsample(cloud(embedded(spark, sf_dir).drop("surface")), 100).points


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1")
def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.largest_group(table(spark, sf_dir, "events"), "event_type")


@query("SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_nationkey, s_acctbal, s_suppkey) - 1 AS place FROM supplier")
def sort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sharing import numbered

    return numbered(table(spark, sf_dir, "supplier"), "place", "s_nationkey", "s_acctbal", "s_suppkey").select(F.col("s_suppkey").alias("key"), "place")


@query(f"WITH {CLOUD}, n AS (SELECT count(*) // 200 AS step FROM p) SELECT pid FROM p, n WHERE pid % step = 0 AND pid < step * 200")
def landmark_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.stride(embedded(spark, sf_dir), 200).select("pid")


# Moments


@query(f"WITH {CLOUD} SELECT surface, count(*) AS n, {r6('avg(x) AS cx', 'avg(y) AS cy', 'avg(z) AS cz', 'var_pop(x) AS cov_xx', 'covar_pop(x, y) AS cov_xy', 'covar_pop(x, z) AS cov_xz', 'var_pop(y) AS cov_yy', 'covar_pop(y, z) AS cov_yz', 'var_pop(z) AS cov_zz')} FROM p GROUP BY surface")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.covariance(embedded(spark, sf_dir), ["surface"]))


@query(f"WITH {CLOUD} SELECT count(*) AS n, {r6('avg(x) AS cx', 'avg(y) AS cy', 'avg(z) AS cz', 'var_pop(x) AS cov_xx', 'covar_pop(x, y) AS cov_xy', 'covar_pop(x, z) AS cov_xz', 'var_pop(y) AS cov_yy', 'covar_pop(y, z) AS cov_yz', 'var_pop(z) AS cov_zz')} FROM p")
def merged_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.merged_covariance(measure.covariance(embedded(spark, sf_dir), ["surface"]), []))


@query(f"WITH {CLOUD}, c AS (SELECT surface, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY surface), d AS (SELECT surface, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS d FROM p JOIN c USING (surface)) SELECT surface, {r6('avg(d) AS mean', 'stddev_pop(d) AS sdev')} FROM d GROUP BY surface")
def center_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.center_distance(embedded(spark, sf_dir), ["surface"]))


@query(f"WITH {CLOUD} SELECT surface, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, {r6('(max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) AS volume', 'sqrt((max(x)-min(x))**2+(max(y)-min(y))**2+(max(z)-min(z))**2) AS diagonal')} FROM p GROUP BY surface")
def bounds_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.bounds(embedded(spark, sf_dir), ["surface"]), "volume", "diagonal")


@query(f"WITH {CLOUD}, {MOVED}, u AS (SELECT x, y, z FROM p UNION ALL SELECT x, y, z FROM q) SELECT least(min(x), 0) AS min_x, greatest(max(x), 0) AS max_x, least(min(y), 0) AS min_y, greatest(max(y), 0) AS max_y, least(min(z), 0) AS min_z, greatest(max(z), 0) AS max_z FROM u")
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.scene_bounds([embedded(spark, sf_dir), embedded(spark, sf_dir, 3)])


@query("""WITH b AS (SELECT label AS surface, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS p, [embedding[4]::DOUBLE - embedding[1], embedding[5]::DOUBLE - embedding[2], embedding[6]::DOUBLE - embedding[3]] AS d FROM embeddings),
u AS (SELECT surface, p[1] AS px, p[2] AS py, p[3] AS pz, d[1] / sqrt(list_dot_product(d, d)) AS a, d[2] / sqrt(list_dot_product(d, d)) AS b, d[3] / sqrt(list_dot_product(d, d)) AS c FROM b),
s AS (SELECT surface, sum(1 - a * a) AS xx, sum(-a * b) AS xy, sum(-a * c) AS xz, sum(1 - b * b) AS yy, sum(-b * c) AS yz, sum(1 - c * c) AS zz, sum(px - a * (px * a + py * b + pz * c)) AS rx, sum(py - b * (px * a + py * b + pz * c)) AS ry, sum(pz - c * (px * a + py * b + pz * c)) AS rz FROM u GROUP BY surface),
e AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM s)
SELECT surface, round((rx * (yy * zz - yz * yz) - xy * (ry * zz - yz * rz) + xz * (ry * yz - yy * rz)) / det, 6) + 0.0 AS x, round((xx * (ry * zz - rz * yz) - rx * (xy * zz - yz * xz) + xz * (xy * rz - ry * xz)) / det, 6) + 0.0 AS y, round((xx * (yy * rz - yz * ry) - xy * (xy * rz - ry * xz) + rx * (xy * yz - yy * xz)) / det, 6) + 0.0 AS z FROM e""")
def line_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = embedded(spark, sf_dir), embedded(spark, sf_dir, 3)
    lines = a.select("surface", "pid", *(F.col(c).alias("p" + c) for c in XYZ)).join(b.select("pid", *(F.col(c).alias("q" + c) for c in XYZ)), "pid")
    return rounded(measure.line_intersection(lines, ["surface"]))


@query()
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, values, axes = measure.pca(embedded(spark, sf_dir))
    rows = [(i, *map(float, (mean[i], values[i], *axes[:, i]))) for i in range(3)]
    return spark.createDataFrame(rows, "axis int, mean double, eigenvalue double, x double, y double, z double")


@query()
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = measure.fit_plane(embedded(spark, sf_dir))
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(corners)], "corner int, x double, y double, z double")


# Joins in space


@query(f"WITH {CLOUD} SELECT a.pid, round(count(*) / (4.0 / 3.0 * pi() * {RADIUS} ** 3), 6) AS density FROM p a JOIN p b ON {D2} <= {RADIUS * RADIUS} GROUP BY a.pid")
def radius_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.local_density(embedded(spark, sf_dir), RADIUS))


@query(f"WITH {CLOUD} SELECT a.pid, round(avg(b.scalar), 6) AS scalar FROM p a JOIN p b ON {D2} <= {RADIUS * RADIUS} GROUP BY a.pid")
def scalar_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.smooth_scalar(embedded(spark, sf_dir), RADIUS).select("pid", "scalar"))


@query(f"WITH {CLOUD}, r AS (SELECT a.pid AS id, b.pid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM p a, p b) SELECT id, rank::INT AS rank, other, round(d2, 6) + 0.0 AS d2 FROM r WHERE rank <= 5")
def knn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    return rounded(spatial.knn(p, p, 5))


@query(f"WITH {CLOUD}, {MOVED}, r AS (SELECT a.pid AS id, b.pid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM q a, p b) SELECT id, other, round(d2, 6) + 0.0 AS d2 FROM r WHERE rank = 1")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest(embedded(spark, sf_dir, 3), embedded(spark, sf_dir)))


@query(f"""WITH {CLOUD}, r AS (SELECT a.pid, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS k FROM p a, p b), s AS (SELECT list_sort(list(sqrt(d2))) AS v, count(*) AS n, min(sqrt(d2)) AS lo, max(sqrt(d2)) AS hi, avg(sqrt(d2)) AS mean, stddev_pop(sqrt(d2)) AS sdev FROM r WHERE k = 2 AND d2 > 0)
SELECT n, {r6('lo AS min', 'hi AS max', 'mean', 'sdev', 'v[1 + floor(n * 0.5)::INT] AS median', 'v[1 + floor(n * 0.05)::INT] AS p05', 'v[1 + floor(n * 0.95)::INT] AS p95')} FROM s""")
def nn_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.nn_statistics(embedded(spark, sf_dir)))


@query(f"WITH {CLOUD}, {MOVED} SELECT pid, CASE WHEN EXISTS (SELECT 1 FROM q b WHERE {D2} <= {RADIUS * RADIUS}) THEN 1.0 ELSE 0.0 END AS scalar FROM p a")
def mark_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mark_covered(embedded(spark, sf_dir), embedded(spark, sf_dir, 3), RADIUS).select("pid", "scalar")


@query(f"WITH {CLOUD} SELECT pid, CASE WHEN x*x+y*y+z*z <= 0.04 THEN 7.0 ELSE scalar END AS scalar FROM p")
def mark_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mark_sphere(embedded(spark, sf_dir), (0, 0, 0), 0.2, 7.0).select("pid", "scalar")


@query(f"""WITH {CLOUD}, {MOVED}, r AS (SELECT a.pid AS id, b.pid AS old, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS k FROM q a JOIN p b ON {D2} <= {RADIUS * RADIUS}), f AS (SELECT old, min(id) AS first FROM r WHERE k = 1 GROUP BY old)
SELECT row_number() OVER (ORDER BY first, old) - 1 AS pid, x, y, z, scalar FROM f JOIN p ON p.pid = f.old""")
def closest_points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.closest_points_within(strip_mesh(spark, sf_dir), embedded(spark, sf_dir, 3), RADIUS).points


@query(f"WITH {CLOUD} SELECT pid, round(abs(x + 2 * y - z - 0.1) / sqrt(6), 6) AS distance FROM p ORDER BY abs(x + 2 * y - z - 0.1), pid LIMIT 1")
def nearest_to_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest_to_plane(embedded(spark, sf_dir), (0.1, 0, 0), (1, 2, -1)))


def _segment(a: str, b: str) -> str:
    """Squared distance from q to a side, in SQL."""
    names = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}
    d = [f"({q}-{p})" for p, q in zip(names[a], names[b], strict=True)]
    w = [f"(q.{x}-{p})" for x, p in zip(XYZ, names[a], strict=True)]
    t = f"least(greatest(({'+'.join(f'{i}*{j}' for i, j in zip(w, d, strict=True))}) / ({'+'.join(f'{i}*{i}' for i in d)}), 0), 1)"
    return "(" + "+".join(f"({i}-{t}*{j})**2" for i, j in zip(w, d, strict=True)) + ")"


@query(f"""WITH {CLOUD}, {MOVED}, {TRI}, n AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM t),
w AS (SELECT q.pid, cid, nx, ny, nz, (q.x-ax)*nx+(q.y-ay)*ny+(q.z-az)*nz AS off,
((by_-q.y)*(cz-q.z)-(bz-q.z)*(cy-q.y))*nx+((bz-q.z)*(cx-q.x)-(bx-q.x)*(cz-q.z))*ny+((bx-q.x)*(cy-q.y)-(by_-q.y)*(cx-q.x))*nz AS ra,
((cy-q.y)*(az-q.z)-(cz-q.z)*(ay-q.y))*nx+((cz-q.z)*(ax-q.x)-(cx-q.x)*(az-q.z))*ny+((cx-q.x)*(ay-q.y)-(cy-q.y)*(ax-q.x))*nz AS rb,
((ay-q.y)*(bz-q.z)-(az-q.z)*(by_-q.y))*nx+((az-q.z)*(bx-q.x)-(ax-q.x)*(bz-q.z))*ny+((ax-q.x)*(by_-q.y)-(ay-q.y)*(bx-q.x))*nz AS rc,
least({_segment('a', 'b')}, {_segment('b', 'c')}, {_segment('c', 'a')}) AS side FROM q, n)
SELECT pid, round(sqrt(min(CASE WHEN ra >= 0 AND rb >= 0 AND rc >= 0 THEN off * off / (nx*nx+ny*ny+nz*nz) ELSE side END)), 6) AS distance FROM w GROUP BY pid""")
def compare_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.compare(cloud(embedded(spark, sf_dir, 3)), strip_mesh(spark, sf_dir), signed=False))


def _along(a: str, b: str) -> str:
    """Where on a side the closest place to q is, from 0 to 1, in SQL."""
    names = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}
    d = [f"({q}-{p})" for p, q in zip(names[a], names[b], strict=True)]
    w = [f"(q.{x}-{p})" for x, p in zip(XYZ, names[a], strict=True)]
    return f"least(greatest(({'+'.join(f'{i}*{j}' for i, j in zip(w, d, strict=True))}) / ({'+'.join(f'{i}*{i}' for i in d)}), 0), 1)"


#: The closest place of each point q on the triangles: best (pid, qx .. qz, a, b, c, wa, wb, wc, x, y, z, d2).
PLACES = f"""n AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM t),
w AS (SELECT q.pid, q.x AS qx, q.y AS qy, q.z AS qz, n.*,
((by_-q.y)*(cz-q.z)-(bz-q.z)*(cy-q.y))*nx+((bz-q.z)*(cx-q.x)-(bx-q.x)*(cz-q.z))*ny+((bx-q.x)*(cy-q.y)-(by_-q.y)*(cx-q.x))*nz AS ra,
((cy-q.y)*(az-q.z)-(cz-q.z)*(ay-q.y))*nx+((cz-q.z)*(ax-q.x)-(cx-q.x)*(az-q.z))*ny+((cx-q.x)*(ay-q.y)-(cy-q.y)*(ax-q.x))*nz AS rb,
((ay-q.y)*(bz-q.z)-(az-q.z)*(by_-q.y))*nx+((az-q.z)*(bx-q.x)-(ax-q.x)*(bz-q.z))*ny+((ax-q.x)*(by_-q.y)-(ay-q.y)*(bx-q.x))*nz AS rc,
{_along('a', 'b')} AS tab, {_along('b', 'c')} AS tbc, {_along('c', 'a')} AS tca FROM q, n),
k AS (SELECT w.*, unnest([1, 2, 3, 4]) AS way FROM w),
v AS (SELECT *, CASE way WHEN 1 THEN 1 - tab WHEN 2 THEN 0 WHEN 3 THEN tca ELSE ra / (ra + rb + rc) END AS wa, CASE way WHEN 1 THEN tab WHEN 2 THEN 1 - tbc WHEN 3 THEN 0 ELSE rb / (ra + rb + rc) END AS wb,
CASE way WHEN 1 THEN 0 WHEN 2 THEN tbc WHEN 3 THEN 1 - tca ELSE rc / (ra + rb + rc) END AS wc FROM k WHERE way < 4 OR (ra >= 0 AND rb >= 0 AND rc >= 0)),
o AS (SELECT *, wa*ax+wb*bx+wc*cx AS x, wa*ay+wb*by_+wc*cy AS y, wa*az+wb*bz+wc*cz AS z FROM v),
best AS MATERIALIZED (SELECT * FROM (SELECT *, (x-qx)*(x-qx)+(y-qy)*(y-qy)+(z-qz)*(z-qz) AS d2, row_number() OVER (PARTITION BY pid ORDER BY (x-qx)*(x-qx)+(y-qy)*(y-qy)+(z-qz)*(z-qz), cid, way) AS rank FROM o) WHERE rank = 1)"""
#: Unit vertex normals of the triangles, and from them the signed distances.
SIGNED = """u AS (SELECT unnest([a, b, c]) AS pid, nx / sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny / sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz / sqrt(nx*nx+ny*ny+nz*nz) AS nz FROM n),
vs AS (SELECT pid, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM u GROUP BY pid), vn AS MATERIALIZED (SELECT pid, sx / sqrt(sx*sx+sy*sy+sz*sz) AS nx, sy / sqrt(sx*sx+sy*sy+sz*sz) AS ny, sz / sqrt(sx*sx+sy*sy+sz*sz) AS nz FROM vs),
sd AS (SELECT best.*, CASE WHEN (wa*va.nx+wb*vb.nx+wc*vc.nx)*(qx-best.x)+(wa*va.ny+wb*vb.ny+wc*vc.ny)*(qy-best.y)+(wa*va.nz+wb*vb.nz+wc*vc.nz)*(qz-best.z) < 0 THEN -1 ELSE 1 END * sqrt(d2) AS distance
FROM best JOIN vn va ON va.pid = a JOIN vn vb ON vb.pid = b JOIN vn vc ON vc.pid = c)"""


@query(f"WITH {CLOUD}, {MOVED}, {TRI}, {PLACES}, {SIGNED} SELECT pid, round(distance, 6) AS distance FROM sd")
def compare_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.compare(cloud(embedded(spark, sf_dir, 3)), strip_mesh(spark, sf_dir)))


@query(f"""WITH {CLOUD}, {MOVED}, {TRI}, {PLACES}, {SIGNED}, g AS (SELECT a AS u, b AS v FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t), r AS (SELECT u, v FROM g GROUP BY u, v HAVING count(*) = 1),
h AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM r JOIN p a ON a.pid = u JOIN p b ON b.pid = v)
SELECT pid, round(distance, 6) AS distance FROM sd q WHERE NOT EXISTS (SELECT 1 FROM h WHERE {_segment('a', 'b')} < 1e-9)""")
def compare_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.compare_inside(cloud(embedded(spark, sf_dir, 3)), strip_mesh(spark, sf_dir)))


@query(f"WITH {CLOUD}, {MOVED}, {TRI}, {PLACES} SELECT pid, {r6('x - qx AS x', 'y - qy AS y', 'z - qz AS z')} FROM best")
def project_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.project_surface(cloud(embedded(spark, sf_dir, 3)), strip_mesh(spark, sf_dir))[1])


@query("SELECT a.vec_id::INT AS lm_pos, a.label AS id FROM embeddings a WHERE a.label % 2 = 1 AND a.label % 3 <> 0")
def landmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir).select(F.col("pid").cast("int").alias("lm_pos"), F.col("surface").alias("id"), *XYZ)
    return spatial.landmark_overlap(rows.withColumn("active", F.col("id") % 2), rows.withColumn("active", F.col("id") % 3)).select("lm_pos", "id")


# Projections


@query(f"WITH {CLOUD}, m AS (SELECT pid, x, y, z, (x - 0.1) / sqrt(3) + y / sqrt(3) + z / sqrt(3) AS d FROM p) SELECT pid, {r6('x - 2 * d / sqrt(3) AS x', 'y - 2 * d / sqrt(3) AS y', 'z - 2 * d / sqrt(3) AS z')} FROM m")
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.mirror(cloud(embedded(spark, sf_dir)), (0.1, 0, 0), (1, 1, 1)).points.select("pid", *XYZ))


@query(f"WITH {CLOUD} SELECT pid, -x + 0.0 AS x, y, z FROM p")
def flip_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.flip_x(cloud(embedded(spark, sf_dir))).points.select("pid", (F.col("x") + 0.0).alias("x"), "y", "z")


@query(f"WITH {CLOUD}, n AS (SELECT pid, 1 - x AS a, 2 - y AS b, 3 - z AS c FROM p) SELECT pid, {r6('a / sqrt(a*a+b*b+c*c) AS nx', 'b / sqrt(a*a+b*b+c*c) AS ny', 'c / sqrt(a*a+b*b+c*c) AS nz')} FROM n")
def normals_from_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.normals_from_point(cloud(embedded(spark, sf_dir)), (1, 2, 3)).points.select("pid", "nx", "ny", "nz"))


@query(f"WITH {CLOUD}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, 2 / greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM p) SELECT pid, {r6('s * (x - cx) AS x', 's * (y - cy) AS y', 's * (z - cz) AS z')} FROM p, c")
def normalise_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.normalise_size(cloud(embedded(spark, sf_dir)), 2.0)[0].points.select("pid", *XYZ))


@query(f"WITH {CLOUD}, {MOVED} SELECT p.pid, {r6('p.x + 0.5 * q.x AS x', 'p.y + 0.5 * q.y AS y', 'p.z + 0.5 * q.z AS z')} FROM p JOIN q USING (pid)")
def animate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.animate(cloud(embedded(spark, sf_dir)), embedded(spark, sf_dir, 3), 0.5).points.select("pid", *XYZ))


@query(f"WITH {CLOUD} SELECT pid, {r6('2 * x - y + 5 AS x', 'x + 3 * z - 1 AS y', 'y + z AS z')} FROM p")
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.apply_transform(cloud(embedded(spark, sf_dir)), (2, -1, 0, 5, 1, 0, 3, -1, 0, 1, 1, 0, 0, 0, 0, 1)).points.select("pid", *XYZ))


@query(f"WITH {CLOUD}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p) SELECT pid, {r6('x - cx AS x', 'y - cy AS y', 'z - cz AS z')} FROM p, c")
def to_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.to_origin(cloud(embedded(spark, sf_dir))).points.select("pid", *XYZ))


@query("""WITH b AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS ox, embedding[2]::DOUBLE AS oy, embedding[3]::DOUBLE AS oz, embedding[4]::DOUBLE - embedding[1] AS a1, embedding[5]::DOUBLE - embedding[2] AS a2, embedding[6]::DOUBLE - embedding[3] AS a3, embedding[7]::DOUBLE - embedding[1] AS b1, embedding[8]::DOUBLE - embedding[2] AS b2, embedding[9]::DOUBLE - embedding[3] AS b3 FROM embeddings),
n AS (SELECT *, a2 * b3 - a3 * b2 AS nx, a3 * b1 - a1 * b3 AS ny, a1 * b2 - a2 * b1 AS nz FROM b), d AS (SELECT *, -(nx * ox + ny * oy + nz * oz) AS d FROM n), s AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz + d*d) AS s FROM d)
SELECT pid, round(nx / s, 6) + 0.0 AS a, round(ny / s, 6) + 0.0 AS b, round(nz / s, 6) + 0.0 AS c, round(d / s, 6) + 0.0 AS d, round((sqrt(a1*a1+a2*a2+a3*a3) + sqrt(b1*b1+b2*b2+b3*b3)) / 2, 6) AS side FROM s""")
def plane_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    corner = [tuple(F.get("embedding", F.lit(3 * k + i)).cast("double") for i in range(3)) for k in range(3)]
    return rounded(e.select(F.col("vec_id").alias("pid"), *(v.alias(n) for v, n in zip(project.plane_parameters(*corner), ("a", "b", "c", "d", "side"), strict=True))))


@query(f"""WITH {CLOUD}, s AS (SELECT surface, pid, x, y, z, lead(x) OVER w AS ex, lead(y) OVER w AS ey, lead(z) OVER w AS ez FROM p WINDOW w AS (PARTITION BY surface ORDER BY pid)),
l AS (SELECT *, sqrt((ex-x)**2+(ey-y)**2+(ez-z)**2) AS len FROM s WHERE ex IS NOT NULL), b AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY surface ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT surface, pid AS seg, {r6('(2 - before) / len AS t', 'x + (2 - before) / len * (ex - x) AS x', 'y + (2 - before) / len * (ey - y) AS y', 'z + (2 - before) / len * (ez - z) AS z')} FROM b WHERE before <= 2 AND 2 < before + len""")
def polyline_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.walk(embedded(spark, sf_dir).withColumnRenamed("pid", "ord"), ["surface"], 2.0))


@query(f"""WITH {CLOUD}, s AS (SELECT surface, pid, x, y, z, lead(x) OVER w AS ex, lead(y) OVER w AS ey, lead(z) OVER w AS ez FROM p WINDOW w AS (PARTITION BY surface ORDER BY pid)),
t AS (SELECT *, (x + y + z) / ((x + y + z) - (ex + ey + ez)) AS t FROM s WHERE ex IS NOT NULL AND (x + y + z) <> (ex + ey + ez)), f AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY pid) AS k FROM t WHERE t BETWEEN 0 AND 1)
SELECT surface, pid AS seg, {r6('t', 'x + t * (ex - x) AS x', 'y + t * (ey - y) AS y', 'z + t * (ez - z) AS z')} FROM f WHERE k = 1""")
def plane_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(project.plane_crossing(embedded(spark, sf_dir).withColumnRenamed("pid", "ord"), ["surface"], (0, 0, 0), (1, 1, 1)))


@query(f"""WITH {CLOUD}, s AS (SELECT surface, x, y, z, lead(x) OVER w AS ex, lead(y) OVER w AS ey, lead(z) OVER w AS ez FROM p WINDOW w AS (PARTITION BY surface ORDER BY pid)), c AS (SELECT surface, sum(y*ez-z*ey) AS a, sum(z*ex-x*ez) AS b, sum(x*ey-y*ex) AS c FROM s WHERE ex IS NOT NULL GROUP BY surface)
SELECT surface, round(0.5 * sqrt(a*a+b*b+c*c), 6) AS area FROM c""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.polygon_area(embedded(spark, sf_dir).withColumnRenamed("pid", "ord"), ["surface"]))


@query(f"WITH {CLOUD} SELECT pid, (pid % 7)::BIGINT AS ix, ((pid // 7) % 5)::BIGINT AS iy, (pid // 35)::BIGINT AS iz, pid AS back FROM p")
def grid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix, iy, iz = project.grid_xyz(F.col("pid"), 7, 5)
    return embedded(spark, sf_dir).select("pid", ix.alias("ix"), iy.alias("iy"), iz.alias("iz"), project.grid_id(ix, iy, iz, 7, 5).alias("back"))


# Filters and sets


@query(f"WITH {CLOUD} SELECT pid, scalar FROM p WHERE scalar > 2 AND scalar <= 6")
def scalar_threshold_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.threshold_points(embedded(spark, sf_dir), 2, 6).select("pid", "scalar")


@query(f"WITH {CLOUD} SELECT pid FROM p WHERE (x - 0.05) + 2 * y - z > 0")
def plane_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.cut_points(embedded(spark, sf_dir), (0.05, 0, 0), (1, 2, -1)).select("pid")


@query(f"""WITH {CLOUD}, b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM p)
SELECT pid, CASE WHEN surface % 2 = 0 AND (abs(x-a) < 0.05 OR abs(x-b) < 0.05 OR abs(y-c) < 0.05 OR abs(y-d) < 0.05 OR abs(z-e) < 0.05 OR abs(z-f) < 0.05) THEN 2.0 ELSE (surface % 2)::DOUBLE END AS scalar FROM p, b""")
def crop_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir).withColumn("scalar", (F.col("surface") % 2).cast("double"))
    return clip.crop_seeds(p, 0.05).select("pid", "scalar")


@query(f"WITH {CLOUD}, {MOVED}, u AS (SELECT 0 AS s, pid, x, y, z FROM p UNION ALL SELECT 1, pid, x, y, z FROM q) SELECT row_number() OVER (ORDER BY s, pid) - 1 AS pid, x, y, z FROM u")
def merge_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.merge(cloud(embedded(spark, sf_dir)), cloud(embedded(spark, sf_dir, 3))).points


@query(f"WITH {CLOUD} SELECT row_number() OVER (ORDER BY surface % 3, pid) - 1 AS pid, x, y, z, scalar FROM p")
def merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    return sets.merge_all([cloud(p.where(F.col("surface") % 3 == k)) for k in range(3)]).points


@query(f"WITH {CLOUD} SELECT pid FROM p WHERE x > -0.1 AND y < 0.1")
def bounding_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).where(clip.inside_planes(g.vector(*XYZ), [((-0.1, 0, 0), (1, 0, 0)), ((0, 0.1, 0), (0, -1, 0))])).select("pid")


# Meshes


@query(f"WITH {CLOUD}, {TRI} SELECT round(sum(0.5 * sqrt(((by_-ay)*(cz-az)-(bz-az)*(cy-ay))**2+((bz-az)*(cx-ax)-(bx-ax)*(cz-az))**2+((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))**2)), 6) AS area FROM t")
def mesh_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.surface_area(strip_mesh(spark, sf_dir)))


EDGES = "e AS (SELECT cid, a AS u, b AS v FROM t UNION ALL SELECT cid, b, c FROM t UNION ALL SELECT cid, a, c FROM t)"


@query(f"WITH {CLOUD}, {TRI}, {EDGES}, d AS (SELECT DISTINCT u, v FROM e), l AS (SELECT {D2} AS d2 FROM d JOIN p a ON a.pid = u JOIN p b ON b.pid = v) SELECT count(*) AS edges, round(avg(sqrt(d2)), 6) AS mean, round(stddev_pop(sqrt(d2)), 6) AS sdev FROM l")
def edge_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.edge_regularity(strip_mesh(spark, sf_dir)))


@query(f"""WITH {CLOUD}, {TRI}, s AS (SELECT cid, sqrt((bx-cx)**2+(by_-cy)**2+(bz-cz)**2) AS la, sqrt((cx-ax)**2+(cy-ay)**2+(cz-az)**2) AS lb, sqrt((ax-bx)**2+(ay-by_)**2+(az-bz)**2) AS lc FROM t)
SELECT cid, round(least(degrees(acos((lb*lb+lc*lc-la*la)/(2*lb*lc))), degrees(acos((lc*lc+la*la-lb*lb)/(2*lc*la))), degrees(acos((la*la+lb*lb-lc*lc)/(2*la*lb)))), 4) AS angle FROM s""")
def min_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.minimum_angles(strip_mesh(spark, sf_dir)).select("cid", "angle"), digits=4)


@query(f"WITH {CLOUD}, {TRI}, {EDGES}, n AS (SELECT u, v, count(*) AS n FROM e GROUP BY u, v) SELECT u AS a, v AS b, CASE WHEN n = 1 THEN 'boundary' WHEN n > 2 THEN 'nonmanifold' ELSE 'manifold' END AS type FROM n")
def feature_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.feature_edges(strip_mesh(spark, sf_dir), True, True, True)


def _fins(spark: SparkSession, sf_dir: str) -> Mesh:
    """The mesh with each triangle whose first point has scalar 0 there once more, turned, so that its edges have more than two cells."""
    m = strip_mesh(spark, sf_dir)
    top = m.cells.agg((F.max("cid") + 1).alias("top"))
    first = m.points.where("scalar = 0").select(F.col("pid").alias("cid"))
    fins = m.cells.join(first, "cid", "left_semi").join(F.broadcast(top)).select((F.col("cid") + F.col("top")).alias("cid"), "kind", F.array(F.get("pids", F.lit(1)), F.get("pids", F.lit(2)), F.get("pids", F.lit(0))).alias("pids"))
    return Mesh(m.points, m.cells.unionByName(fins))


@query(f"""WITH {CLOUD}, {TRI}, x AS (SELECT max(cid) + 1 AS top FROM t), t2 AS (SELECT cid, a, b, c FROM t UNION ALL SELECT cid + top, b, c, a FROM x, t JOIN p ON p.pid = t.cid WHERE scalar = 0),
e AS (SELECT cid, least(a, b) AS u, greatest(a, b) AS v FROM t2 UNION ALL SELECT cid, least(b, c), greatest(b, c) FROM t2 UNION ALL SELECT cid, least(a, c), greatest(a, c) FROM t2), n AS (SELECT u, v FROM e GROUP BY u, v HAVING count(*) > 2)
SELECT cid FROM t2 WHERE cid NOT IN (SELECT e.cid FROM e JOIN n ON e.u = n.u AND e.v = n.v)""")
def remove_non_manifold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.remove_non_manifold(_fins(spark, sf_dir)).cells.select("cid")


@query(f"WITH {CLOUD}, {TRI}, x AS (SELECT max(cid) + 1 AS top FROM t) SELECT cid AS i, cid + top AS j FROM x, t JOIN p ON p.pid = t.cid WHERE scalar = 0 UNION ALL SELECT cid + top, cid FROM x, t JOIN p ON p.pid = t.cid WHERE scalar = 0")
def contained_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.contained_pairs(_fins(spark, sf_dir))


@query(f"WITH {CLOUD}, {TRI}, k AS (SELECT a, b, c FROM t JOIN p ON p.pid = t.a WHERE scalar >= 5), u AS (SELECT a AS pid FROM k UNION SELECT b FROM k UNION SELECT c FROM k) SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, x, y, z, scalar FROM u JOIN p USING (pid)")
def compact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = strip_mesh(spark, sf_dir)
    first = m.points.where("scalar >= 5").select("pid")
    cells = m.cells.withColumn("pid", F.get("pids", F.lit(0))).join(first, "pid", "left_semi").drop("pid")
    return clip.compact(Mesh(m.points, cells)).points


@query(f"WITH {CLOUD}, {TRI} SELECT (SELECT count(*) FROM p) AS points, 0::BIGINT AS verts, 0::BIGINT AS lines, count(*) AS polys, 0::BIGINT AS strips FROM t")
def poly_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.poly_info(strip_mesh(spark, sf_dir))


@query(f"""WITH {CLOUD}, {TRI}, n AS (SELECT a, b, c, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS i, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS j, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS k FROM t), v AS (SELECT unnest([a, b, c]) AS pid, i / sqrt(i*i+j*j+k*k) AS i, j / sqrt(i*i+j*j+k*k) AS j, k / sqrt(i*i+j*j+k*k) AS k FROM n),
s AS (SELECT pid, sum(i) AS i, sum(j) AS j, sum(k) AS k FROM v GROUP BY pid) SELECT pid, round(i / sqrt(i*i+j*j+k*k), 5) + 0.0 AS nx, round(j / sqrt(i*i+j*j+k*k), 5) + 0.0 AS ny, round(k / sqrt(i*i+j*j+k*k), 5) + 0.0 AS nz FROM s""")
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.vertex_normals(strip_mesh(spark, sf_dir)).points.select("pid", "nx", "ny", "nz"), digits=5)


#: Edges of the mesh numbered as new points: k (u, v, w1, w2, n, pid), in the order of their ends.
MIDDLES = """f AS (SELECT least(a, b) AS u, greatest(a, b) AS v, c AS w FROM t UNION ALL SELECT least(b, c), greatest(b, c), a FROM t UNION ALL SELECT least(a, c), greatest(a, c), b FROM t),
g AS (SELECT u, v, min(w) AS w1, max(w) AS w2, count(*) AS n FROM f GROUP BY u, v),
k AS MATERIALIZED (SELECT *, (SELECT max(pid) FROM p) + row_number() OVER (ORDER BY u, v) AS pid FROM g)"""


@query(f"""WITH {CLOUD}, {TRI}, {MIDDLES} SELECT pid, {r6(*XYZ)} FROM p UNION ALL SELECT k.pid, {r6(*(f"(a.{c} + b.{c}) / 2 AS {c}" for c in XYZ))} FROM k JOIN p a ON a.pid = u JOIN p b ON b.pid = v""")
def subdivide_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.subdivide(strip_mesh(spark, sf_dir)).points.select("pid", *XYZ))


@query(f"""WITH {CLOUD}, {TRI}, {MIDDLES}, o AS (SELECT u AS pid, v AS o, n FROM k UNION ALL SELECT v, u, n FROM k),
r AS (SELECT o.pid, count(*) AS n, count(*) FILTER (o.n = 1) AS nb, {", ".join(f"sum(q.{c}) AS s{c}, coalesce(sum(q.{c}) FILTER (o.n = 1), 0) AS rim{c}" for c in XYZ)} FROM o JOIN p q ON q.pid = o.o GROUP BY o.pid),
h AS (SELECT *, (0.625 - (0.375 + cos(2 * pi() / n) / 4) ** 2) / n AS beta FROM r)
SELECT p.pid, {r6(*(f"CASE WHEN n IS NULL THEN {c} WHEN nb = 2 THEN 0.75 * {c} + rim{c} / 8 WHEN nb > 0 THEN {c} ELSE {c} * (1 - n * beta) + beta * s{c} END AS {c}" for c in XYZ))} FROM p LEFT JOIN h USING (pid)
UNION ALL SELECT k.pid, {r6(*(f"CASE WHEN n = 2 THEN (3 * (a.{c} + b.{c}) + d.{c} + e.{c}) / 8 ELSE (a.{c} + b.{c}) / 2 END AS {c}" for c in XYZ))} FROM k JOIN p a ON a.pid = u JOIN p b ON b.pid = v JOIN p d ON d.pid = w1 JOIN p e ON e.pid = w2""")
def subdivide_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.subdivide(strip_mesh(spark, sf_dir), "loop").points.select("pid", *XYZ))


@query()
def subdivide_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subdivide(strip_mesh(spark, sf_dir), "butterfly").points


@query(f"""WITH {CLOUD}, {TRI}, {EDGES}, d AS (SELECT DISTINCT u, v FROM e), b AS (SELECT u, v FROM d UNION ALL SELECT v, u FROM d), m1 AS (SELECT u AS pid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM b JOIN p ON p.pid = b.v GROUP BY u),
s1 AS (SELECT pid, p.x + 0.1 * (m1.x - p.x) AS x, p.y + 0.1 * (m1.y - p.y) AS y, p.z + 0.1 * (m1.z - p.z) AS z FROM p JOIN m1 USING (pid)), m2 AS (SELECT u AS pid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM b JOIN s1 ON s1.pid = b.v GROUP BY u)
SELECT pid, {r6('s1.x + 0.1 * (m2.x - s1.x) AS x', 's1.y + 0.1 * (m2.y - s1.y) AS y', 's1.z + 0.1 * (m2.z - s1.z) AS z')} FROM s1 JOIN m2 USING (pid)""")
def smooth_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.smooth(strip_mesh(spark, sf_dir), 2, 0.1).points.select("pid", *XYZ))


@query()
def smooth_low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.smooth_taubin(strip_mesh(spark, sf_dir)).points.select("pid", *XYZ)


@query()
def smooth_windowed_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.smooth_sinc(strip_mesh(spark, sf_dir)).points.select("pid", *XYZ)


@query()
def split_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertex_normals(strip_mesh(spark, sf_dir), split=True).points.select("pid", *XYZ, "nx", "ny", "nz")


@query()
def cluster_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_decimate(strip_mesh(spark, sf_dir)).points


@query()
def quadric_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.decimate(strip_mesh(spark, sf_dir), 0.5).points


@query()
def close_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.close_holes(strip_mesh(spark, sf_dir), 10**9).cells


@query(f"""WITH {CLOUD}, {TRI}, {EDGES}, n AS (SELECT pid AS u, pid AS v FROM p JOIN e ON pid = u OR pid = v WHERE z > 0 UNION SELECT u, v FROM e JOIN p a ON a.pid = u JOIN p b ON b.pid = v WHERE (a.z > 0) <> (b.z > 0)),
c AS (SELECT u, v, CASE WHEN u = v THEN 0 ELSE a.z / (a.z - b.z) END AS s, a, b FROM n JOIN p a ON a.pid = u JOIN p b ON b.pid = v)
SELECT row_number() OVER (ORDER BY u, v) - 1 AS pid, {r6(*(f"a.{c} + s * (b.{c} - a.{c}) AS {c}" for c in (*XYZ, "scalar")))} FROM c""")
def plane_cut_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clip.cut_with_plane(strip_mesh(spark, sf_dir), (0, 0, 0), (0, 0, 1)).points.select("pid", *XYZ, "scalar"))


def tetrahedra(spark: SparkSession, sf_dir: str) -> Mesh:
    """A closed tetrahedron over each four consecutive points, with points of its own: corner j of tetrahedron t is point 4 t + j."""
    points = embedded(spark, sf_dir).select("pid", *XYZ)
    ids = points.select("pid")
    for j in (1, 2, 3):
        ids = ids.join(points.select((F.col("pid") - j).alias("pid")), "pid", "left_semi")
    own = ids.select(F.col("pid").alias("t"), F.explode(F.array(*(F.lit(j) for j in range(4)))).alias("j"))
    placed = own.withColumn("pid", F.col("t") + F.col("j")).join(points, "pid").select((4 * F.col("t") + F.col("j")).alias("pid"), *XYZ)
    faces = F.posexplode(F.array(*(F.array(*(4 * F.col("pid") + k for k in f)) for f in ((0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2))))).alias("f", "pids")
    cells = ids.select("pid", faces).select((4 * F.col("pid") + F.col("f")).alias("cid"), F.lit("polys").alias("kind"), "pids")
    return Mesh(placed, cells)


def _crossed(u: int, d: int) -> tuple[str, str]:
    """Where the plane z = 0 cuts the edge between the corners u and d of v, in SQL."""
    s = f"(v[{u}].z / (v[{u}].z - v[{d}].z))"
    return tuple(f"(v[{u}].{c} + {s} * (v[{d}].{c} - v[{u}].{c}))" for c in "xy")


def _shoelace(*corners: tuple[str, str]) -> str:
    terms = (f"{p[0]} * {q[1]} - {q[0]} * {p[1]}" for p, q in zip(corners, (*corners[1:], corners[0]), strict=True))
    return f"abs({' + '.join(terms)}) / 2"


@query(f"""WITH {CLOUD}, c AS (SELECT list_reverse(list_sort([{", ".join("{'z': %s.z, 'x': %s.x, 'y': %s.y}" % (k, k, k) for k in "abcd")}])) AS v FROM p a JOIN p b ON b.pid = a.pid + 1 JOIN p c ON c.pid = a.pid + 2 JOIN p d ON d.pid = a.pid + 3),
n AS (SELECT v, len(list_filter(v, lambda q: q.z > 0)) AS up FROM c)
SELECT round(coalesce(max(CASE up WHEN 1 THEN {_shoelace(_crossed(1, 2), _crossed(1, 3), _crossed(1, 4))} WHEN 3 THEN {_shoelace(_crossed(1, 4), _crossed(2, 4), _crossed(3, 4))}
WHEN 2 THEN {_shoelace(_crossed(1, 3), _crossed(1, 4), _crossed(2, 4), _crossed(2, 3))} END), 0), 6) AS area FROM n WHERE up BETWEEN 1 AND 3""")
def section_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.section_area(tetrahedra(spark, sf_dir), (0, 0, 0), (0, 0, 1)))


_REPORTED = {
    "points": "count(*)", "scalar_min": "min(scalar)", "scalar_max": "max(scalar)", "scalar_mean": "avg(scalar)", "scalar_sdev": "stddev_pop(scalar)", "scalar_rms": "sqrt(avg(scalar * scalar))",
    **{f"{n}_{c}": f"{n}({c})" for c in XYZ for n in ("min", "max")}, "volume": "(max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))",
    **{f"scalar_{n}": f"list_sort(list(scalar))[1 + floor(count(*) * {k})::INT]" for n, k in (("median", 0.5), ("p05", 0.05), ("p95", 0.95))},
}


@query(f"""WITH {CLOUD}, {TRI} SELECT 'arrays' AS section, 'scalar' AS key, 1.0::DOUBLE AS value UNION ALL SELECT 'cells', 'polys', count(*)::DOUBLE FROM t UNION ALL
SELECT 'points', unnest([{", ".join(f"'{k}'" for k in _REPORTED)}]), unnest([{", ".join(f"round(({v})::DOUBLE, 6) + 0.0" for v in _REPORTED.values())}]) FROM p""")
def mesh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measure.mesh_report(strip_mesh(spark, sf_dir)))


# Graphs


REACH = "c AS (SELECT pid AS n, pid AS o FROM p UNION SELECT c.n, l.b FROM c JOIN l ON c.o = l.a)"


@query(f"WITH RECURSIVE {CLOUD}, {LINKS}, {REACH} SELECT n AS node, min(o) AS label FROM c GROUP BY n")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    return graph.components(p.select(F.col("pid").alias("node")), spatial.connecting_links(p, RADIUS))


@query(f"WITH RECURSIVE {CLOUD}, {LINKS}, {REACH}, g AS (SELECT n, min(o) AS label FROM c GROUP BY n) SELECT label, count(*) AS n FROM g GROUP BY label ORDER BY n DESC, label LIMIT 1")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.largest_group(components(spark, sf_dir), "label")


@query(f"""WITH RECURSIVE {CLOUD}, {LINKS}, {REACH}, g AS (SELECT n, min(o) AS label FROM c GROUP BY n), m AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM g JOIN p ON p.pid = g.n GROUP BY label),
d AS (SELECT g.label, avg(sqrt((p.x-m.x)**2+(p.y-m.y)**2+(p.z-m.z)**2)) AS d FROM g JOIN p ON p.pid = g.n JOIN m ON m.label = g.label GROUP BY g.label) SELECT label, round(d, 6) AS mean FROM d ORDER BY d DESC, label LIMIT 1""")
def outer_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = components(spark, sf_dir).select(F.col("node").alias("pid"), "label")
    return rounded(measure.center_distance(embedded(spark, sf_dir).join(of, "pid"), ["label"]).orderBy(F.desc("mean"), "label").limit(1).select("label", "mean"))


@query(f"""WITH RECURSIVE {CLOUD}, {LINKS}, s AS (SELECT * FROM p WHERE pid = (SELECT min(pid) FROM p)), k AS (SELECT p.pid FROM p, s WHERE (p.x-s.x)**2+(p.y-s.y)**2+(p.z-s.z)**2 < 0.25),
f AS (SELECT pid AS o FROM s UNION SELECT l.b FROM f JOIN l ON f.o = l.a WHERE l.b IN (SELECT pid FROM k)) SELECT o AS pid FROM f WHERE o NOT IN (SELECT pid FROM s)""")
def vertex_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    return graph.vertex_neighbours(p, RADIUS, p.agg(F.min("pid")).first()[0], 0.25)


@query(f"""WITH RECURSIVE {CLOUD}, {LINKS}, v AS (SELECT pid, CASE WHEN scalar < 5 THEN 0.0 WHEN scalar < 7 THEN 2.0 ELSE scalar END AS s FROM p), f AS (SELECT pid AS o FROM v WHERE s = 2 UNION SELECT l.b FROM f JOIN l ON f.o = l.a JOIN v ON v.pid = l.b WHERE v.s IN (0, 2))
SELECT pid, CASE WHEN pid IN (SELECT o FROM f) THEN 2.0 ELSE s END AS scalar FROM v""")
def crop_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scalar")
    p = embedded(spark, sf_dir).withColumn("scalar", F.when(s < 5, 0.0).when(s < 7, 2.0).otherwise(s))
    return graph.crop_flood(p, RADIUS).select("pid", "scalar")


@query(f"""WITH RECURSIVE {CLOUD}, {TRI}, {EDGES}, l AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e), c AS (SELECT DISTINCT a AS n, a AS o FROM l UNION SELECT c.n, l.b FROM c JOIN l ON c.o = l.a),
m AS (SELECT n, min(o) AS label FROM c GROUP BY n) SELECT n AS pid, dense_rank() OVER (ORDER BY label) - 1 AS region FROM m""")
def mesh_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.regions(strip_mesh(spark, sf_dir))


@query()
def pca_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pca_normals(embedded(spark, sf_dir), None, 6, 100.0, 10.0)


@query()
def oriented_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    normals = graph.pca_normals(embedded(spark, sf_dir), None, 6, 100.0, 10.0).select("pid", "nx", "ny", "nz")
    p = embedded(spark, sf_dir).join(normals, "pid")
    return graph.vote_orientation(p, graph.cliques(p, 0.5, 30.0)).select("pid", "clique", "nx", "ny", "nz")


@query()
def landmark_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = embedded(spark, sf_dir).join(embedded(spark, sf_dir, 3).select("pid", *(F.col(c).alias("t" + c) for c in XYZ)), "pid")
    rows = [(mode, i, *map(float, row)) for mode in ("rigid", "similarity", "affine") for i, row in enumerate(register.landmark_transform(pairs, mode))]
    return spark.createDataFrame(rows, "mode string, row int, a double, b double, c double, d double")


# Generators


def _stamped(shape: Mesh, at: DataFrame) -> DataFrame:
    """Points of a shape at each of the rows (of, cx, cy, cz, size)."""
    return rounded(generate.stamped(shape, at).points.select("pid", *XYZ))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).select(F.col("pid").alias("of"), *(F.col(c).alias("c" + c) for c in XYZ), (1 + F.col("scalar")).alias("size"))


def _at(shape: str, n: int) -> str:
    """Points s (k, x, y, z) of a shape at each point, in SQL."""
    return f"{shape} SELECT p.pid * {n} + s.k AS pid, {r6(*(f'p.{c} + (1 + scalar) * s.{c} AS {c}' for c in XYZ))} FROM p, s"


@query(_at(f"WITH {CLOUD}, i AS (SELECT unnest(range(0, 96)) AS id), s AS (SELECT id AS k, cos(radians((id % 48) * 7.5)) * 0.5 AS x, CASE WHEN (id // 48) % 2 = 1 THEN 0.5 ELSE -0.5 END AS y, -sin(radians((id % 48) * 7.5)) * 0.5 AS z FROM i)", 96))
def cylinder_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(generate.cylinder(spark, 0.5, 1.0, 48, False), _places(spark, sf_dir))


@query(_at(f"""WITH {CLOUD}, i AS (SELECT unnest(range(0, 80)) AS id), r AS (SELECT id + 2 AS k, radians((id // 10 + 1) * (180.0 / 9)) AS p, radians((id % 10) * 36) AS t FROM i),
s AS (SELECT k, sin(p) * cos(t) AS x, sin(p) * sin(t) AS y, cos(p) AS z FROM r UNION ALL SELECT 0, 0.0, 0.0, 1.0 UNION ALL SELECT 1, 0.0, 0.0, -1.0)""", 82))
def sphere_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(generate.sphere(spark, theta_res=10, phi_res=10), _places(spark, sf_dir))


@query(_at(f"""WITH {CLOUD}, f AS (SELECT * FROM (VALUES (0, ['lbn', 'rbn', 'rbf', 'lbf']), (1, ['ltn', 'ltf', 'rtf', 'rtn']), (2, ['lbn', 'lbf', 'ltf', 'ltn']), (3, ['rbf', 'rbn', 'rtn', 'rtf']), (4, ['lbf', 'rbf', 'rtf', 'ltf']), (5, ['rbn', 'lbn', 'ltn', 'rtn'])) v(face, corners)), c AS (SELECT face, generate_subscripts(corners, 1) - 1 AS k, unnest(corners) AS n FROM f),
s AS (SELECT (4 * face + k)::BIGINT AS k, CASE WHEN n[1] = 'l' THEN -1.0 ELSE 1.0 END + CASE WHEN n[2] = 'b' THEN 0 WHEN n[1] = 'l' THEN tan(radians(30)) ELSE -tan(radians(15)) END AS x, CASE WHEN n[2] = 'b' THEN -0.5 ELSE 0.5 END AS y, CASE WHEN n[3] = 'n' THEN -1.5 ELSE 1.5 END AS z FROM c)""", 24))
def trapezoid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(generate.trapezoid(spark, 2, 1, 3, 60, 75), _places(spark, sf_dir))


# Volumes


@query(f"""WITH {CLOUD}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, least(max(x)-min(x), max(y)-min(y), max(z)-min(z)) / 16 AS s FROM p),
d AS (SELECT *, floor((hx-lx)/s)::INT + 11 AS dx, floor((hy-ly)/s)::INT + 11 AS dy, floor((hz-lz)/s)::INT + 11 AS dz FROM b),
v AS (SELECT i AS vid, lx - 5*s + (i % dx)*s AS x, ly - 5*s + ((i // dx) % dy)*s AS y, lz - 5*s + (i // (dx*dy))*s AS z FROM d, range(0, dx*dy*dz) r(i)),
k AS (SELECT a.vid, list_sort(list(sqrt({D2})))[1:5] AS v FROM v a, p b GROUP BY a.vid) SELECT vid, round(v[3], 6) AS value FROM k""")
def voxel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    return rounded(volume.oriented_distance(volume.grid_by_side(p).voxels(spark), p, "unsigned_median").select("vid", "value"))


@query(f"""WITH {CLOUD}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, least(max(x)-min(x), max(y)-min(y), max(z)-min(z)) / 16 AS s FROM p),
d AS (SELECT *, floor((hx-lx)/s)::INT + 11 AS dx, floor((hy-ly)/s)::INT + 11 AS dy, floor((hz-lz)/s)::INT + 11 AS dz FROM b),
c AS (SELECT DISTINCT floor((x-(lx-5*s))/s+0.5)::INT AS i, floor((y-(ly-5*s))/s+0.5)::INT AS j, floor((z-(lz-5*s))/s+0.5)::INT AS k FROM p, d), o AS (SELECT unnest(range(-2, 3)) AS o)
SELECT DISTINCT ((i+a.o) + (j+b.o)*dx + (k+c2.o)*dx*dy)::BIGINT AS vid FROM c, o a, o b, o c2, d WHERE i+a.o BETWEEN 0 AND dx-1 AND j+b.o BETWEEN 0 AND dy-1 AND k+c2.o BETWEEN 0 AND dz-1""")
def band_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    grid = volume.grid_by_side(p)
    return volume.band(p, grid, 0.5 * grid.spacing[0])


@query()
def mesh_distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = strip_mesh(spark, sf_dir)
    return volume.mesh_distance(volume.grid_by_side(m.points).voxels(spark), m)


@query()
def cloud_isosurface(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    grid = volume.grid_by_side(p)
    field = volume.oriented_distance(grid.voxels(spark), p, "unsigned_median")
    return volume.isosurface(grid.voxels(spark).join(field.select("vid", "value"), "vid"), grid, 0.3).points


# Text


@query("""SELECT page_id, regexp_extract(url, '^(.*)[/\\\\]', 1) AS path, regexp_replace(url, '^.*[/\\\\]', '') AS name, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.[^./\\\\]*$', '') AS stem, lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) AS extension FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.path_of(u).alias("path"), tx.without_path(u).alias("name"), tx.stem(u).alias("stem"), tx.extension(u).alias("extension"))


@query("""SELECT page_id, list_filter(string_split_regex(url, '[/?&=]'), lambda s: s <> '') AS parts, coalesce(try_cast(regexp_extract(regexp_extract(url, '^[^:]*://[^/]*/[^/]*/(.*)$', 1), '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE), 0.0) AS number FROM pages""")
def split_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.split_string(u, "/?&=").alias("parts"), tx.leading_number(F.regexp_extract(u, r"^[^:]*://[^/]*/[^/]*/(.*)$", 1)).alias("number"))


@query("""SELECT doc_id, CASE WHEN starts_with(lower(text), 'the') THEN trim(substr(text, 4)) END AS rest, translate(text, chr(10) || chr(13), '') = text AS one_line FROM documents""")
def token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_rest(t, "the").alias("rest"), (tx.strip_newlines(t) == t).alias("one_line"))


@query("SELECT n_nationkey AS key, printf('%03d : %s', n_nationkey + 1, n_name) AS label FROM nation")
def picker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), tx.picker_name(F.col("n_nationkey") + 1, F.col("n_name")).alias("label"))


@query("SELECT vec_id AS pid, round(((embedding[1]::DOUBLE * 20) % (2 * pi()) + 2 * pi()) % (2 * pi()), 6) + 0.0 AS angle FROM embeddings")
def positive_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedded(spark, sf_dir).select("pid", g.positive_angle(F.col("x") * 20).alias("angle")))


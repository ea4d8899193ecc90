"""Order statistics and moments that behave alike on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sharing import numbered, settled


def rms(x: Column) -> Column:
    """Root mean square, 0 for no values."""
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


def sdev(x: Column) -> Column:
    """Population standard deviation, 0 for no values."""
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation from centred population moments, 0 where a variance is 0."""
    product = F.var_pop(x) * F.var_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.sqrt(product)), F.lit(0.0))


def gaussian(seed: int, mean: float = 0.0, spread: float = 1.0) -> Column:
    """Seeded normal random numbers."""
    return mean + spread * F.randn(seed)


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Non-null values with ``rank`` (0-based) and ``n`` of each group, from counts of equal values.

    Distinct values are dealt by ranges of (group, value), summed within each range, and moved by the sums of the group's ranges
    before: a window holds one range of a group, or one row a range, so a group may have any number of values. ``rank`` is that
    of the first of ``times`` equal values. Null groups are groups.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    rows = settled(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_range").agg(F.sum("times").alias("_s"))
    sums = sums.select(*(F.col(c).alias("_of_" + c) for c in by), F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(group).alias("n"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col("_of_" + c))
    ranked = rows.withColumn("rank", F.coalesce(F.sum("times").over(within), F.lit(0))).join(sums, same)
    return ranked.select(*by, value, "times", (F.col("rank") + F.col("_before")).alias("rank"), "n")


def fractiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """sorted[int(n * f)] of each group for each named fraction, no interpolation; fractions are below 1."""
    if any(not 0 <= f < 1 for f in fractions.values()):
        raise ValueError("a fraction is at least 0 and below 1")
    rows = ranked(df, by, value)
    at = {name: F.floor(F.col("n") * F.lit(f)) for name, f in fractions.items()}
    hit = lambda i: (F.col("rank") <= i) & (i < F.col("rank") + F.col("times"))
    return rows.groupBy(*by).agg(*(F.max(F.when(hit(i), F.col(value))).alias(name) for name, i in at.items()))


def robust_mean_sdev(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """Mean and population standard deviation of the ranks int(n * low) to int(n * high), both included."""
    if not 0 <= low <= high < 1:
        raise ValueError("0 <= low <= high < 1")
    rows = ranked(df, by, value)
    taken = F.least(F.col("rank") + F.col("times") - 1, F.floor(F.col("n") * high)) - F.greatest(F.col("rank"), F.floor(F.col("n") * low)) + 1
    rows = rows.withColumn("_k", taken).where("_k > 0")
    mean = rows.groupBy(*by).agg((F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("_mean")).withColumnsRenamed({c: "_of_" + c for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col("_of_" + c))
    both = rows.join(mean, same)
    return both.groupBy(*by).agg(F.max("_mean").alias("mean"), F.sqrt(F.sum(F.col("_k") * (F.col(value) - F.col("_mean")) ** 2) / F.sum("_k")).alias("sdev"))


#: Rows of a block of a window query, at least so many times the half width.
BLOCK_ROWS, BLOCK_WIDTHS = 100_000, 10


def windowed(df: DataFrame, value: str, by: list[str], order: list[str], size: int, how: str, name: str) -> DataFrame:
    """``df`` with column ``name``: upper ``median`` or ``average`` of a centred frame of half width size // 2, shorter at the ends.

    Rows are numbered by group and order and dealt to blocks of following numbers; the rows near the ends of a block go to its
    neighbour too. So a group of any size is many windows, and each row finds its whole frame in its own block.
    """
    h = size // 2
    block = max(BLOCK_ROWS, BLOCK_WIDTHS * h)
    rows = numbered(df, "_i", *by, *order)
    own = F.floor(F.col("_i") / block)
    ends = F.sequence(F.floor((F.col("_i") - h) / block), F.floor((F.col("_i") + h) / block))
    rows = rows.withColumn("_own", own).withColumn("_block", F.explode(ends))
    frame = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(-h, h)
    if how == "average":
        got = F.avg(value).over(frame)
    else:
        held = F.sort_array(F.collect_list(value).over(frame))
        got = F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))
    return rows.withColumn(name, got).where("_block = _own").drop("_i", "_own", "_block")

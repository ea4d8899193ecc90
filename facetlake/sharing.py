"""Where intermediate tables go and when they are removed, and dense numbers for rows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Settings while a table is written: an execution's shuffle files go when it ends, and Arrow batches are bounded by bytes, so that
#: rows of any length take little memory beside the heap.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


#: Rows after which a page of a written table is measured: rows with long lists would otherwise make pages of many megabytes, and
#: buffers of their size outside the heap.
PAGE_ROWS = 2


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``, read as Spark reads paths.

    Only where that is unset and the master is local (tests), a new temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("facetlake.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="facetlake-")
        spark.conf.set("facetlake.shared.dir", at)
    if "://" not in at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        at = "file://" + at.removeprefix("file:") if at.startswith("file:/") and not at.startswith("file://") else at
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder under the shared one that no other run uses; nothing is created."""
    return f"{shared_dir(spark)}/facetlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    What was shuffled for it is removed once the table is there, as nothing reads it again. The session's settings in ``WRITING``
    are as they were afterwards; threads that share a session should not write at the same time.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("parquet.page.size.row.check.min", PAGE_ROWS).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table._facetlake_folder = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: their successors are written."""
    for table in tables:
        if at := getattr(table, "_facetlake_folder", None):
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """``df`` worked out once, for loops; ``after``, a settled table that only ``df`` read, is removed then."""
    table = written(df, "settled")
    if after is not None:
        removed(after)
    return table


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver has, as a table of constants: no task and no Python worker makes it."""
    kind = ArrayType(StructType.fromDDL(schema))

    def plain(value, kind):
        if isinstance(kind, ArrayType):
            return [plain(v, kind.elementType) for v in value]
        return {f.name: plain(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)} if isinstance(kind, StructType) else value

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plain(rows, kind))), kind)))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with a dense 0-based number by ``order``, without moving all rows to one task.

    Rows are sorted by range, written once with their place in the partition, and numbered by that plus the rows of earlier
    partitions; the offsets are one row a partition. ``order`` should be unique for the numbers to be repeatable. The written table
    goes with ``removed`` of the result.
    """
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).collect()
    start, offsets = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in sizes):
        offsets.append((part, start))
        start += n
    table = small_table(df.sparkSession, offsets, "_part long, _start long")
    number = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
    found = placed.join(F.broadcast(table), "_part").withColumn(name, number).drop("_part", "_at", "_start")
    found._facetlake_folder = rows._facetlake_folder
    return found

"""Line dedup by site-relative frequency.

Method: group by host, divide the pages that contain a line by the host's pages, and drop the lines above a boilerplate ratio.
Only line keys are counted, with partial sums before the shuffle. The boilerplate of all hosts, where it is counted and small, is
sent to the tasks once; beyond that texts' lines meet it by (host, key), so a host's lines are spread however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sharing import written
from .common import held_by_worker, returning, slices

#: Boilerplate lines of all hosts together that may be broadcast; beyond it lines are joined by shuffle.
BROADCAST_LINES = 200_000
#: Ratios measured on licence lines, passages and clean lines (see the README), for lines and for long lines.
RATIO, LONG_RATIO = 0.003, 0.0005
#: Words of a long line: one that hardly stands in two texts by chance.
LONG_WORDS = 20
#: A line that has a word.
WORDED = r"[^\x20\x09-\x0D]"


def _lines(text):
    return F.split(text, "\n")


def _worded(lines):
    return F.filter(lines, lambda x: x.rlike(WORDED))


def _long(line):
    return F.size(F.split(line, r"[\x20\x09-\x0D]+")) >= LONG_WORDS


def boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = 3, long_ratio: float | None = None, copies: bool = True) -> DataFrame:
    """(site, key): MD5 digests of each site's boilerplate lines.

    Lines of ``LONG_WORDS`` words or more are held against ``long_ratio`` where it is given.

    A line counts once a row, wherever it stands in the text; lines without a word never count. Null sites form one site of
    their own (its ``site`` is null). Rows count as pages, so repeated rows count each time; without ``copies`` the distinct texts
    of a site are its pages, so that a group of copies doesn't make its own text boilerplate.
    """
    rows = df.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    digest = [] if copies else [F.unhex(F.md5("text")).alias("digest")]
    long = _long if long_ratio is not None else lambda x: F.lit(False)
    keys = F.array_distinct(F.transform(_worded(_lines(F.col("text"))), lambda x: F.struct(F.md5(x).alias("key"), long(x).alias("long"))))
    lines = rows.select("site", *digest, F.explode(keys).alias("line")).select("site", *(["digest"] if digest else []), F.unhex("line.key").alias("key"), "line.long")
    if not copies:
        lines, rows = lines.distinct(), rows.select("site", *digest).distinct()
    counts = lines.groupBy("site", "key", "long").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = rows.groupBy("site").agg(F.count("*").alias("total")).withColumnRenamed("site", "of")
    bar = F.when(F.col("long"), ratio if long_ratio is None else long_ratio).otherwise(ratio)
    common = counts.join(totals, F.col("site").eqNullSafe(F.col("of"))).where(F.col("pages") > bar * F.col("total"))
    return common.select("site", "key")


def drop_boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = 3, long_ratio: float | None = None, copies: bool = True) -> DataFrame:
    """All rows and columns of ``df`` with the boilerplate lines taken out of the text, and columns n_lines, n_dropped.

    A line is dropped where it is on more than ``ratio`` of its site's rows (a long one: ``long_ratio``, where that is given) and
    on at least ``least_pages`` of them; without ``copies``, rows with the same text count once a site. Blank lines stay. A text whose lines all go becomes empty; null text stays null and has no lines (n_lines 0). Repeated rows each stay.
    Columns of ``df`` keep their names; n_lines and n_dropped replace columns of these names. An empty table gives an empty one.
    """
    found = written(boilerplate(df, site_col, text_col, ratio, least_pages, long_ratio, copies), "boilerplate")
    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    rows = df.select(*(F.col(f"`{c}`") for c in kept))
    if found.count() <= BROADCAST_LINES:
        return _dropped_by_set(rows, found, site_col, text_col)
    return _dropped_by_join(rows, found, site_col, text_col)


def _dropped_by_set(rows: DataFrame, found: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """Tasks hold all boilerplate, a set a site, and look up the lines of texts."""
    sets: dict[object, set[bytes]] = {}
    for site, key in zip(*(c.to_pylist() for c in found.select("site", "key").toArrow().columns), strict=True):
        sets.setdefault(site, set()).add(key)
    sent = rows.sparkSession.sparkContext.broadcast(sets)
    site_at, text_at = rows.columns.index(site_col), rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker(("line dedup",), lambda: None)  # what another operator kept goes
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for site, text in zip(batch.column(site_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
                bad = sent.value.get(site)
                lines = [] if text is None else text.split("\n")
                rest = [x for x in lines if hashlib.md5(x.encode()).digest() not in bad] if bad else lines
                texts.append(text if len(rest) == len(lines) else "\n".join(rest))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(rest))
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*batch.schema.names, "n_lines", "n_dropped"])

    return rows.mapInArrow(returning(run), StructType([*rows.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))


def _dropped_by_join(rows: DataFrame, found: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """Distinct lines of distinct texts meet the boilerplate by (site, key); a text gets back its own bad lines alone."""
    taken = set(rows.columns)
    site, key, digest, bad = (next(n for n in (f"_{x}{i or ''}" for i in range(99)) if n not in taken) for x in ("site", "key", "digest", "bad"))
    text, of = F.col(f"`{text_col}`"), F.col(f"`{site_col}`")
    texts = rows.select(of.alias(site), text.alias("_text")).where("_text is not null").withColumn(digest, F.md5("_text")).dropDuplicates([site, digest])
    lines = texts.select(site, digest, F.explode(F.array_distinct(F.transform(_lines(F.col("_text")), lambda x: F.md5(x)))).alias(key))
    marks = found.select(F.col("site").alias("_of"), F.lower(F.hex("key")).alias("_line"))
    hits = lines.join(marks, F.col(site).eqNullSafe(F.col("_of")) & (F.col(key) == F.col("_line"))).groupBy(site, digest).agg(F.collect_set(key).alias(bad))
    hits = written(hits, "boilerplate-texts")
    joined = rows.join(hits, of.eqNullSafe(F.col(site)) & (F.md5(text) == F.col(digest)), "left")
    rest = F.filter(_lines(text), lambda x: ~F.array_contains(F.col(bad), F.md5(x)))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    n_rest = F.when(F.col(bad).isNull(), n_lines).otherwise(F.size(rest))
    return joined.select(
        *((F.when(F.col(bad).isNull(), text).otherwise(F.array_join(rest, "\n")).alias(c) if c == text_col else F.col(f"`{c}`")) for c in rows.columns),
        n_lines.cast("long").alias("n_lines"),
        (n_lines - n_rest).cast("long").alias("n_dropped"),
    )

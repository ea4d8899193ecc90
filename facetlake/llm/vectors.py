"""Vector code compression: product codes from codebooks that are refined with exact integers.

Method: a part's nearest entry is found by segment-mean lower bounds. For a block of n components with sums S and T the squared
distance is at least (S - T)^2 / n, and what the block means leave differs by at least the difference of the residual norms. These
bounds, first over the whole part, then over halves, quarters and so on, filter entries conservatively against the exact distance
of the entry with the least coarse bound; the survivors receive exact integer distances.

A round is one pass of tasks over the vectors. Each task sends one sum a component of an entry; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sharing import removed, written
from .common import slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components are held to this, so that a distance fits 63 bits for parts of up to 128 components.
MOST = 1 << 27
#: Rounding of the bounds, as a share of both squared norms: far above that of doubles, far below a step that matters.
SLACK = 1e-7
#: Labels whose sums are broadcast; beyond it they are joined by shuffle, a label's rows dealt to ``SALTS`` keys.
BROADCAST_LABELS, SALTS = 100_000, 32


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole: not null, with finite components only; v has floor(scale * x)."""
    whole = F.forall(F.col("_v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"))
    held = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.floor(x * scale).cast("double"))).cast("int")
    return rows.where(F.col("_v").isNotNull() & whole).select("vec_id", "label", F.transform("_v", lambda x: held(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x)))).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Entries:
    """The entries of one part position, with block sums and residual norms at each level, from coarse to fine."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        width, cuts, blocks = rows.shape[1], [], 1
        while blocks < width or not cuts:
            cuts.append(np.linspace(0, width, blocks + 1).astype(int)[:-1])
            blocks *= 2
        self.cuts = cuts
        self.sizes = [np.diff(np.append(c, width)).astype(float) for c in cuts]
        self.levels = [self.level(rows, k) for k in range(len(cuts))]
        self.norms = (rows.astype(float) ** 2).sum(1)

    def level(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Block sums divided by the root of the block's size, and the norms of what the block means leave."""
        sums = np.add.reduceat(rows, self.cuts[k], axis=1) / np.sqrt(self.sizes[k])
        return sums, np.sqrt(np.maximum(0, (rows.astype(float) ** 2).sum(1) - (sums**2).sum(1)))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower of equal ones, and the squared distance."""
        if not len(rows):
            return np.zeros(0, int), np.zeros(0, np.int64)
        norms = (rows.astype(float) ** 2).sum(1)
        (sums, rest), (own, own_rest) = self.level(rows, 0), self.levels[0]
        low = ((sums[:, None] - own[None]) ** 2).sum(2) + (rest[:, None] - own_rest[None]) ** 2
        first = low.argmin(1)
        top = ((rows - self.rows[first]) ** 2).sum(1)  # exact: no entry further away than this is the nearest
        row, entry = np.nonzero(low - SLACK * (norms[:, None] + self.norms[None]) <= top[:, None])
        for k in range(1, len(self.cuts)):
            (sums, rest), (own, own_rest) = self.level(rows, k), self.levels[k]
            low = ((sums[row] - own[entry]) ** 2).sum(1) + (rest[row] - own_rest[entry]) ** 2
            kept = low - SLACK * (norms[row] + self.norms[entry]) <= top[row]
            row, entry = row[kept], entry[kept]
        exact = np.full((len(rows), len(self.rows)), np.iinfo(np.int64).max)
        exact[row, entry] = ((rows[row] - self.rows[entry]) ** 2).sum(1)
        found = exact.argmin(1)
        return found, exact[np.arange(len(rows)), found]


def assigned(books: list[Entries], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components, nearest entry, squared distance) for each part position."""
    step = rows.shape[1] // len(books)
    for p, book in enumerate(books):
        part = rows[:, p * step : (p + 1) * step]
        yield p, part, *book.nearest(part)


def _sums(kept: DataFrame, books: list[Entries], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, component sums) of each (part, entry) over all vectors; entries that no part is nearest to are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, step = len(books[0].rows), width // len(books)
        n, total = np.zeros((len(books), size), np.int64), np.zeros((len(books), size, step), np.int64)
        for batch in slices(batches, 8000):
            for p, part, entry, _ in assigned(books, matrix(batch.column(0), width)):
                n[p] += np.bincount(entry, minlength=size)
                for i in range(step):  # sums of 8,000 values below 2**27 are exact as doubles
                    total[p, :, i] += np.bincount(entry, part[:, i], size).astype(np.int64)
        p, e, i = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, i, n[p, e], total.ravel())], ["part", "entry", "at", "n", "total"])

    sums = kept.select("v").mapInArrow(run, "part long, entry long, at long, n long, total long")
    found = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).where("n > 0")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(found.collect()):  # one row a component of a codebook
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["total"]))
    return out


def codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Entries]:
    """Codebooks of all part positions after ``rounds`` rounds, from the vectors with the ``entries`` smallest ids.

    A repeated id counts once, with its least vector; null is the largest id. Fewer ids make smaller codebooks.
    """
    ids = kept.select(F.col("vec_id").alias("_id")).distinct().orderBy(F.asc_nulls_last("_id")).limit(entries)
    seeds = kept.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = matrix(pa.array([r["v"] for r in seeds.orderBy(F.asc_nulls_last("vec_id")).collect()], pa.list_(pa.int32())), width)
    step = width // parts
    books = [Entries(rows[:, p * step : (p + 1) * step]) for p in range(parts)]
    for _ in range(rounds):
        found, new = _sums(kept, books, width), [b.rows.copy() for b in books]
        for (p, e), (n, total) in found.items():
            new[p][e] = [t // n for t in total]
        books = [Entries(rows) for rows in new]
    return books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    The code has two hex digits a part. Rows whose vector is null or has a null, NaN or infinite component go. The longest vector,
    filled up with zeros to a multiple of ``parts``, sets the width, shorter ones (empty ones too) are filled up as well. Components
    beyond 2**27 after scaling count as that. Repeated rows each stay and count each time, a null id or label is kept (null labels
    sum together), extra columns do no harm, and an empty table gives no row.
    """
    kept = written(integers(df, id_col, vector_col, label_col, scale), "vectors")
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = max(1, -(-longest // parts)) * parts
    books = codebooks(kept, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b.rows.tolist() for x in row).encode()).hexdigest()
    hexes = np.array([f"{i:02x}" for i in range(256)], "U2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8000):
            code, error = np.full(batch.num_rows, "", f"U{2 * parts}"), np.zeros(batch.num_rows, np.int64)
            for _, _, entry, distance in assigned(books, matrix(batch.column(2), width)):
                code, error = np.char.add(code, hexes[entry]), error + distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    coded = written(kept.select("vec_id", "label", "v").mapInArrow(run, "vec_id {}, label {}, code string, error long".format(*kinds)), "vector-codes")
    removed(kept)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        found = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = coded.withColumn("_deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        found = dealt.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_deal") == F.col("_salt")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB's SQL for vectors of one length that the parts divide."""
    near = """a{k} AS MATERIALIZED (SELECT r, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT x.r, x.part, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM x JOIN b{k} b USING (part)) GROUP BY r, part),
"""
    step = """s{k} AS MATERIALIZED (SELECT part, e, i, ((s - ((s % n + n) % n)) // n)::BIGINT AS m FROM (
  SELECT part, e, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM x JOIN a{k} USING (r, part), generate_series(1, (SELECT max(len(v)) FROM x)) AS g(i) GROUP BY part, e, i)),
b{n} AS MATERIALIZED (SELECT b.part, b.e, coalesce(t.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS v FROM s{k} GROUP BY part, e) t ON t.part = b.part AND t.e = b.e),
"""
    loop = "".join(near.format(k=k) + step.format(k=k, n=k + 1) for k in range(rounds)) + near.format(k=rounds)
    return f"""
WITH y AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM y, range({parts}) AS p(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM x WHERE r <= {entries}),
{loop}t AS (SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256
FROM y JOIN t USING (r)"""

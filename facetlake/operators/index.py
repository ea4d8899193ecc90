"""An adaptive index of boxes in space, and joins of places with what is near them.

Items (points, or triangles by their bounds) are dealt to the leaves of a tree. A node is cut where the middle of its items lies, on
the axis where they spread most; the size of an item is one more axis, so that a few huge triangles have leaves of their own. The
cuts come from a sample of bounded size, and the box and number of each leaf from all items. Tasks hold the tree (bounded by
``MOST_LEAVES``) and walk down for blocks of places: what no bound rules out gives (place, leaf) pairs. These meet the items under
(leaf, chunk, block) keys, with at most ``CHUNK`` items and about ``BLOCK`` places each, so that a dense cluster, equal places or a
leaf that very many places ask for are many tasks. The sample decides how fine the leaves are, never which rows come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sharing import removed, settled, small_table

XYZ = ("x", "y", "z")
LOW, HIGH = tuple("l" + c for c in XYZ), tuple("h" + c for c in XYZ)
#: Items that the cuts come from, items a leaf should have, and leaves at most.
SAMPLE, LEAF_ROWS, MOST_LEAVES = 200_000, 1024, 1 << 16
#: Items and places that meet under one key, and places walked down at once.
CHUNK, BLOCK, AT_ONCE = 4096, 16_384, 2000
#: Items and places that meet under one key of a region, and items that say how many a region will have.
REGION_ITEMS, REGION_PLACES, TRIED = 65_536, 16_384, 20_000
#: Rounding of squared distances, as a share: far above that of doubles.
SLACK = 1 + 1e-13


def placed(df: DataFrame, columns: tuple[str, ...] = XYZ) -> DataFrame:
    """Rows with a finite place; null, NaN and infinite coordinates are no place."""
    for c in columns:
        df = df.where(F.abs(F.col(c).cast("double")) < float("inf"))  # NaN is larger than any number
    return df


@dataclass
class Tree:
    """Nodes: where they are cut (``axis`` -1: a leaf), their children, their box and number of items. Node 0 is the root."""

    axis: np.ndarray
    at: np.ndarray
    below: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    @classmethod
    def cut(cls, sample: np.ndarray, leaf: int) -> Tree:
        """Cuts of a sample (rows of four numbers) so that a leaf has at most ``leaf`` of it, or equal ones only."""
        axis, at, below, todo = [-1], [0.0], [0], [(0, np.arange(len(sample)))]
        while todo:
            node, some = todo.pop()
            if len(some) <= leaf:
                continue
            part = sample[some]
            k = int(np.argmax(part.max(0) - part.min(0)))
            column = part[:, k]
            if column.max() == column.min():
                continue
            cut = np.partition(column, len(some) // 2)[len(some) // 2]
            cut = np.nextafter(cut, np.inf) if cut == column.min() else cut
            axis[node], at[node], below[node] = k, float(cut), len(axis)
            for side in (column < cut, column >= cut):
                todo.append((len(axis), some[side]))
                axis.append(-1)
                at.append(0.0)
                below.append(0)
        n = len(axis)
        return cls(np.array(axis), np.array(at), np.array(below), np.full((n, 3), np.inf), np.full((n, 3), -np.inf), np.zeros(n, np.int64))

    def leaf_of(self, items: np.ndarray) -> np.ndarray:
        node = np.zeros(len(items), np.int64)
        while len(inner := np.flatnonzero(self.axis[node] >= 0)):
            n = node[inner]
            node[inner] = self.below[n] + (items[inner, self.axis[n]] >= self.at[n])
        return node

    def fill(self, leaves: list) -> None:
        """Boxes and numbers of the leaves (node, rows, low, high), and from them those of the inner nodes."""
        for node, rows, *box in leaves:
            self.rows[node], self.low[node], self.high[node] = rows, box[:3], box[3:]
        for node in range(len(self.axis) - 1, -1, -1):  # children come after their parent
            if self.axis[node] >= 0:
                both = slice(self.below[node], self.below[node] + 2)
                self.rows[node], self.low[node], self.high[node] = self.rows[both].sum(), self.low[both].min(0), self.high[both].max(0)

    def near(self, p: np.ndarray, k: int | None = None, radius: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, leaf): leaves that may hold one of the ``k`` nearest items, or one within ``radius``, of each place."""
        point, node = np.arange(len(p)), np.zeros(len(p), np.int64)
        while True:
            at, low, high = p[point], self.low[node], self.high[node]
            near2 = (np.maximum(np.maximum(low - at, at - high), 0) ** 2).sum(1)
            if radius is not None:
                bound = radius * radius
            else:
                far2 = (np.maximum(np.abs(at - low), np.abs(high - at)) ** 2).sum(1)
                order = np.lexsort((far2, point))
                held = np.cumsum(self.rows[node][order])
                starts = np.searchsorted(point[order], np.arange(len(p)))
                before = np.append(0, held)[starts][point[order]]
                enough = np.flatnonzero(held - before >= k)  # boxes up to here surely hold k items
                bound = np.full(len(p), np.inf)
                first, where = np.unique(point[order][enough], return_index=True)
                bound[first] = far2[order][enough][where]
                bound = bound[point]
            kept = (near2 <= bound * SLACK) & (self.rows[node] > 0)
            point, node = point[kept], node[kept]
            inner = self.axis[node] >= 0
            if not inner.any():
                return point, node
            below = self.below[node[inner]]
            point, node = np.concatenate([point[~inner], point[inner], point[inner]]), np.concatenate([node[~inner], below, below + 1])
            order = np.argsort(point, kind="stable")
            point, node = point[order], node[order]


class Index:
    """Items with columns LOW and HIGH (their box), dealt to the leaves of a tree. ``None`` of ``Index.of`` stands for no items."""

    def __init__(self, items: DataFrame, tree: Tree):
        self.items, self.tree = items, tree

    @classmethod
    def of(cls, items: DataFrame, leaves: int | None = None) -> Index | None:
        """The index of items; with ``leaves``, of about so many leaves whatever the number of items."""
        items = items.withColumns({c: F.col(c).cast("double") for c in (*LOW, *HIGH)})
        n = items.count()
        if not n:
            return None
        middle = [(F.col(a) / 2 + F.col(b) / 2).alias(c) for a, b, c in zip(LOW, HIGH, XYZ, strict=True)]
        size = F.greatest(*(F.col(b) - F.col(a) for a, b in zip(LOW, HIGH, strict=True))).alias("size")
        some = items.select(*middle, size)
        share = min(1.0, SAMPLE / n)
        sample = some.sample(share, 7) if share < 1 else some
        rows = np.column_stack([c.to_numpy() for c in sample.toArrow().columns])
        tree = Tree.cut(rows, -(-len(rows) // leaves) if leaves else max(1, int(LEAF_ROWS * share), -(-2 * len(rows) // MOST_LEAVES)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in side]) for side in (LOW, HIGH))
                leaf = tree.leaf_of(np.column_stack([low / 2 + high / 2, (high - low).max(1)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        dealt = settled(items.mapInArrow(deal, StructType([*items.schema.fields, StructField("leaf", LongType())])))
        leaves = dealt.groupBy("leaf").agg(F.count("*"), *(F.min(c) for c in LOW), *(F.max(c) for c in HIGH)).collect()  # at most MOST_LEAVES
        tree.fill(leaves)
        return cls(dealt, tree)

    def met(self, places: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, k: int | None = None, radius: float | None = None) -> DataFrame:
        """What ``work`` gives for places (id, x, y, z) and the items under each key; every item that may count meets every place once."""
        spark, tree = places.sparkSession, self.tree

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    some = batch.slice(at, AT_ONCE)
                    point, leaf = tree.near(np.column_stack([some.column(c).to_numpy(zero_copy_only=False) for c in XYZ]), k, radius)
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(point)).columns, pa.array(leaf)], ["id", *XYZ, "leaf"])

        rows = placed(places.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in XYZ)))
        pairs = settled(rows.mapInArrow(walk, "id long, x double, y double, z double, leaf long"))
        asked = pairs.groupBy("leaf").count().collect()  # at most MOST_LEAVES
        deal = [(r["leaf"], int(-(-tree.rows[r["leaf"]] // CHUNK)), -(-r["count"] // BLOCK)) for r in asked]
        table = F.broadcast(spark.createDataFrame(deal, "leaf long, chunks int, blocks int"))
        key = [c for c in self.items.columns if c not in (*LOW, *HIGH, "leaf")][0]
        left = pairs.join(table, "leaf").withColumn("block", F.pmod(F.xxhash64("id", *XYZ), "blocks").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = self.items.join(table, "leaf").withColumn("chunk", F.pmod(F.xxhash64(key), "chunks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        by = ["leaf", "chunk", "block"]
        return left.drop("chunks", "blocks").groupBy(*by).cogroup(right.drop("chunks", "blocks").groupBy(*by)).applyInArrow(work, schema)

    def remove(self) -> None:
        """The dealt items go; only once what reads them is written."""
        removed(self.items)


class Regions:
    """Places dealt to a bounded number of leaves (regions), and items copied to each region that they may count for.

    An item has as many copies as there are regions at most, however many places there are. What meets under a key (region, chunk,
    block) is bounded, too.
    """

    def __init__(self, index: Index):
        self.index, self.tree = index, index.tree

    @classmethod
    def of(cls, places: DataFrame, regions: int) -> Regions | None:
        """The regions of placed rows (id, x, y, z); None where there are none."""
        index = Index.of(places.select("id", *(F.col(c).alias(b) for side in (LOW, HIGH) for c, b in zip(XYZ, side, strict=True))), regions)
        return index and cls(index)

    def places(self) -> DataFrame:
        return self.index.items.select("id", "leaf", *(F.col(c).alias(x) for c, x in zip(LOW, XYZ, strict=True)))

    def met(self, items: DataFrame, key: str, touched: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """What ``work`` gives for places (id, x, y, z) and items, which ``touched`` copies: (row, region) pairs of a batch."""
        share = min(1.0, TRIED / max(1, items.count()))
        tried = (items.sample(share, 7) if share < 1 else items).toArrow()  # about TRIED rows; they decide how fine chunks are only
        counts = np.bincount(np.concatenate([[0][:0], *(touched(b)[1] for b in tried.to_batches(AT_ONCE))]).astype(np.int64), minlength=len(self.tree.rows))
        deal = [(int(k), int(-(-counts[k] // (share * REGION_ITEMS))) or 1, int(-(-self.tree.rows[k] // REGION_PLACES))) for k in np.flatnonzero((self.tree.axis < 0) & (self.tree.rows > 0))]

        def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    some = batch.slice(at, AT_ONCE)
                    row, leaf = touched(some)
                    for first in range(0, len(row), 10 * AT_ONCE):
                        part = slice(first, first + 10 * AT_ONCE)
                        yield pa.RecordBatch.from_arrays([*some.take(pa.array(row[part])).columns, pa.array(leaf[part])], [*some.schema.names, "leaf"])

        table = F.broadcast(small_table(items.sparkSession, deal, "leaf long, chunks int, blocks int"))
        every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        left = self.places().join(table, "leaf").withColumn("block", F.pmod(F.xxhash64("id", *XYZ), "blocks").cast("int")).withColumn("chunk", every("chunks"))
        right = items.mapInArrow(copied, StructType([*items.schema.fields, StructField("leaf", LongType())])).join(table, "leaf")
        right = right.withColumn("chunk", F.pmod(F.xxhash64(key), "chunks").cast("int")).withColumn("block", every("blocks"))
        by = ["leaf", "chunk", "block"]
        return left.drop("chunks", "blocks").groupBy(*by).cogroup(right.drop("chunks", "blocks").groupBy(*by)).applyInArrow(work, schema)

    def remove(self) -> None:
        """The dealt places go; only once what reads them is written."""
        self.index.remove()

"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

Method: each shard stands at many places of a ring of hashes. A document belongs to the next node clockwise; where that node's
shard is full, it continues to the next one of another shard, and so on. Documents of one arc between two nodes take the same way,
so what overflows is worked out from the documents an arc has (a table as long as the ring, whatever the data): in the first hop
arcs fill their own shard in the order of the ring, in the next hop what is left goes to the next shard on its way, until nothing
is left. That is the ring's rule for documents that come in the order of hops.

Rows are numbered along the ring by a range sort; the number within the arc says into which of the arc's shards a row goes. Rows
with one hash are parted by further columns, so one id with a third of all rows is spread over ranges as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sharing import numbered, small_table

SHARDS, NODES = 8, 256
#: Hashes have this many bits; the ring's nodes are looked up by the first ``CELL_BITS`` of them.
BITS, CELL_BITS = 60, 12
#: Rows of one written file, about.
FILE_ROWS = 1 << 20


def place_of(key: Column) -> Column:
    """Place on the ring: the first 60 bits of the MD5 digest of the key as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int = SHARDS, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in the order of the ring; shard s has the same places in a ring with more shards."""
    table = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    rows = table.select(place_of(F.concat_ws("#", F.lit("shard"), "shard", "node")).alias("place"), "shard").collect()
    return sorted((r["place"], r["shard"]) for r in rows)


def ways(circle: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each arc, ending at a node or (the last) beyond all nodes, the shards clockwise from it."""
    order = [s for _, s in circle]
    after: list[list[int]] = [[]] * len(order)
    seen: list[int] = []
    for k in range(2 * len(order) - 1, -1, -1):  # twice around, backwards
        s = order[k % len(order)]
        seen = [s, *(x for x in seen if x != s)]
        after[k % len(order)] = seen
    return [*after, after[0]]


def capacities(rows: int, shards: int, factor: float | None) -> list[int]:
    """Documents that each shard may hold: the mean, one more for the first shards of a remainder, or ``factor`` times the mean."""
    if factor is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [max(-(-rows // shards), int(factor * rows / shards))] * shards


def segments(counts: dict[int, int], way: list[list[int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): rows ``from`` to ``to`` (exclusive) of an arc go to a shard, from that slot on."""
    left, taken, used, out = dict(counts), dict.fromkeys(counts, 0), [0] * len(room), []
    for hop in range(len(room)):
        for arc in sorted(a for a, n in left.items() if n):
            shard = way[arc][hop]
            n = min(left[arc], room[shard] - used[shard])
            if n:
                out.append((arc, taken[arc], taken[arc] + n, shard, used[shard]))
                left[arc], taken[arc], used[shard] = left[arc] - n, taken[arc] + n, used[shard] + n
    return out


def cells(spark: SparkSession, circle: list[tuple[int, int]]) -> DataFrame:
    """(_cell, _nodes, _next): the nodes (place, arc) of each part of the ring, and the arc that goes on beyond them."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(1 << CELL_BITS)]
    for arc, (place, _) in enumerate(circle):
        held[place >> (BITS - CELL_BITS)].append((place, arc))
    rows, arc = [], 0
    for k, nodes in enumerate(held):
        arc += len(nodes)
        rows.append((k, nodes, arc))
    return small_table(spark, rows, "_cell long, _nodes array<struct<place: long, arc: int>>, _next int")


def assign(df: DataFrame, id_col: str = "doc_id", tie_cols: tuple[str, ...] = (), shards: int = SHARDS, nodes: int = NODES, factor: float | None = None) -> DataFrame:
    """All rows and columns of ``df`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    The id, as text, is hashed; rows on one place are ordered by id, then ``tie_cols``, then as they come. Without a ``factor``
    shards get equally many rows, to one row; with one, a shard holds at most that many times the mean, and more rows stay where
    the plain ring puts them. Null ids are a key of their own. Repeated rows are rows each, so that a group of copies is spread
    where its shard is full. Columns named shard or slot are replaced; an empty table gives an empty one.
    """
    spark, circle = df.sparkSession, ring(df.sparkSession, shards, nodes)
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    name = {c: f"c{i}" for i, c in enumerate(kept)}  # no name of the rows meets one of those below
    keyed = df.select(*(F.col(f"`{c}`").alias(name[c]) for c in kept)).withColumns({"_place": place_of(F.col(name[id_col])), "_tie": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first(name[c]) for c in (id_col, *tie_cols)]
    rows = numbered(keyed, "_number", "_place", *order, "_tie")
    found = rows.join(F.broadcast(cells(spark, circle)), F.shiftright("_place", BITS - CELL_BITS) == F.col("_cell"))
    at = F.filter("_nodes", lambda x: x["place"] >= F.col("_place"))
    found = found.withColumn("_arc", F.when(F.size(at) > 0, at[0]["arc"]).otherwise(F.col("_next"))).drop("_cell", "_nodes", "_next")
    counts = {r["_arc"]: r["count"] for r in found.groupBy("_arc").count().collect()}  # at most as many as the ring has nodes
    plan = segments(counts, ways(circle, shards), capacities(sum(counts.values()), shards, factor))
    first, start = {}, 0
    for a in sorted(counts):
        first[a], start = start, start + counts[a]
    table: dict[int, list] = {}
    for a, low, high, shard, slot in plan:
        table.setdefault(a, []).append((first[a] + low, first[a] + high, shard, slot))
    sent = small_table(spark, sorted(table.items()), "_arc int, _segments array<struct<low: long, high: long, shard: int, slot: long>>")
    segment = F.filter("_segments", lambda x: (x["low"] <= F.col("_number")) & (F.col("_number") < x["high"]))[0]
    found = found.join(F.broadcast(sent), "_arc").withColumn("_segment", segment)
    return found.select(*(F.col(name[c]).alias(c) for c in kept), F.col("_segment.shard").alias("shard"), (F.col("_segment.slot") + F.col("_number") - F.col("_segment.low")).alias("slot"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", **options) -> None:
    """``df`` written as Parquet, one folder a shard; a shard of any size is many files, in the order of its slots within a file."""
    rows = assign(df, id_col, **options).withColumn("_file", F.floor(F.col("slot") / FILE_ROWS))
    rows.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``rows``: counts differ by one at most.

    Null text has no bytes (size 1). Only these columns and a digest of the text are moved; copies with one id are told apart by nothing.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"))
    placed = assign(rows, "doc_id", ("digest",), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle(shards: int = SHARDS, nodes: int = NODES) -> str:
    """DuckDB's SQL: hops as tables, a document's place and CRC by digests and bits."""
    hop = """h{k} AS MATERIALIZED (SELECT arc, low, least(n, greatest(0, room - before)) AS got, shard, room - room_left + before AS slot, n FROM (
  SELECT l.arc, l.low, l.n, w.shard, c.room, c.room_left, coalesce(sum(l.n) OVER (PARTITION BY w.shard ORDER BY l.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM l{k} l JOIN way w ON w.arc = l.arc AND w.hop = {k} JOIN c{k} c USING (shard))),
"""
    hop = hop.replace("greatest(0, room - before)", "greatest(0, room_left - before)")
    after = """l{n} AS MATERIALIZED (SELECT arc, low + got AS low, n - got AS n FROM h{k} WHERE n > got),
c{n} AS MATERIALIZED (SELECT shard, room, room_left - coalesce(g, 0) AS room_left FROM c{k} LEFT JOIN (SELECT shard, sum(got) AS g FROM h{k} GROUP BY shard) USING (shard)),
"""
    hops = "".join(hop.format(k=k) + after.format(k=k, n=k + 1) for k in range(shards))
    place = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    polynomial, powers = 0xEDB88320, []
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = (value >> 1) ^ (polynomial if value & 1 else 0)
        powers.append(value)
    step = "c >> 8"
    for bit, value in enumerate(powers):
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {value})"
    return f"""
WITH node AS MATERIALIZED (SELECT row_number() OVER (ORDER BY place, shard) - 1 AS arc, place, shard FROM (
  SELECT s AS shard, {place.format("'shard#' || s || '#' || v")} AS place FROM range({shards}) a(s), range({nodes}) b(v))),
d AS MATERIALIZED (SELECT doc_id, {place.format("coalesce(doc_id::VARCHAR, '')")} AS place, encode(coalesce(text, '')) AS x FROM documents),
k AS MATERIALIZED (SELECT doc_id, x, row_number() OVER (ORDER BY d.place, doc_id NULLS FIRST, md5(x)) - 1 AS g, coalesce(n.arc, {shards * nodes}) AS own
  FROM d ASOF LEFT JOIN node n ON d.place <= n.place),
l0 AS MATERIALIZED (SELECT own AS arc, min(g) AS low, count(*) AS n FROM k GROUP BY own),
c0 AS MATERIALIZED (SELECT s AS shard, n // {shards} + (s < n % {shards})::INT AS room, n // {shards} + (s < n % {shards})::INT AS room_left
  FROM range({shards}) a(s), (SELECT count(*) AS n FROM d)),
way AS MATERIALIZED (SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY far) - 1 AS hop FROM (
  SELECT a.arc, n.shard, min((n.arc - a.arc + {shards * nodes}) % {shards * nodes}) AS far FROM range({shards * nodes + 1}) a(arc), node n GROUP BY a.arc, n.shard)),
{hops}s AS (SELECT low, got, shard, slot FROM ({" UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(shards))}) WHERE got > 0),
crc AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(x), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT) AS text_crc32 FROM k)
SELECT doc_id, octet_length(x) + 1 AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (slot + g - low)::BIGINT AS slot, NULL::INT AS grown_shard
FROM k JOIN crc USING (g) JOIN s ON g >= low AND g < low + got"""

"""WARC archives: segmented records written from rows and reassembled.

Method: a record whose block is longer than a segment goes to disk as a first record and continuation records that name it
as their origin. Reading groups continuation records by origin identifier, orders them by segment number, verifies the total
length, and decodes the chunked transfer framing of the joined HTTP message.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sharing import new_folder, written
from .common import slices, text_of
from .storage import Sink, opened

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:facetlake:page:"
EPOCH = "1970-01-01T00:00:00Z"
#: Digests of repeated payloads that may be broadcast.
BROADCAST_DIGESTS = 200_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing (RFC 9112)."""
    out = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. Raises ValueError where it is cut short."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(framed[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A gzip member that holds one record; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (head.encode(), len(block), block)
    return packer.compress(raw) + packer.flush()


def records(key: str, page_id: int | None, url: str | None, payload: bytes, first: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a revisit that refers to page ``first``, else a response in segments."""
    digest = base32_sha1(payload)
    url = url and url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", f"<{URN}{key}>"), ("WARC-Date", EPOCH), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    kind = ("Content-Type", "application/http;msgtype=response")
    if first is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{first}:{digest}>"), kind], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield record([("WARC-Type", "response"), *common, kind], block)
        return
    yield record([("WARC-Type", "response"), *common, kind, ("WARC-Segment-Number", 1)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{URN}{key}:{n}>"), ("WARC-Date", EPOCH), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", f"<{URN}{key}>"), ("WARC-Segment-Total-Length", total)], piece)


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment: int = 32 << 10, chunk: int = 8 << 10, roll: int = 64 << 20) -> DataFrame:
    """Write one WARC record a row (plus continuations) to ``folder``/*.warc.gz; returns the manifest (archive, records).

    Of the rows with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is a response and the others
    revisit it; rows that share both payload and largest id, and all rows where no id is known, are responses. Null html is an
    empty payload, null url leaves the target out. Other columns are ignored. An empty table gives no archive. Ids become longs;
    one that is no number raises. Only digests and ids are shuffled while the repeated digests are BROADCAST_DIGESTS at most;
    beyond it the rows meet them in a join whose hot keys adaptive execution splits.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = written(first, "first")
    if first.count() <= BROADCAST_DIGESTS:
        first = F.broadcast(first)
    planned = rows.join(first, "digest", "left").select("id", "url", F.col("html").cast("binary").alias("payload"), F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, sink, count = TaskContext.get().partitionId(), [], None, 0
        for batch in slices(batches):
            for i, (page_id, url, payload, to) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if sink is None:
                    sink, count = Sink(folder, f"part-{part:05d}-{len(made):04d}.warc.gz"), 0
                    sink.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{URN}info:{part}:{len(made)}>"), ("WARC-Date", EPOCH), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                key = f"{page_id}:{base32_sha1(payload)}:{part}-{len(made)}-{count}"
                for data in records(key, page_id, url, payload, to, segment, chunk):
                    sink.write(data)
                count += 1
                if sink.tell() > roll:
                    sink.close()
                    made.append((sink.uri, count))
                    sink = None
        if sink is not None:
            sink.close()
            made.append((sink.uri, count))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    planned.mapInArrow(run, "archive string, records long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("archive string, records long").parquet(f"{folder}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    unpack, out, data = zlib.decompressobj(31), [], b""
    while True:
        if not data and not (data := stream.read(size)):
            return
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:40]}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("record cut short")
    return fields, block


def message(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of an HTTP message, its chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return fields, dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def read_archives(spark: SparkSession, manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Read archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to, n_segments[, payload]).

    Digest and size of a response are of the reassembled payload; a digest that differs from the record's, a missing segment or
    a wrong total length raises. Those of a revisit are of the payload it stands for, as its record says.
    One task reads an archive as a stream and finishes its whole records; only the segments of cut records are shuffled, by
    origin. What is read is written once; an empty manifest gives an empty result.
    """
    found = "origin: string, number: int, total: bigint, kind: string, page: bigint, digest: string, refers: bigint, block: binary"
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, n_segments int" + ", payload binary" * keep_payload

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()][: 6 + keep_payload]
    outs = [x.split()[0] for x in out.split(", ")]
    segment = pa.struct([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page", pa.int64()), ("digest", pa.string()), ("refers", pa.int64()), ("block", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows, cut):
            """Finished records, then segments with the other columns null."""
            done = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=False)]
            columns = [pa.concat_arrays([c, pa.nulls(len(cut), c.type)]) for c in done]
            return pa.RecordBatch.from_arrays([*columns, pa.array([None] * len(rows) + cut, segment)], [*outs, "segment"])

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = opened(uri)
                rows, cut, held = [], [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        f, block = parsed(raw)
                        if f["warc-type"] not in ("response", "revisit", "continuation"):
                            continue
                        page, refers = f.get("x-page-id"), f.get("warc-refers-to")
                        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                        refers = int(refers.removeprefix(f"<{URN}").partition(":")[0]) if refers else None
                        origin, digest, page = f.get("warc-segment-origin-id", f["warc-record-id"]), f.get("warc-payload-digest", "").removeprefix("sha1:"), page and int(page)
                        if number is None:
                            rows.append(whole(f["warc-type"], page, digest, refers, [{"block": block, "number": None}], origin)[: len(kinds)])
                            held += 100 + len(block) * keep_payload
                        else:
                            cut.append({"origin": origin, "number": int(number), "total": total and int(total), "kind": f["warc-type"], "page": page, "digest": digest, "refers": refers, "block": block})
                            held += len(block)
                        if held > 8 << 20:
                            yield packed(rows, cut)
                            rows, cut, held = [], [], 0
                if rows or cut:
                    yield packed(rows, cut)

    def whole(kind: str, page: int | None, digest: str, refers: int | None, segments: list[tuple], key: str) -> tuple:
        block = b"".join(s["block"] for s in segments)
        if segments[0]["number"] is not None:
            total = segments[-1]["total"]
            if [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or total != len(block):
                raise ValueError(f"{key}: segments missing, or {len(block)} bytes for {total}")
        fields, payload = message(block)
        if kind == "revisit":
            return page, int(fields["content-length"]), digest, kind, refers, len(segments), None
        if (now := base32_sha1(payload)) != digest:
            raise ValueError(f"{key}: payload digest {now}, not {digest}")
        return page, len(payload), now, kind, None, len(segments), payload

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [whole(*(r[c] for c in ("kind", "page", "digest", "refers")), r["segments"], r["origin"])[: len(kinds)] for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], outs)

    archives = max(1, manifest.count())  # a row an archive: one task deals them out evenly
    seen = written(manifest.select("archive").coalesce(1).repartition(archives).mapInArrow(scan, f"{out}, segment struct<{found}>"), "records")
    cut = seen.where("segment is not null").select("segment.*")
    segments = F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("segments")
    joined = cut.groupBy("origin").agg(*(F.max(c).alias(c) for c in ("page", "refers", "digest", "kind")), segments).mapInArrow(join, out)
    return seen.where("segment is null").drop("segment").unionByName(joined)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write the rows as archives in the shared folder, then read them back."""
    spark = df.sparkSession
    return read_archives(spark, write_archives(df, new_folder(spark, "warc"), **options))

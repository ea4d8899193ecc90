"""Media columns: payloads stored as audio members of archives and streamed back by a custom data source.

Method: texts become 8-bit PCM samples in WAV members of ZIP archives. The data source plans byte ranges of the archives; the
task of a range reads that archive's directory, takes the members whose offset lies in its range, and streams them through
Arrow. A member that can't be read, or whose checksum is wrong, is read again by its offset without touching the others.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sharing import new_folder
from .common import slices, text_of
from .storage import Sink, opened

UNIT = 64
RATE = 8000


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav(samples: bytes) -> bytes:
    """A mono 8-bit PCM file (RIFF/WAVE) of an even number of samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of an 8-bit mono PCM file; ValueError for any other."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        body = media[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            if form is None or form[0] != 1 or form[1] != 1 or form[5] != 8 or len(body) != size:
                raise ValueError("not 8-bit mono PCM, or cut short")
            return body
        at += 8 + size + size % 2
    raise ValueError("no samples")


def feature(samples: bytes) -> str:
    """Integer features of the samples: peak, sum, energy about 128, crossings of 128, and sums in 8 equal slices."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    slices = x.reshape(8, -1).sum(axis=1)
    return f"peak={np.abs(x).max()};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0))};slices={'/'.join(map(str, slices))}"


def write_archives(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", roll: int = 32 << 20) -> DataFrame:
    """Write a member a row to ``folder``/*.zip; returns the manifest (archive, bytes, members) of committed archives.

    Member names are ``id/bytes of text.wav``, ``null`` for a null id; null text is empty. Repeated ids and rows stay apart. Ids
    become longs; one that is no number raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, sink, bundle = TaskContext.get().partitionId(), [], None, None

        def done() -> None:
            bundle.close()
            size = sink.tell()
            sink.close()
            made.append((sink.uri, size, len(bundle.filelist)))

        for batch in slices(batches):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sink is None:
                    sink = Sink(folder, f"part-{part:05d}-{len(made):04d}.zip")
                    bundle = zipfile.ZipFile(Unseekable(sink), "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{len(raw)}.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                bundle.writestr(info, wav(padded(raw)), compresslevel=1)
                if sink.tell() > roll:
                    done()
                    sink = None
        if sink is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "bytes", "members"])

    schema = "archive string, bytes long, members long"
    df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("raw")).mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")


class Unseekable(io.RawIOBase):
    """A write-only stream for zipfile, which then puts sizes after each member."""

    def __init__(self, sink: Sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


@dataclass
class Range(InputPartition):
    """Members whose offset is in [start, end) of an archive."""

    archive: str
    start: int
    end: int


class MediaSource(DataSource):
    """``format("facetlake_media")``: the members of ZIP archives. Options: ``folder``, ``range_bytes``, ``attempts``."""

    @classmethod
    def name(cls) -> str:
        return "facetlake_media"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["folder"]
        self.step = int(options.get("range_bytes", 16 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[Range]:
        """Byte ranges of the committed archives, from the manifest: one row an archive, so small however many members there are."""
        import pyarrow.parquet as pq

        files, path = opened(f"{self.folder}/manifest")
        listed = pq.read_table(path, filesystem=files, columns=["archive", "bytes"]).to_pylist()
        return [Range(x["archive"], a, min(a + self.step, x["bytes"])) for x in listed for a in range(0, x["bytes"], self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):  # what Spark passes where there are no ranges
            return
        files, path = opened(partition.archive)
        rows, held = [], 0
        with files.open_input_file(path) as stream:
            inside = [i for i in zipfile.ZipFile(stream).infolist() if partition.start <= i.header_offset < partition.end]
            for info in inside:
                media = self.member(files, path, stream, info)
                rows.append((partition.archive, info.header_offset, info.filename, media))
                held += len(media)
                if held > 8 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def member(self, files, path: str, stream, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset: first from the open stream, then from the file opened anew."""
        for attempt in range(self.attempts):
            try:
                if attempt == 0:
                    return member_at(stream, info)
                with files.open_input_file(path) as again:
                    return member_at(again, info)
            except (OSError, zlib.error, ValueError) as e:
                failed = e
                time.sleep(0.1 * attempt)
        raise OSError(f"{path}: member {info.filename} at {info.header_offset}: {failed}")

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["archive", "offset", "name", "media"])


def member_at(stream, info: zipfile.ZipInfo) -> bytes:
    """Unpack the member at its offset and verify its checksum."""
    stream.seek(info.header_offset)
    head = stream.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    stream.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    raw = stream.read(info.compress_size)
    raw = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
    if len(raw) != info.file_size or zlib.crc32(raw) != info.CRC:
        raise ValueError("checksum differs")
    return raw


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members of the archives in ``folder``."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("facetlake_media").options(folder=folder, **options).load()


def describe(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each stored member."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(name: str, media: bytes) -> tuple:
        doc_id, _, rest = name.partition("/")
        x = samples_of(media)
        return None if doc_id == "null" else int(doc_id), int(rest.partition(".")[0]), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [one(n, m) for n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return media.select("name", "media").mapInArrow(run, schema)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Store every text as a member of an archive in the shared folder, read it back and describe it.

    One row out a row in: null text is empty, null and repeated ids and repeated rows stay, texts are stored whole, other
    columns are ignored, an empty table gives an empty one. Equal texts get equal values.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "media")
    write_archives(df, folder, **options)
    return describe(read_media(spark, folder))

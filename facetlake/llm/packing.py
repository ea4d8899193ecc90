"""Best-fit packing of token sequences.

Method (best two fit): a sequence is filled greedily with the longest piece that fits; then its smallest piece is replaced by
two unpacked ones that fill the gap it leaves more tightly, while there are such. Pieces are dealt at random to groups of
bounded size, and each group is packed on its own.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sharing import written
from .common import TEXT_BYTES, Cache, held_by_worker, returning, slices, text_of

#: Pieces of a group at most, about: larger groups pack tighter, smaller ones spread better.
GROUP_PIECES = 16_384
#: Words of lower-case ASCII and Latin-1 letters in UTF-8: composed and lower-case already, one word for the vocabularies here.
LOWER_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Such a word and ASCII marks after it, without those that contractions and special tokens begin with.
WORD_AND_MARKS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{-~]+)").fullmatch
#: Words that show whether a vocabulary's model may be asked directly.
PROBES = [b"a", b"the", b"zqxjkvbwy", b"education", "\u00e9l\u00e8ve".encode(), "stra\u00dfe".encode(), "\u00fc\u00f8\u00ff\u00f6".encode()]
#: Bytes as the characters that byte-level vocabularies write them as.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in _KEPT} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_KEPT}))}
BLANKS = bytes.maketrans(b"\t\n\r", b"   ")


class Learning(Cache):
    """A cache that asks ``learn`` for what it lacks, which puts it in."""

    def __init__(self, most: int, learn: Callable[[bytes], bytes]):
        super().__init__(most)
        self.learn = learn

    def __missing__(self, key: bytes) -> bytes:
        return self.learn(key)


class Coder:
    """Ids as little-endian 32-bit bytes, by the tokenizers library for chunks between blanks, kept in a bounded cache.

    For vocabularies whose words never cross white space and whose normalizer lower-cases: a chunk's ids don't depend on its
    neighbours, on the case of its ASCII letters, or on one mark after a letter.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache, self.before = Learning(40 << 20, self.learn), {}
        whole = self.tokenizer.encode_batch_fast([c.decode() for c in PROBES], add_special_tokens=False)
        self.direct = all(self.ids_of_word(c) == np.array(x.ids, "<u4").tobytes() for c, x in zip(PROBES, whole, strict=True))

    def ids_of_word(self, word: bytes) -> bytes:
        """Ids of one word by the library's model alone: no normalizer changes it, and byte-level vocabularies split it no further."""
        found = self.tokenizer.model.tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_LEVEL))
        return struct.pack(f"<{len(found)}I", *[x.id for x in found])

    def learn(self, chunk: bytes) -> bytes:
        """Ids of a chunk that the cache lacks; marks after a word are taken by themselves, so that both parts are known."""
        if (ids := self.before.pop(chunk, None)) is not None:
            pass
        elif self.direct and LOWER_WORD(chunk):
            ids = self.ids_of_word(chunk)
        elif self.direct and (parts := WORD_AND_MARKS(chunk)):
            ids = self.cache[parts[1]] + self.cache[parts[2]]
        elif chunk[-1:] in (b".", b",") and chunk[-2:-1].isalpha() and b"<" not in chunk:
            ids = self.cache[chunk[:-1]] + self.cache[chunk[-1:]]
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([chunk.decode()], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return self.cache.put(chunk, ids, len(chunk) + len(ids))

    def turn(self) -> None:
        """A full cache becomes the one before, from which chunks that come again are taken over."""
        if self.cache.bytes > self.cache.most:
            self.before, self.cache = self.cache, Learning(self.cache.most, self.learn)

    def encode(self, texts: list[str]) -> list[bytes]:
        self.turn()
        get, found = self.cache.__getitem__, []
        for text in texts:
            raw = text.encode()
            raw = raw if b"<|" in raw else raw.lower()  # special tokens are case-sensitive
            found.append(b"".join(map(get, raw.translate(BLANKS).split(b" "))))
        return found


def coder(path: str) -> Coder:
    """The worker's coder of this vocabulary; it outlives a task, its cache is bounded."""
    return held_by_worker(("packing", path), lambda: Coder(path))


def cut_pieces(df: DataFrame, vocabulary: str, width: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut into pieces of ``width`` ids.

    Null text is empty and has the one id ``end_id``. Null ids and repeated rows stay. Ids become longs; one that is no number raises.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = coder(vocabulary)
        for batch in slices(batches, most_bytes=TEXT_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * width)):
                    piece = ids[at : at + 4 * width]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), np.frombuffer(piece, "<u4").astype("i4") if with_ids else None)[: 5 + with_ids])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(returning(run), schema)


class Pool:
    """Unpacked pieces by length; a bit mask says which lengths there are."""

    def __init__(self, lengths: np.ndarray):
        self.by: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            self.by.setdefault(int(lengths[i]), []).append(i)
        self.mask = sum(1 << n for n in self.by)

    def longest(self, room: int) -> int:
        """The longest length of at most ``room``, 0 for none."""
        return max(0, (self.mask & ((2 << room) - 1)).bit_length() - 1) if room > 0 else 0

    def take(self, n: int) -> int:
        some = self.by[n]
        i = some.pop()
        if not some:
            self.mask &= ~(1 << n)
        return i

    def give(self, n: int, i: int) -> None:
        self.by[n].append(i)
        self.mask |= 1 << n

    def pair(self, room: int, more_than: int) -> tuple[int, int] | None:
        """The two lengths whose sum is the largest of at most ``room``, over ``more_than``."""
        best, a = (more_than, 0, 0), self.longest(room - 1)
        while a and 2 * a > best[0] and best[0] < room:
            b = self.longest(min(room - a, a))
            if b == a and len(self.by[a]) < 2:
                b = self.longest(min(room - a, a - 1))
            if b and a + b > best[0]:
                best = (a + b, a, b)
            a = self.longest(a - 1)
        return best[1:] if best[1] else None


def pack(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Bins of indexes by best two fit; every length is 1 to ``width``."""
    pool, bins = Pool(lengths), []
    while pool.mask:
        content, room = [], width
        while n := pool.longest(room):
            content.append((n, pool.take(n)))
            room -= n
        while room:
            small, i = content[-1]
            found = pool.pair(room + small, small)
            if not found:
                break
            content.pop()
            content += [(n, pool.take(n)) for n in found]
            content.sort(reverse=True)
            pool.give(small, i)
            room += small - sum(found)
        bins.append([i for _, i in content])
    return bins


def pack_pieces(pieces: DataFrame, width: int = 2048, group: int = GROUP_PIECES) -> DataFrame:
    """All columns of ``pieces`` with sequence_id (unique, any numbers) and offset (gapless from 0 in each sequence).

    Pieces go to groups of about ``group`` by a hash of what they are and of their place in the written table, so that many equal
    rows (null ids with empty texts) spread too; a repeated task finds the same place again. ``pieces`` should be a written table;
    it is counted first.
    """
    taken = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_salt")]
    groups = max(1, -(-pieces.count() // group))
    salted = pieces.select(*taken, F.monotonically_increasing_id().alias("_salt"))
    dealt = salted.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32", "length", "_salt")).drop("_salt")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [f for f in frames if len(f)]
        if not mine:
            return
        rows = pd.concat(mine, ignore_index=True).sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins = pack(rows["length"].to_numpy(), width)
        order = np.concatenate([np.array(b) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) + (TaskContext.get().partitionId() << 32)
        rows = rows.iloc[order]
        ends = rows["length"].cumsum()
        start = ends - rows["length"]
        yield rows.assign(sequence_id=number, offset=start - start.groupby(number).transform("first"))

    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInPandas(run, schema)


def pack_documents(df: DataFrame, vocabulary: str, width: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece.

    Only texts of more than ``width`` ids (their end id included) are cut. Null text is empty; null ids and repeated rows are
    packed like others; extra columns are ignored; an empty table gives an empty result.
    """
    return pack_pieces(written(cut_pieces(df, vocabulary, width, 0, id_col, text_col, with_ids), "pieces"), width)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of each sequence joined by offset; needs the pieces' ids. A group holds ``width`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))

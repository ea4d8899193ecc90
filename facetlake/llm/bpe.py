"""Byte-level BPE encoding and decoding.

Method: a segment tree over the ranks of adjacent pairs. Each leaf holds ``rank * width + position`` of the pair that starts
there, each inner node the least of its children, so the root is the leftmost pair of the lowest rank. A merge changes three
leaves, each in logarithmic time, until the root says that no pair can merge. ``merge_many`` runs one tree for each of many
short words at once as rows of numpy arrays; ``merge_one`` is the same tree for one long word.

Words are the pieces the public pre-tokenizer pattern makes; a piece never crosses a single space before a visible character,
so encoded chunks between spaces are kept in a bounded cache of the worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Cache, held_by_worker, slices, text_of

#: Fixed: the pattern that cuts text into words before the merges.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
BLANK = regex.compile(r"\s")
NONE = np.int64(1) << 62


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if printable Latin-1, else U+0100 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE in the public JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"] not in ids or t["special"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        self.bytes = {str(i): bytes(back[c] for c in token) for token, i in ids.items()}
        self.bytes.update({str(i): s.encode() for s, i in self.special.items()})
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.base = np.int64(max(ids.values()) + 1)
        keys = np.array([ids[a] * int(self.base) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.merged_ids = self.merged.tolist()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1 where the pair doesn't merge (or an id is negative)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def merge_many(vocab: Vocabulary, words: list[bytes], width: int) -> list[list[int]]:
    """Ids of words of at most ``width`` bytes (a power of two): one segment tree a row."""
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ids = np.full((n, width), -1, np.int64)
    inside = np.arange(width) < sizes[:, None]
    ids[inside] = vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    after = np.where(np.arange(width) + 1 < sizes[:, None], np.arange(1, width + 1), -1)
    before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    first = vocab.rank(ids[:, :-1], ids[:, 1:])
    tree[:, width : 2 * width - 1] = np.where(first >= 0, first * width + np.arange(width - 1), NONE)
    at = width
    while at > 1:
        tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
        at //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        rank, p = np.divmod(tree[rows, 1], width)
        q = after[rows, p]
        r = after[rows, q]
        o = before[rows, p]
        ids[rows, p] = new = vocab.merged[rank]
        ids[rows, q] = -1
        after[rows, p] = r
        has = r >= 0
        before[rows[has], r[has]] = p[has]
        right = vocab.rank(new, np.where(has, ids[rows, r], -1))
        left = vocab.rank(np.where(o >= 0, ids[rows, o], -1), new)
        who = np.concatenate((rows, rows, rows[o >= 0]))
        leaf = np.concatenate((q, p, o[o >= 0])) + width
        value = np.concatenate((np.full(len(rows), NONE), np.where(right >= 0, right * width + p, NONE), np.where(left >= 0, left * width + o, NONE)[o >= 0]))
        tree[who, leaf] = value
        while leaf[0] > 1:
            leaf = leaf >> 1
            tree[who, leaf] = np.minimum(tree[who, 2 * leaf], tree[who, 2 * leaf + 1])
        rows = rows[tree[rows, 1] < NONE]
    kept = ids >= 0
    flat = ids[kept].tolist()
    ends = np.cumsum(kept.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_one(vocab: Vocabulary, word: bytes) -> list[int]:
    """Ids of one word of any length."""
    n = len(word)
    width = 1 << max(0, n - 1).bit_length()
    ids = vocab.of_byte[np.frombuffer(word, np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    none, base, rank_of, merged = int(NONE), int(vocab.base), vocab.rank_of, vocab.merged_ids
    tree = [none] * (2 * width)
    for i in range(n - 1):
        k = rank_of.get(ids[i] * base + ids[i + 1])
        if k is not None:
            tree[width + i] = k * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    def look(i: int, j: int) -> None:
        k = rank_of.get(ids[i] * base + ids[j]) if i >= 0 and j >= 0 else None
        if i >= 0:
            put(i, none if k is None else k * width + i)

    while n > 1 and tree[1] < none:
        k, p = divmod(tree[1], width)
        q = after[p]
        ids[p], ids[q] = merged[k], -1
        after[p] = r = after[q]
        if r >= 0:
            before[r] = p
        put(q, none)
        look(p, r)
        look(before[p], p)
    return [i for i in ids if i >= 0]


class Encoder:
    """Encodes texts as strings of decimal ids joined by commas, and decodes them."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.chunks = Cache(100 << 20)  # ids of a space and what follows up to the next

    def merged(self, words: Iterable[str]) -> dict[str, str]:
        """Ids of each word, worked out by length."""
        found: dict[str, str] = {}
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(max(4, 1 << (len(w.encode()) - 1).bit_length()), []).append(w)
        for width, some in by.items():
            raw = [w.encode() for w in some]
            if width > 64 or len(some) < 16:
                out = [merge_one(self.vocab, r) for r in raw]
            else:
                out = [x for i in range(0, len(raw), 20_000) for x in merge_many(self.vocab, raw[i : i + 20_000], width)]
            for w, ids in zip(some, out, strict=True):
                found[w] = ",".join(map(str, ids))
        return found

    def encode(self, texts: list[str]) -> list[str]:
        """One comma-joined string of ids a text; an empty text has none."""
        self.chunks.trim()
        split: dict[int, list[str]] = {}
        cut: dict[int, list[str]] = {}
        special, chunks = self.vocab.special, self.chunks
        seen: set[str] = set()
        for i, text in enumerate(texts):
            if any(s in text for s in special):
                at, pieces = 0, []
                for m in self.vocab.cut.finditer(text):
                    pieces += [*WORDS.findall(text[at : m.start()]), m[0]]
                    at = m.end()
                cut[i] = pieces + WORDS.findall(text[at:])
            else:
                split[i] = parts = text.split(" ")
                seen.update(parts)
        # A chunk between single spaces is encoded with the space before it; where blanks meet, the whole text is cut at once.
        missing = [w for w in seen if w not in chunks]
        unclean = {w for w in missing if not w or BLANK.match(w[0]) or BLANK.match(w[-1])}
        inner = {w: WORDS.findall(" " + w) for w in missing if w not in unclean}
        heads = {i: WORDS.findall(parts[0]) for i, parts in split.items()}
        for i, parts in [*split.items()] if unclean else []:
            if not unclean.isdisjoint(parts):
                cut[i] = WORDS.findall(texts[i])
                del split[i]
        words = self.merged({p for parts in (*inner.values(), *heads.values(), *cut.values()) for p in parts if p not in special})
        known = words.__getitem__
        for w, parts in inner.items():
            ids = known(parts[0]) if len(parts) == 1 else ",".join(map(known, parts))
            chunks.put(w, ids, len(w) + len(ids))
        out = [""] * len(texts)
        for i, parts in split.items():
            parts[0:1] = heads[i]
            k = len(heads[i])
            out[i] = ",".join([*map(known, parts[:k]), *map(chunks.__getitem__, parts[k:])])
        for i, parts in cut.items():
            out[i] = ",".join([str(special[p]) if p in special else known(p) for p in parts])
        return out

    def decode(self, ids: str) -> bytes:
        """UTF-8 bytes of the text that the ids stand for; bytes that aren't UTF-8 become U+FFFD, ids out of the vocabulary nothing."""
        if not ids:
            return b""
        raw = b"".join(map(self.vocab.bytes.get, ids.split(","), _EMPTY))
        return raw.decode("utf-8", "replace").encode()


class _Empty:
    """An endless iterator of empty bytes, as the default of dict.get in map()."""

    def __iter__(self):
        return self

    def __next__(self):
        return b""


_EMPTY = _Empty()


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary; it outlives a task, its cache is bounded."""
    return held_by_worker(("bpe", path), lambda: Encoder(path))


def encode_column(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256[, ids array]).

    Null text counts as empty: no ids, the digests of no bytes. Null ids and repeated rows pass through, one row out a row in.
    Other columns are ignored, whatever their names. Texts of any length are taken whole. An empty table gives an empty one.
    ``vocabulary`` is a path that every worker can read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in slices(batches):
            ids = coder.encode(batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return df.select(df[id_col], text_of(text_col).alias("text")).mapInArrow(run, schema)

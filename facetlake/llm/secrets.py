"""Secret scans: credential patterns plus a token-efficiency test for random strings.

Method: ordinary words and identifiers compress well under a tokenizer's vocabulary, random strings don't. From a run of key
characters known identifiers (UUIDs, digests of known lengths, dates and times), numbers and pieces that are words are taken out;
what is left of it is a secret where it has few characters a token: under ``max_ratio``, or the lower ratios for short stretches
and for those without a digit. Spans of the base patterns always stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, held_by_worker, returning, slices, text_of

#: Fixed patterns of the base scan, and the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")
#: What a text must hold, in lower case, for ASSIGN to match.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Least length of a random string, and the length from which one needs no digit.
LEAST_RANDOM, LEAST_LETTERS = 16, 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RANDOM)
PIECE = re.compile(r"[^/=_+-]+")
DIGEST_LENGTHS = (128, 96, 64, 56, 48, 40, 32)
#: Known identifiers inside a run: UUIDs, digests that stand alone, dates with or without a time.
KNOWN = re.compile(
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    + r"|(?<![A-Za-z0-9])(?:%s)(?![A-Za-z0-9])" % "|".join(f"[{x}]{{{n}}}" for n in DIGEST_LENGTHS for x in ("0-9a-f", "0-9A-F"))
    + r"|(?<![A-Za-z0-9])(?:19|20)\d\d[-/_]?(?:0[1-9]|1[0-2])[-/_]?(?:0[1-9]|[12]\d|3[01])(?:[T_-]?\d\d[-_]?\d\d(?:[-_]?\d\d(?:[-_]\d{1,6})?)?Z?)?(?![A-Za-z0-9])"
)
#: A piece beside a separator that has the shape of a word, and letters with a short number.
SHAPED, LETTERED = re.compile(r"[a-z]{3,15}|[A-Z]{3,15}|[A-Z][a-z]{2,14}"), re.compile(r"([A-Za-z]{3,})\d{0,4}")
#: Characters a token, measured on all documents and on random strings (see the README): under 20 characters, without digits, and
#: from which on a piece is a word.
SHORT_RATIO, LETTERS_RATIO, WORD_RATIO = 1.9, 2.1, 2.6
#: Digits of a piece that is a number.
NUMBER_DIGITS = 14


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    # A run of 32 or more is matched whole, as the maximal runs of hex digits are.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def wordy(piece: str, alone: bool, coder: tiktoken.Encoding) -> bool:
    """Whether a piece between separators is a number or a word; ``alone`` is one without separators around."""
    if piece.isdigit():
        return len(piece) <= NUMBER_DIGITS
    if not alone and SHAPED.fullmatch(piece):
        return True
    word = LETTERED.fullmatch(piece)
    return any(len(x) >= WORD_RATIO * len(coder.encode_ordinary(x)) for x in ([piece, word[1]] if word else [piece] if len(piece) >= 3 else []))


def left_of(run: str, coder: tiktoken.Encoding) -> Iterator[tuple[int, int]]:
    """Stretches of a run that are no known identifier, number or word, with the separators inside."""
    at, parts = 0, []
    for m in KNOWN.finditer(run):
        parts.append((at, m.start()))
        at = m.end()
    for a, b in [*parts, (at, len(run))]:
        first = last = None
        for m in PIECE.finditer(run, a, b) if b - a >= LEAST_RANDOM else ():
            if not wordy(m[0], m.end() - m.start() == b - a, coder):
                first, last = m.start() if first is None else first, m.end()
            elif first is not None:
                yield first, last
                first = None
        if first is not None:
            yield first, last


def random_spans(text: str, coder: tiktoken.Encoding, max_ratio: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches outside the sorted spans taken so far that need more than a token for each so many characters."""
    found, i, reach = [], 0, 0
    for m in RUN.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():  # spans of the kinds may overlap: keep the farthest end
            reach = max(reach, taken[i][2])
            i += 1
        if reach > m.start():
            continue
        for a, b in left_of(m[0], coder):
            part = m[0][a:b]
            digit = any(c.isdigit() for c in part)
            if b - a < (LEAST_RANDOM if digit else LEAST_LETTERS) or not any(c.isalpha() for c in part):
                continue
            ratio = min(max_ratio, LETTERS_RATIO if not digit else SHORT_RATIO if b - a < LEAST_LETTERS else max_ratio)
            if b - a < ratio * len(coder.encode_ordinary(part)):
                found.append((m.start() + a, 3, m.start() + b))
    return found


def coder(path: str, pattern: str) -> tiktoken.Encoding:
    """The worker's encoding of this vocabulary; it outlives a task."""

    def read() -> tiktoken.Encoding:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return held_by_worker(("secrets", path, pattern), read)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def all_spans(text: str, encoding: tiktoken.Encoding, max_ratio: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans by start and kind."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, encoding, max_ratio, base))


def find_secrets(df: DataFrame, ranks: str, pattern: str, max_ratio: float = 2.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text: (id, n_assign, n_access, n_hex, n_random, base_sha256, spans).

    Spans are code points, end exclusive. Null text counts as empty and has none. Null ids and repeated rows pass through.
    Other columns are ignored. Texts are scanned whole. An empty table gives an empty one.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    names = [id_col, *(x.split()[0] for x in schema.split(", ")[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(ranks, pattern)
        for batch in slices(batches, most_bytes=TEXT_BYTES):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text, encoding, max_ratio)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names[1:]]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return df.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(returning(run), schema)


def redact(df: DataFrame, ranks: str, pattern: str, mark: str = "[SECRET]", max_ratio: float = 2.2, text_col: str = "text") -> DataFrame:
    """``df`` with every stretch of secret spans in the text replaced by ``mark``; null text stays null, all columns and rows stay."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(ranks, pattern)
        for batch in slices(batches, most_bytes=TEXT_BYTES):
            texts = [None if t is None else redacted(t, all_spans(t, encoding, max_ratio)[1], mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(returning(run), df.schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each maximal stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])

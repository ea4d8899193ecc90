"""Toxicity of deobfuscated text.

Method: a noisy channel. A suspicious stretch (leetspeak, single characters with short separators, doubled letters in a word that
the corpus doesn't know) is a lattice: each character is itself, a letter it may stand for, a boundary, or nothing. The best path
through words that the corpus knows restores it, or without one the Viterbi path under a character trigram model of the whole
corpus; elsewhere the lattice has one path, the text itself. Parts of a word with blanks between them are put together where one
of them is unknown and the whole is known. A logistic model over words and word beginnings scores what is restored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sharing import removed, written
from .common import Cache, held_by_worker, released, slices, text_of

#: Fixed: letters that a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "*": "aeiou"}
#: Log probabilities of the channel: a sign for a letter, as a boundary inside and at the ends of a stretch, and left out; a
#: separator of spaced letters as a boundary; a second and a further equal letter left out.
AS_LETTER, INNER, OUTER, LEFT_OUT, SEPARATOR = (math.log(p) for p in (0.3, 0.05, 0.2, 0.1, 0.1))
SECOND, FURTHER = 0.1, 0.9
#: Log probability of a known word in a reading, and of one letter as a word besides; spaced letters make single letters known.
ONE_WORD, ONE_LETTER = math.log(0.01), math.log(0.01)
#: Classes of characters: boundary, a to z, other letters.
CLASSES, OTHER = 28, 27
#: Single letters, digits or signs with up to three separators between them; no sign is a separator too, so that matching is linear.
SPACED = re.compile(r"(?<![^\s(\"\[])(?:[^\W_]|[@$!|+(€£¢*])(?:[\s.,'’_/:;~\\=-]{1,3}(?:[^\W_]|[@$!|+(€£¢*])){2,}(?![^\W_])")
#: A letter three times, or a letter beside a sign or digit.
ODD = re.compile(r"([^\W\d_])\1\1|[^\W\d_][^\w\s'’.,;:?-]|[^\w\s'’.,;:?-][^\W\d_]|[^\W\d_]\d|\d[^\W\d_]|[^\W\d_][*._-][^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"([^\W\d_])\1")
RUNS = re.compile(r"(.)\1*", re.DOTALL)
#: A word with signs after it that stand for nothing.
TAILED = re.compile(f"([^\\W\\d_]+)[^\\w{re.escape(''.join(LEET))}]+")
#: Paths up to which a lattice of letters alone is written out.
MOST_PATHS = 64
#: A word of signs and digits alone that each stand for a letter.
SIGNS = re.compile(f"[{re.escape(''.join(LEET))}]{{3,}}")
#: A word is known from this share of the texts on (three at least): there are fewer than the mean of a text's words divided by it.
KNOWN_SHARE, KNOWN_TEXTS = 1e-4, 3
#: Letters of a known word at most, so that known words take LONGEST times their number in bytes of letters.
LONGEST = 48
#: Parts of a split word, and its least length.
PARTS, LEAST_JOINED = 4, 4
EDGES = ".,;:?!'’\"()[]"
#: Those of them that beside a letter are nothing odd.
PLAIN_EDGES = ".,;:?'’"
BEGINNINGS = range(4, 10)
LEVELS = 3
#: Bytes of text whose features a task holds at once while it counts them: their names take many times as much.
COUNTED_BYTES = 256 << 10
#: Bytes of text in a block that is scored at once.
SCORED_BYTES = 1 << 20


def class_table() -> np.ndarray:
    """Class of each code point of the basic plane."""
    table = np.zeros(0x10000, np.int32)
    for c in range(0x10000):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else OTHER
    return table


_TABLE: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(class_table())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _TABLE[0][np.minimum(points, 0xFFFF)]


def corpus_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(cell, word, n): how often each trigram of character classes is in all texts (``CLASSES`` ** 3 cells at most), and how many
    texts each word of letters is in, lower-cased. One of cell and word is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker(("toxicity", "corpus"), lambda: None)  # what another operator kept goes
        total = np.zeros(CLASSES**3, np.int64)
        for batch in slices(batches, most_bytes=1 << 20):
            texts = [t.lower() for t in batch.column(0).to_pylist()]
            for text in texts:
                c = classes("  " + text + " ")
                total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
            words, n = words_of(texts)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), words, pa.array(n, pa.int64())], ["cell", "word", "n"])
        cells = np.flatnonzero(total)
        batch = texts = words = n = None
        released()
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.nulls(len(cells), pa.string()), pa.array(total[cells])], ["cell", "word", "n"])

    return df.select(text_of(text_col).alias("text")).mapInArrow(run, "cell int, word string, n long").groupBy("cell", "word").agg(F.sum("n").alias("n"))


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words (runs of letters) of some texts, and in how many of them each is."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    whole = "\n".join([*texts, ""])
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    letter = letters()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF).tolist():
        letter[i] = chr(points[i]).isalpha()
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    data = np.frombuffer(whole.encode(), np.uint8)[np.repeat(letter, width)]
    ends = np.append(0, np.cumsum(width[letter], dtype=np.int32))
    at = np.append(ends[np.flatnonzero(begins[letter])], len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
    doc = np.searchsorted(np.cumsum(sizes), np.flatnonzero(begins), "right")
    both = np.unique(doc * max(1, len(found.dictionary)) + found.indices.to_numpy())
    return found.dictionary, np.bincount(both % max(1, len(found.dictionary)), minlength=len(found.dictionary))


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _LETTERS[0]


def learned(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, frozenset[str]]:
    """The character model of all texts, and the words, of ``LONGEST`` letters at most, that ``KNOWN_SHARE`` of all texts know.

    Of such words there are fewer than a text has words on average divided by KNOWN_SHARE, whatever the number of texts.
    """
    least = max(KNOWN_TEXTS, math.ceil(KNOWN_SHARE * df.count()))
    counts = written(corpus_counts(df, text_col).where(F.col("word").isNull() | (F.col("n") >= least) & (F.length("word") <= LONGEST)), "corpus")
    cells = counts.where("word is null").toArrow()
    known = frozenset(counts.where("word is not null").select("word").toArrow().column("word").to_pylist())
    removed(counts)
    return log_model(cells.column("cell").to_numpy(), cells.column("n").to_numpy()), known


def log_model(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log P(third | first two), interpolated with the shorter contexts."""
    n = np.zeros(CLASSES**3)
    n[cells] = counts
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    uni = n.sum((0, 1)) + 1
    uni = uni / uni.sum()
    bi = n.sum(0)
    bi = (bi + 5 * uni) / (bi.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * bi[None]) / (n.sum(2, keepdims=True) + 5))


#: By code point of the basic plane: 1 for a letter or digit, 2 for a sign that may stand for a letter, 4 for a separator of singles.
SINGLES = np.array([(1 if chr(c).isalnum() else 0) | 2 * (chr(c) in "@$!|+(€£¢*") | 4 * (chr(c).isspace() or chr(c) in ".,'’_/:;~\\=-") for c in range(0x10000)], np.uint8)


def spaced_out(text: str) -> bool:
    """Whether ``SPACED`` can match at all: a single between separators, and on both sides, up to three separators away, another one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 5:
        return False
    if points.max() > 0xFFFF:
        return True
    kind = np.concatenate([np.zeros(4, np.uint8), SINGLES[points], np.zeros(4, np.uint8)])
    single, word, apart = (kind & 3) > 0, (kind & 1) > 0, (kind & 4) > 0
    lead, tail = single.copy(), single.copy()
    lead[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    n = len(points)
    at = lambda x, k: x[4 + k : 4 + k + n]
    left = at(apart, -1) & (at(lead, -2) | at(apart, -2) & (at(lead, -3) | at(apart, -3) & at(lead, -4)))
    right = at(apart, 1) & (at(tail, 2) | at(apart, 2) & (at(tail, 3) | at(apart, 3) & at(tail, 4)))
    return bool((at(single, 0) & left & right).any())


class Restorer:
    """Decoding of suspicious stretches by known words, or else by Viterbi under a trigram model."""

    def __init__(self, model: np.ndarray, known: frozenset[str] = frozenset()):
        self.model, self.known = model.tolist(), known
        self.prefixes = {w[:k] for w in known for k in range(len(w) + 1)}
        self.parts = Cache()

    def lattice(self, text: str) -> list[list[tuple[str, float]]]:
        """Choices (string, log probability) of each character."""
        out, run, last = [], 0, ""
        spaced = SPACED.fullmatch(text) is not None
        for i, c in enumerate(text):
            inside = 0 < i < len(text) - 1
            if c.isalpha() or c in LEET or not spaced:  # separators of spaced letters don't part equal ones
                run, last = run + 1 if c == last else 0, c
            if c.isalpha():
                less = FURTHER if run > 1 else SECOND
                out.append([(c, math.log(1 - less)), ("", math.log(less))] if run else [(c, 0.0)])
            elif spaced and c not in LEET:
                out.append([(" ", SEPARATOR), ("", math.log(1 - math.exp(SEPARATOR)))])
            else:
                letters = LEET.get(c, "")
                out.append([(x, AS_LETTER - math.log(len(letters))) for x in letters] + [(" ", INNER if inside else OUTER)] + [("", LEFT_OUT)] * inside)
        return out

    @staticmethod
    def undoubled(text: str) -> list[tuple[float, str]] | None:
        """The paths of a lattice of letters alone, (log probability, string): each run of equal letters shortened or not. None for many."""
        paths = [(0.0, "")]
        for m in RUNS.finditer(text):
            c, n = m[1], len(m[0])
            if n == 1:
                paths = [(p, s + c) for p, s in paths]
                continue
            # Of the ways to keep k letters the best keeps the second one and drops further ones.
            ways = [(math.log(SECOND) + (n - 2) * math.log(FURTHER), c)] + [(math.log(1 - SECOND) + (k - 2) * math.log(1 - FURTHER) + (n - k) * math.log(FURTHER), c * k) for k in range(2, n + 1)]
            paths = [(p + q, s + t) for p, s in paths for q, t in ways]
            if len(paths) > MOST_PATHS:
                return None
        return paths

    def decode(self, text: str) -> str:
        """The most probable reading of a lower-case stretch; of equal ones the first in the order of the choices."""
        model = self.model
        if text.isalpha() and (paths := self.undoubled(text)):
            best = (-math.inf, text)
            for score, s in paths:
                a = b = 0
                for c in s:
                    k = ord(c) - 96 if "a" <= c <= "z" else OTHER
                    score += model[a][b][k]
                    a, b = b, k
                score += model[a][b][0]
                if score > best[0]:
                    best = (score, s)
            return best[1]
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for choices in [*self.lattice(text), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for x, p in choices:
                    if x:
                        c = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else OTHER
                        if c == 0 and b == 0:
                            to, s, way = (a, b), score + p, path  # boundaries merge
                        else:
                            to, s, way = (b, c), score + p + model[a][b][c], (x, path)
                    else:
                        to, s, way = (a, b), score + p, path
                    if to not in new or s > new[to][0]:
                        new[to] = (s, way)
            best = new
        path, out = max(best.values(), key=lambda x: x[0])[1], []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out)).strip()

    def known_reading(self, text: str) -> str | None:
        """The most probable reading of a lower-case stretch as known words, None without one; all paths through them are held."""
        if text.isalpha() and (paths := self.undoubled(text)):
            return max(((p + self.cost(s), s) for p, s in paths if s in self.known), key=lambda x: x[0], default=(0.0, None))[1]
        best: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
        for choices in self.lattice(text):
            new: dict[str, tuple[float, tuple | None]] = {}
            for word, (score, done) in best.items():
                for x, p in choices:
                    to, before = word + x, done
                    if x == " ":
                        if word and word not in self.known:
                            continue
                        to, before, p = "", (word, done) if word else done, p + self.cost(word)
                    if to in self.prefixes and (to not in new or score + p > new[to][0]):
                        new[to] = (score + p, before)
            best = new
        ends = [(p + self.cost(w), (w, done) if w else done) for w, (p, done) in best.items() if w in self.known or not w]
        path, out = max(ends, key=lambda x: x[0])[1] if ends else None, []
        while path:
            out.append(path[0])
            path = path[1]
        return " ".join(reversed(out)) or None

    @staticmethod
    def cost(word: str) -> float:
        return ONE_WORD * bool(word) + ONE_LETTER * (len(word) == 1)

    def spaced(self, stretch: str) -> str:
        """Single characters read as words; without two letters only known words are taken."""
        found = self.known_reading(stretch)
        if found is None:
            found = self.decode(stretch) if sum(map(str.isalpha, stretch)) > 1 else stretch
        return f" {found} "

    def read(self, chunk: str) -> str:
        """A lower-case chunk between blanks, decoded where it is suspicious."""
        plain = chunk.strip(PLAIN_EDGES)
        if plain.isalpha() and (plain in self.known or not DOUBLED.search(plain)):
            return chunk  # none of the patterns below fits
        if ODD.search(chunk):
            if (tailed := TAILED.fullmatch(chunk)) and not DOUBLED.search(tailed[1]):
                return tailed[1]  # the signs can be boundaries or nothing, the letters only themselves
            core = chunk.strip(EDGES) if self.known else ""
            return core and (core in self.known and core or self.known_reading(core) or self.known_reading(chunk)) or self.decode(chunk)
        if self.known and SIGNS.fullmatch(chunk.strip(".,;:?'’\"")):
            words = {""}
            for c in chunk.strip(".,;:?'’\""):
                words = {w + x for w in words for x in LEET[c] if w + x in self.prefixes}
            return min((w for w in words if w in self.known), default=chunk)
        if self.known and DOUBLED.search(chunk):
            return WORD.sub(lambda m: self.undoubled_word(m[0]), chunk)
        return chunk

    def undoubled_word(self, word: str) -> str:
        """The reading of a word of letters: itself where it is known or has no letter twice.

        With one letter twice there are two paths; they differ in the trigrams that hold the second letter alone.
        """
        first = None if word in self.known else DOUBLED.search(word)
        if not first:
            return word
        at = first.end()
        if word[at : at + 1] == first[1] or DOUBLED.search(word, at):
            return self.known_reading(word) or self.decode(word)
        less = word[: at - 1] + word[at:]
        if less in self.known:
            return less
        b, c, r = (ord(x) - 96 if "a" <= x <= "z" else OTHER if x else 0 for x in (word[at - 3 : at - 2] if at > 2 else "", first[1], word[at : at + 1]))
        m = self.model
        return word if math.log(1 - SECOND) + m[b][c][c] + m[c][c][r] > math.log(SECOND) + m[b][c][r] else less

    def part(self, chunk: str) -> tuple[str, bool, bool, bool, str]:
        """(word, unknown, may go on, may follow, reading) of a chunk as a part of a split word; no word where it is more than one."""
        found = self.parts.get(chunk)
        if found is None:
            reading = chunk if chunk in self.known else self.read(chunk)
            word = reading.strip(EDGES)
            if not word.isalpha():
                word = ""
            found = (word, bool(word) and word not in self.known, chunk[-1:] not in EDGES, chunk[:1] not in EDGES, reading)
            self.parts.put(chunk, found, 3 * len(chunk))
        return found

    def chunks(self, text: str) -> list[str]:
        """What stands between blanks in a lower-case text after single characters and split words are put together."""
        chunks = SPACED.sub(lambda m: self.spaced(m[0]), text).split()
        known = self.known
        if not known:
            return chunks
        held, prefixes = self.parts.get, self.prefixes
        parts = {c: held(c) or self.part(c) for c in set(chunks)}
        unknown = {c for c, p in parts.items() if p[1] and c not in known}
        if not unknown:
            return chunks
        out, i, n, last = [], 0, len(chunks), -PARTS
        near = [False] * n
        for k, c in enumerate(chunks):
            if c in unknown:
                for j in range(max(0, k - PARTS + 1, last), k + 1):
                    near[j] = True
                last = k
        while i < n:
            took = 1
            word, odd, more, _, _ = parts[chunks[i]]
            if near[i] and more and word in prefixes:
                joined, best = word, None
                for k in range(i + 1, min(n, i + PARTS)):
                    word, other, after, start, _ = parts[chunks[k]]
                    if not (joined and word and more and start):
                        break
                    joined, odd, more = joined + word, odd or other, after
                    if odd and len(joined) >= LEAST_JOINED and joined in known:
                        best, took = joined, k - i + 1
                    elif joined not in prefixes:
                        break
                if best:
                    out.append(best)
            if took == 1:
                out.append(chunks[i])
            i += took
        return out

    def joined(self, codes: np.ndarray, doc: np.ndarray, chunks: list[str], words: list[str], plain: list[bool], odd: list[bool]) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """As ``chunks`` puts split words together, for a block of texts: which places stay, and (text, word) of the words made.

        ``codes`` are places in the list of the block's distinct chunks, ``doc`` the text that each belongs to; ``words`` are what
        the plain chunks hold, ``odd`` says which of these isn't known. Both lists get what the others hold.
        """
        kept, more = np.ones(len(codes), bool), []
        if not self.known or not len(codes):
            return kept, more
        known, prefixes = self.known, self.prefixes
        for i, p in enumerate(plain):
            if not p:
                words[i], odd[i] = self.part(chunks[i])[:2]
        strange = np.array([o and c not in known for o, c in zip(odd, chunks, strict=True)])[codes]
        if not strange.any():
            return kept, more
        near = strange.copy()
        for k in range(1, PARTS):
            near[:-k] |= strange[k:] & (doc[k:] == doc[:-k])
        goes_on = [c[-1:] not in EDGES for c in chunks]
        follows = np.array([w != "" and c[0] not in EDGES for c, w in zip(chunks, words, strict=True)])[codes]
        same = np.append(doc[1:] == doc[:-1], False)
        ready = near & same & np.append(follows[1:], False) & np.array([g and w in prefixes and w != "" for g, w in zip(goes_on, words, strict=True)])[codes]
        last, n, place, text, open_ = 0, len(codes), codes.tolist(), doc.tolist(), follows.tolist()
        for i in np.flatnonzero(ready).tolist():
            if i < last:
                continue
            at, best, took = place[i], None, 1
            whole, some, goes = words[at], odd[at], True
            for k in range(i + 1, min(n, i + PARTS)):
                if text[k] != text[i] or not (goes and open_[k]):
                    break
                at = place[k]
                whole, some, goes = whole + words[at], some or odd[at], goes_on[at]
                if some and len(whole) >= LEAST_JOINED and whole in known:
                    best, took = whole, k - i + 1
                elif whole not in prefixes:
                    break
            if best:
                kept[i : i + took] = False
                more.append((text[i], best))
                last = i + took
        return kept, more

    def restore(self, text: str) -> str:
        """A text with its suspicious stretches decoded, lower-cased; blanks between the others become single spaces."""
        return " ".join(" ".join(self.read(w) for w in self.chunks(text.lower())).split())


@dataclass
class Model:
    """Character model, features (words as ``=word``, beginnings as they are) with weights, bias, and the corpus's known words."""

    trigrams: np.ndarray
    features: dict[str, int]
    weights: np.ndarray
    bias: float
    known: frozenset[str] = frozenset()


class Scorer:
    """Features and scores of texts; chunks between blanks are restored and looked up once and kept in a bounded cache."""

    def __init__(self, restorer: Restorer, features: dict[str, int] | None):
        self.restorer, self.known = restorer, features
        self.heads = None if features is None else {f[: BEGINNINGS[0]] for f in features if f[0] != "="}
        self.stems: dict[str, list[tuple[str, int]]] = {}
        for f, i in (features or {}).items():
            if f[0] != "=" and len(f) in BEGINNINGS:
                self.stems.setdefault(f[: BEGINNINGS[0]], []).append((f, i))
        self.wholes = None if features is None else {f[1:] for f in features if f[0] == "="}
        self.cache = Cache()

    def names(self, chunk: str) -> tuple:
        """Features of the words that a chunk is restored to: all their names, or the numbers of the known ones."""
        part = self.restorer.parts.get(chunk)
        reading = part[4] if part else self.restorer.read(chunk)
        heads, known = self.heads, self.known
        words = WORD.findall(reading)
        found = [f for w in words for f in ("=" + w, *(w[:k] for k in BEGINNINGS if len(w) >= k and (heads is None or w[: BEGINNINGS[0]] in heads)))]
        return tuple(found) if known is None else tuple(known[f] for f in found if f in known)

    def count(self, text: str) -> Counter:
        """How often each feature is in the text."""
        cache, out = self.cache, Counter()
        cache.trim()
        self.restorer.parts.trim()
        for chunk, n in Counter(self.restorer.chunks(text.lower())).items():
            found = cache.get(chunk)
            if found is None:
                found = self.names(chunk)
                cache.put(chunk, found, len(chunk) + (8 if self.known is not None else 80) * len(found))
            for f in found:
                out[f] += n
        return out


    def scores(self, texts: list[str], model: Model) -> np.ndarray:
        """As ``probability`` of ``count`` for each text of a block: what is between blanks is looked at once a block."""
        restorer, stems, wholes = self.restorer, self.stems, self.wholes
        self.cache.trim()
        restorer.parts.trim()
        tokens = []
        for text in texts:
            text = text.lower()
            if spaced_out(text):
                text = SPACED.sub(lambda m: restorer.spaced(m[0]), text)
            tokens.append(text.split())
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        doc = np.repeat(np.arange(len(tokens)), sizes)
        found = pa.array([t for some in tokens for t in some], pa.string()).dictionary_encode()
        codes, chunks = found.indices.to_numpy(), found.dictionary.to_pylist()
        words, doubled, known = [c.strip(PLAIN_EDGES) for c in chunks], DOUBLED.search, restorer.known
        seen = list(map(known.__contains__, words))
        plain = [w.isalpha() and (k or not doubled(w)) for w, k in zip(words, seen, strict=True)]  # nothing to restore in one word
        bare = list(words)
        kept, more = restorer.joined(codes, doc, chunks, words, plain, [not k for k in seen])
        names = [() if p and w[: BEGINNINGS[0]] not in stems and w not in wholes else self.word_names(w) if p else self.known_names(c) for c, w, p in zip(chunks, bare, plain, strict=True)]
        held = np.array([bool(n) for n in names] or [False])
        at = np.flatnonzero(kept & held[codes]) if len(codes) else np.zeros(0, np.int64)
        width = np.fromiter(map(len, names), np.int64, len(names))
        start = np.append(0, np.cumsum(width))
        flat = np.fromiter((f for n in names for f in n), np.int64, int(start[-1]))
        many = width[codes[at]] if len(at) else np.zeros(0, np.int64)
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        features, of = flat[np.repeat(start[codes[at]], many) + inside] if len(at) else flat[:0], np.repeat(doc[at], many)
        extra = [(d, f) for d, word in more for f in self.known_names(word)]
        if extra:
            of, features = np.append(of, [d for d, _ in extra]), np.append(features, [f for _, f in extra])
        size = max(1, len(model.weights))
        both, n = np.unique(of * size + features, return_counts=True)
        z = model.bias + np.bincount(both // size, model.weights[both % size] * (np.minimum(n, LEVELS) / LEVELS), len(texts)) if len(both) else np.full(len(texts), model.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))

    def word_names(self, word: str) -> tuple:
        """Numbers of the known features of one word."""
        whole = self.known.get("=" + word)
        found = tuple(i for f, i in self.stems.get(word[: BEGINNINGS[0]], ()) if word.startswith(f))
        return found if whole is None else (whole, *found)

    def known_names(self, chunk: str) -> tuple:
        found = self.cache.get(chunk)
        if found is None:
            found = self.cache.put(chunk, names := self.names(chunk), len(chunk) + 8 * len(names))
        return found


def listed(counts: list[Counter]) -> pa.ListArray:
    """An array of (f, n) for each counter, without a Python object for each of its entries."""
    ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
    pairs = pa.StructArray.from_arrays([pa.array([f for c in counts for f in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int32())], ["f", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def feature_counts(sample: DataFrame, trigrams: np.ndarray, known: frozenset[str]) -> DataFrame:
    """(_doc, _label, features array of (f, n)) of each row (_doc, _text, _label): its text restored, and how often each feature is in it."""
    sent, number = sample.sparkSession.sparkContext.broadcast((trigrams, known)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held_by_worker(("toxicity", number), lambda: Scorer(Restorer(*sent.value), None))
        for batch in slices(batches, most_bytes=COUNTED_BYTES):
            found = listed([scorer.count(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], ["_doc", "_label", "features"])
        batch = found = None
        released()

    counted = written(sample.select("_doc", "_text", "_label").mapInArrow(run, f"_doc {sample.schema['_doc'].dataType.simpleString()}, _label int, features array<struct<f: string, n: int>>"), "features")
    sent.destroy()
    return counted


def fit(counted: DataFrame, trigrams: np.ndarray, known: frozenset[str], kept: int = 1500, penalty: float = 1e-3) -> Model:
    """Fit on counted rows, at most a bounded sample: of the features in three toxic texts or more the ``kept`` with the largest
    chi-square, then logistic regression.

    The bias is moved so that a score of 0.5 is the cutoff with the best F1 among rows that two half fits have not seen. Without
    both labels the model has no features and its score is the labels' smoothed mean.
    """
    n = {r["_label"]: r["count"] for r in counted.groupBy("_label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    mean = (n1 + 1) / (n1 + n0 + 2)
    bias = math.log(mean / (1 - mean))
    if not n1 or not n0:
        return Model(trigrams, {}, np.zeros(0), bias, known)
    rows = counted.select("_doc", "_label", F.explode("features").alias("x")).select("_doc", "_label", "x.f", "x.n")
    both = rows.groupBy("f").agg(F.sum("_label").alias("a"), F.sum(1 - F.col("_label")).alias("b")).where("a >= 3")
    chi = F.pow(F.col("a") * n0 - F.col("b") * n1, F.lit(2)) / ((F.col("a") + F.col("b")) * (n1 + n0 - F.col("a") - F.col("b")) + 1)
    names = [r["f"] for r in both.orderBy(F.desc(chi), "f").limit(kept).collect()]
    features = {f: i for i, f in enumerate(names)}
    at = counted.sparkSession.createDataFrame(list(features.items()), "f string, i int") if features else None
    docs = counted.select("_doc", "_label").orderBy(F.xxhash64("_doc"), "_doc").toArrow()  # ids and labels of the sample
    place = {d: i for i, d in enumerate(docs.column("_doc").to_pylist())}
    y = docs.column("_label").to_numpy().astype(float)
    x = np.zeros((len(y), len(names)), np.float32)
    if at is not None:
        for d, i, k in zip(*(c.to_pylist() for c in rows.join(F.broadcast(at), "f").select("_doc", "i", "n").toArrow().columns), strict=True):
            x[place[d], i] = min(k, LEVELS) / LEVELS
    w = logistic(x, y, bias, penalty)
    return Model(trigrams, features, w[:-1], float(w[-1]) - cutoff(x, y, bias, penalty), known)


def logistic(x: np.ndarray, y: np.ndarray, bias: float, penalty: float, rounds: int = 300) -> np.ndarray:
    """Weights and bias (last) of a logistic regression by full-batch Adam."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    w[-1] = bias
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30))) - y
        g = np.append(error.astype(np.float32) @ x / len(y) + penalty * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def cutoff(x: np.ndarray, y: np.ndarray, bias: float, penalty: float) -> float:
    """The logit that parts unseen rows with the best F1, from fits on either half; at most that of 0.5, which stays where a half has one label only."""
    z, half = np.zeros(len(y)), np.arange(len(y)) % 2 == 0
    for some in (half, ~half):
        if not 0 < y[some].sum() < some.sum():
            return 0.0
        w = logistic(x[some], y[some], bias, penalty)
        z[~some] = x[~some] @ w[:-1] + w[-1]
    order = np.argsort(-z, kind="stable")
    hit, last = np.cumsum(y[order]), np.append(np.diff(z[order]) != 0, True)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(y) + 1) + y.sum()), 0)
    k = int(f1.argmax())
    below = z[order][k + 1] if k + 1 < len(y) else z[order][k] - 1
    return float(min(0.0, (z[order][k] + below) / 2))


def probability(model: Model, counts: Counter) -> float:
    z = model.bias + sum(model.weights[f] * (min(n, LEVELS) / LEVELS) for f, n in sorted(counts.items()))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: int | None) -> bool:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is never learned from."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(df: DataFrame, labels: DataFrame, fit_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Character model of all texts, and a classifier of at most ``fit_rows`` labelled rows that aren't held out.

    The sample is a bound of what is learned from: the ids with the least hash, one text of each (that with the least MD5). Null
    texts, ids and labels are left out of it. Tasks restore and count the texts; the driver holds the counts of the features kept.
    """
    trigrams, known = learned(df, text_col)
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where((F.crc32(F.col("_id").cast("string")) % 5 != 0) & F.col("_label").isin(0, 1))
    given = given.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = df.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("_text")).where("_text is not null").join(F.broadcast(given), F.col("_doc") == F.col("_id"))
    sample = rows.groupBy("_doc", "_label").agg(F.min_by("_text", F.md5("_text")).alias("_text"))
    counted = feature_counts(sample, trigrams, known)
    model = fit(counted, trigrams, known)
    removed(counted)
    return model


def scorer_of(number: str, model: Model) -> Scorer:
    """The worker's scorer of this model; it outlives a task, its cache is bounded."""
    return held_by_worker(("toxicity", number), lambda: Scorer(Restorer(model.trigrams, model.known), model.features))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted[, restored]) of every row.

    Null text is empty; an empty text gets the score of no features. Null ids, repeated rows and extra columns do no harm: one
    row out a row in, from the text alone. Texts are scored whole. An empty table gives an empty result.
    """
    sent, number = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int" + ", restored string" * with_text
    names = [id_col, "held_out", "score", "predicted", "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(number, sent.value)
        for batch in slices(batches, most_bytes=SCORED_BYTES):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            p = scorer.scores(texts, sent.value)
            columns = [batch.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            if with_text:
                columns.append(pa.array([scorer.restorer.restore(t) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return df.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores under ``limit``; null text is scored as empty."""
    sent, number, at = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(number, sent.value)
        for batch in slices(batches, most_bytes=SCORED_BYTES):
            clean = scorer.scores([t or "" for t in batch.column(at).to_pylist()], sent.value) < limit
            yield batch.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def judge(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labels that aren't held out and score every row."""
    return score(df, train(df, labels, **options))

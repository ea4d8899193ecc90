"""Similarity join of documents by the Jaccard coefficient of their word n-grams.

Method (vertical partitioning): all n-grams have one global order, rare ones first; it is cut into fragments. Documents that may
be linked share one of their first n-grams (the prefix filter: enough of them that no link can be missed). For candidate pairs
the overlap is counted fragment by fragment, each on its own, and the partial overlaps are summed per pair.

Texts with equal n-gram sets form one class and are compared once. Classes that share a first n-gram meet where the places of
that n-gram in both, and their signatures, still allow a link. In a large bucket all classes are first compared with one hub,
the one with the fewest n-grams of its own; what then belongs to one component needs no further pair, and after some rounds the
pairs left between different components are joined exactly. So a group of thousands of near copies costs a few comparisons a
member, and no component is missed. ``similar_pairs`` gives every link instead.

N-grams are 64-bit hashes, classes 128-bit hashes of sorted n-gram sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sharing import removed, written
from .common import TEXT_BYTES, held_by_worker, returning, slices, text_of

#: N-grams in at least this many texts, and words at least so frequent, are known to the order by an estimate of their number.
FREQUENT = 32
#: Frequent n-grams, and words, that workers get; the least number rises so that no more can exist.
FREQUENT_KEPT = 500_000
#: N-grams or words of a batch of texts in which repeated ones are counted together.
COUNTED_TOGETHER = 2_000_000
#: Fragments of the global order: so many ranges of the rare n-grams, and one of the frequent ones.
RARE_FRAGMENTS = 8
#: Classes of a bucket up to which all its pairs are candidates at once.
SMALL_BUCKET = 8
HUB_ROUNDS = 4
#: Classes of a large bucket that meet under one key in the exact rest.
BLOCK = 512
#: Classes of a bucket from which on further hubs are tried before the exact rest.
HUB_BUCKET = 64
#: Pairs of one class that meet its signature or n-grams under one key; those of a hub are dealt to copies of it.
DEALT = 1024
#: Least and most bits of a set's signature, by which most candidate pairs are ruled out before any n-grams move.
LEAST_BITS, MOST_BITS = 512, 1 << 17
#: Rows up to which ids may be broadcast.
BROADCAST_ROWS = 200_000


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams_of(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams at each place; one of all words where they are fewer."""
    k = min(n, len(w))
    if not k:
        return np.empty(0, np.int64)
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def gram_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    return np.unique(grams_of(word_hashes(text), n))


def signature(grams: np.ndarray) -> list[int]:
    """Bits, a power of two and at least two a hash: bit k says whether an odd number of the set's hashes end in k."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(grams)).bit_length()))
    odd = np.bincount(grams & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def most_common(na: Column, nb: Column, a: Column, b: Column) -> Column:
    """The most that two sets of these sizes and signatures can have in common: each bit that differs is a hash of one alone.

    A signature of half as many bits is that of twice as many with its halves put together; longer ones are folded once. Sets
    whose signatures differ more in length aren't held against each other.
    """

    def folded(x: Column, other: Column) -> Column:
        half = F.size(x) / 2
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, F.lit(1), half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    differ = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))
    return F.floor((na + nb - differ) / 2)


def class_key(grams: np.ndarray) -> bytes | None:
    """128-bit hash of a set; none for the empty set."""
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


class Counts:
    """Estimates of how often frequent hashes occur; 0 for the others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        at = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[at], counts[at]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)


class Order:
    """The global order of n-grams: by the estimated number of texts where it is known, then by how frequent the words are, then
    by hash. N-grams of rare words come first and passages of many texts last, so first n-grams are seldom shared by chance."""

    def __init__(self, grams: Counts, words: Counts, n: int):
        self.grams, self.words, self.n = grams, words, n
        self.most = n * int(8 * np.log2(1 + int(words.counts.max(initial=1)))) + 1

    def placed(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams sorted by hash, estimated numbers, scores of their words) of a text."""
        w = word_hashes(text)
        grams, first = np.unique(grams_of(w, self.n), return_index=True)
        if not len(grams):
            return grams, grams, grams
        score = np.concatenate(([0], np.cumsum((8 * np.log2(1 + self.words.of(w.view(np.int64)))).astype(np.int64))))
        k = min(self.n, len(w))
        return grams, self.grams.of(grams), (score[k:] - score[:-k])[first]

    def prefix(self, grams: np.ndarray, number: np.ndarray, score: np.ndarray, num: int, den: int) -> np.ndarray:
        """The first n-grams, one of which every set with a Jaccard coefficient of num / den or more has in its own prefix."""
        size = len(grams) - -(-num * len(grams) // den) + 1 if len(grams) else 0
        return grams[np.lexsort((grams, score, number))[:size]]

    def fragments(self, text: str) -> list[tuple[int, np.ndarray]]:
        """(number, n-grams) of the fragments of the global order that hold some of the text's."""
        grams, number, score = self.placed(text)
        part = np.where(number > 0, RARE_FRAGMENTS, np.minimum(score * RARE_FRAGMENTS // self.most, RARE_FRAGMENTS - 1))
        return [(k, grams[part == k]) for k in np.unique(part).tolist()]


def frequent(texts: DataFrame, n: int) -> tuple[Counts, Counts]:
    """Frequent n-grams and frequent words with estimates of their numbers, from all texts.

    Tasks count what repeats within a batch; the sums are close for what is frequent, and any estimate gives a valid order. At
    most FREQUENT_KEPT of either can reach the least number, which grows with the sum of all counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(held, word):
            hashes = np.concatenate(held)
            held.clear()
            hashes.sort()  # in place, as np.unique would copy them twice
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            counts = np.diff(first, append=len(hashes))
            kept = counts > (FREQUENT // 8 if word else 1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), word)), pa.array(hashes[first[kept]]), pa.array(counts[kept].astype(np.int64))], ["word", "hash", "n"])

        held_by_worker(("n-gram join",), lambda: None)  # what another operator kept goes
        held: tuple[list, list] = ([], [])
        size = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                w = word_hashes(text)
                held[0].append(np.unique(grams_of(w, n)))
                held[1].append(w.view(np.int64))
                size += len(w)
                if size > COUNTED_TOGETHER:
                    yield from (repeated(h, bool(k)) for k, h in enumerate(held))
                    held, size = ([], []), 0
        if held[0]:
            yield from (repeated(h, bool(k)) for k, h in enumerate(held))

    counts = texts.select("text").mapInArrow(returning(run), "word boolean, hash long, n long").groupBy("word", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = written(counts, "frequent")
    out = []
    for word in (False, True):
        mine = counts.where(F.col("word") == word)
        total = mine.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        kept = mine.where(F.col("n") >= max(FREQUENT, -(-total // FREQUENT_KEPT))).select("hash", "n").toArrow()
        out.append(Counts(kept.column("hash").to_numpy(), kept.column("n").to_numpy()))
    removed(counts)
    return out[0], out[1]


def dealt(pairs: DataFrame) -> DataFrame:
    """(hub, copies) of the classes with over DEALT pairs, for ``met``: one in so many pairs at most."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("hub")).groupBy("hub").agg(F.count("*").alias("n"))
    return written(ends.where(F.col("n") > DEALT).select("hub", F.ceil(F.col("n") / DEALT).cast("int").alias("copies")), "hubs")


def met(pairs: DataFrame, x: str, rows: DataFrame, hubs: DataFrame, on: list[str]) -> DataFrame:
    """``pairs`` joined on ``on`` with ``rows``, both with the class in column ``x``; pairs of a hub meet copies of its rows."""
    few = F.broadcast(hubs) if hubs.count() <= BROADCAST_ROWS else hubs
    copies = F.coalesce("copies", F.lit(1))
    other = "a" if x == "b" else "b"
    left = pairs.join(few.withColumnRenamed("hub", x), x, "left").withColumn("_copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies")
    right = rows.join(few.withColumnRenamed("hub", x), x, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return left.join(right, [*on, "_copy"]).drop("_copy")


def components(links: DataFrame) -> DataFrame:
    """(cid, component): the least key reachable, for the keys in ``links`` (a, b), by least neighbours and pointer jumps."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = kept = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "cid"), "labels")
    while True:
        near = edges.join(labels.select(F.col("cid").alias("b"), "component"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("component").alias("near"))
        nearer = labels.join(near, "cid").select("cid", F.least("component", "near").alias("via"), F.col("component").alias("old"))
        jumped = written(nearer.join(labels.select(F.col("cid").alias("via"), F.col("component").alias("to")), "via").select("cid", "old", F.least("via", "to").alias("component")), "labels")
        removed(kept)
        labels, kept = jumped.select("cid", "component"), jumped
        labels._facetlake_folder = kept._facetlake_folder
        if not jumped.where("component <> old").limit(1).count():
            removed(edges)
            return labels


class Join:
    """One similarity join over a table of documents.

    docs: (doc_id, text_md5, n_shingles, key) of every row; classes: (key, cid, one, least, n, rare, signature, prefix) of the
    distinct n-gram sets, with the id and digest of one of its documents and the least id.
    """

    def __init__(self, df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str):
        self.n, self.num, self.den = n, num, den
        self.texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
        self.id_type = df.schema[id_col].dataType.simpleString()
        order = Order(*frequent(self.texts, n), n)
        self.order = df.sparkSession.sparkContext.broadcast(order)
        sets = written(self.described(), "sets")
        one = F.min(F.struct("doc_id", "text_md5")).alias("one")
        first = [F.first(c).alias(c) for c in ("n_shingles", "rare", "signature", "prefix")]
        classes = sets.where("key is not null").groupBy("key").agg(one, F.min("doc_id").alias("least"), *first).withColumnRenamed("n_shingles", "n")
        # The least id leaves nulls aside, the least struct doesn't.
        self.classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.docs = written(sets.select("doc_id", "text_md5", "n_shingles", "key"), "docs")
        removed(sets)
        self.parts: list[DataFrame] = []

    def described(self) -> DataFrame:
        """(doc_id, text_md5, n_shingles, key, rare, prefix, signature) of every document; rare: n-grams not known as frequent."""
        num, den, order = self.num, self.den, self.order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most_bytes=TEXT_BYTES):
                placed = [order.value.placed(t) for t in batch.column(2).to_pylist()]
                sets = [x[0] for x in placed]
                first = [order.value.prefix(*x, num, den) for x in placed]
                prefix = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate([*first, np.empty(0, np.int64)])))
                rare = pa.array([int((x[1] == 0).sum()) for x in placed], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary()), rare, prefix, pa.array([signature(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "text_md5", "n_shingles", "key", "rare", "prefix", "signature"])

        return self.texts.select("doc_id", F.md5("text"), "text").mapInArrow(returning(run), f"doc_id {self.id_type}, text_md5 string, n_shingles long, key binary, rare long, prefix array<long>, signature array<long>")

    def buckets(self) -> DataFrame:
        """(gram, cid, n, at, rare, m): classes with an n-gram in their prefix, at that place, that m > 1 classes have in theirs.

        Left out are places after which too few n-grams follow for a link even with the smallest set of the bucket.
        """
        rows = self.classes.select(F.posexplode("prefix").alias("at", "gram"), "cid", "n", "rare")
        shared = written(rows.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1"), "shared")
        enough = (self.num + self.den) * (F.col("n") - F.col("at")) >= self.num * (F.col("n") + F.col("least"))
        found = written(rows.join(shared, "gram").where(enough).drop("least"), "buckets")
        slim = written(self.classes.drop("prefix"), "classes")
        removed(shared, self.classes)
        self.classes = slim
        return found

    def near(self, a: str, b: str) -> Column:
        """Whether a link is possible if the bucket's n-gram is the first that two classes share: what follows it must suffice.

        Each linked pair has a first common n-gram in both prefixes, so it meets this condition in that n-gram's bucket.
        """
        rest = F.least(F.col(a + "n") - F.col(a + "at"), F.col(b + "n") - F.col(b + "at"))
        return (self.num + self.den) * rest >= self.num * (F.col(a + "n") + F.col(b + "n"))

    def alike(self, a: str, b: str) -> Column:
        """Whether the sizes and signatures of two classes allow a link."""
        na, nb = F.col(a + "n"), F.col(b + "n")
        common = most_common(na, nb, F.col(a + "signature"), F.col(b + "signature"))
        return self.den * common >= self.num * (na + nb - common)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b, na, nb) whose signatures allow a link."""
        found = written(pairs.select("a", "b").distinct(), "pairs")
        hubs = dealt(found)
        ids = written(found.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ids")
        some = self.classes.join(F.broadcast(ids), "cid", "left_semi") if ids.count() <= BROADCAST_ROWS else self.classes
        of = lambda x: some.select(F.col("cid").alias(x), F.col("n").alias(x + "n"), F.col("signature").alias(x + "signature"))
        both = met(met(found, "a", of("a"), hubs, ["a"]), "b", of("b"), hubs, ["b"])
        out = written(both.where(self.alike("a", "b")).select("a", "b", F.col("an").alias("na"), F.col("bn").alias("nb")), "possible")
        removed(found, hubs, ids)
        return out

    def pairs_within(self, buckets: DataFrame) -> DataFrame:
        """(a, b) of the classes of different components that meet in a small bucket and may be linked; a pair may come several times."""
        a, b = (buckets.select("gram", *(F.col(c).alias(x + c) for c in ("cid", "n", "at", "component"))) for x in "ab")
        joined = a.join(b.withColumnRenamed("gram", "bgram"), (F.col("gram") == F.col("bgram")) & F.expr("acid < bcid and acomponent <> bcomponent") & self.near("a", "b"))
        return joined.select(F.col("acid").alias("a"), F.col("bcid").alias("b"))

    def pairs_in_blocks(self, buckets: DataFrame) -> DataFrame:
        """As ``pairs_within`` for buckets of any size, with signatures held against each other at once.

        The classes of a bucket are dealt to blocks of about BLOCK; each pair of blocks has a key of its own, so that no key is
        hot: a class meets as many keys as its bucket has blocks.
        """
        sizes = written(buckets.groupBy("gram").agg((1 + F.floor(F.count("*") / BLOCK)).cast("int").alias("blocks")), "sizes")
        rows = buckets.join(sizes, "gram").join(self.classes.select("cid", "signature"), "cid").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))

        def side(x: str, low: Column, high: Column) -> DataFrame:
            """Rows once for each pair of blocks (i <= j); ``x`` a: own block first, b: own block last."""
            other = F.explode(F.sequence(low, high))
            return rows.select(F.col("gram").alias(x + "gram"), F.col("block").alias(x + "own"), other.alias(x + "other"), *(F.col(c).alias(x + c) for c in ("cid", "n", "at", "component", "signature")))

        a, b = side("a", F.col("block"), F.col("blocks") - 1), side("b", F.lit(0), F.col("block"))
        same = F.expr("agram = bgram and aown = bother and aother = bown and acomponent <> bcomponent and (aown < bown or acid < bcid)")
        return a.join(b, same & self.near("a", "b") & self.alike("a", "b")).select(F.least("acid", "bcid").alias("a"), F.greatest("acid", "bcid").alias("b"))

    def segments(self, cids: DataFrame) -> DataFrame:
        """(cid, fragment, grams) of the distinct classes, from the text of one of their documents."""
        n, order = self.n, self.order
        one = written(self.classes.join(cids, "cid", "left_semi").select("cid", "key", F.col("one.doc_id").alias("one"), F.col("one.text_md5").alias("md5")), "one")
        few = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
        texts = self.texts.join(few, F.col("doc_id").eqNullSafe(F.col("one")) & (F.md5("text") == F.col("md5"))).select("cid", "key", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most_bytes=TEXT_BYTES):
                cids, parts, grams = [], [], []
                for cid, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    for part, some in order.value.fragments(text):
                        cids.append(cid)
                        parts.append(part)
                        grams.append(some)
                values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, grams)]), pa.int32()), pa.array(np.concatenate([*grams, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(parts, pa.int32()), values], ["cid", "fragment", "grams"])

        found = written(texts.mapInArrow(returning(run), "cid long, fragment int, grams array<long>"), "segments")
        if found.groupBy("cid", "fragment").count().where("count > 1").limit(1).count():  # repeated rows
            every, found = found, written(found.dropDuplicates(["cid", "fragment"]), "segments")
            removed(every)
        removed(one)
        return found

    def fragments(self, cids: DataFrame) -> DataFrame:
        """(cid, fragment, grams) of some classes; the text of a class is cut once, when it is first needed."""
        asked = new = written(cids, "cids")
        for part in self.parts:
            new = new.join(part.select("cid").distinct(), "cid", "left_anti")
        if not self.parts or new.limit(1).count():
            self.parts.append(self.segments(new))
        removed(asked)
        every = self.parts[0]
        for part in self.parts[1:]:
            every = every.unionByName(part)
        return every

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb; a written table, which goes) that are links, with their overlap: partial overlaps of fragments, summed."""
        parts, hubs, sides = self.fragments(ends(pairs)), dealt(pairs), []

        def parts_of(x: str) -> DataFrame:
            """The fragments of the classes on one side; few are picked before anything is shuffled."""
            cids = written(pairs.select(F.col(x).alias("cid")).distinct(), "cids")
            sides.append(cids)
            mine = parts.join(F.broadcast(cids), "cid", "left_semi") if cids.count() <= BROADCAST_ROWS else parts
            return mine.select(F.col("cid").alias(x), "fragment", F.col("grams").alias("g" + x))

        partial = met(met(pairs, "a", parts_of("a"), hubs, ["a"]), "b", parts_of("b"), hubs, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
        summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        found = written(summed.where(self.den * F.col("common") >= self.num * (F.col("na") + F.col("nb") - F.col("common"))), "links")
        removed(pairs, hubs, *sides)
        return found

    def all_links(self) -> DataFrame:
        """Every link (a, b, na, nb, common) between different classes; there are many within a group of near copies."""
        alone = self.buckets().withColumn("component", F.col("cid"))
        found = self.linked(self.possible(self.pairs_in_blocks(alone)))
        removed(*self.parts)
        return found

    def against_hubs(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs a, b of each bucket's hub with its other classes that may be linked to it; hubs): hubs have the fewest n-grams of their own."""
        hub = F.min(F.struct("rare", (-F.col("n")).alias("less"), "cid", "n", "at", "component")).alias("hub")
        hubs = written(rows.groupBy("gram").agg(hub).select(F.col("gram").alias("hgram"), *(F.col("hub." + c).alias("b" + c) for c in ("cid", "n", "at", "component"))), "hubs")
        spokes = rows.select("gram", *(F.col(c).alias("a" + c) for c in ("cid", "n", "at", "component")))
        met = spokes.join(hubs, F.expr("gram = hgram and acid <> bcid and acomponent <> bcomponent") & self.near("a", "b"))
        return met.select(F.least("acid", "bcid").alias("a"), F.greatest("acid", "bcid").alias("b")), hubs

    @staticmethod
    def unsettled(rows: DataFrame, known: DataFrame) -> DataFrame:
        """The rows of the buckets that have classes of several components, with the components."""
        named = written(rows.drop("component").join(known, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "named")
        mixed = named.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("gram")
        found = written(named.join(mixed, "gram", "left_semi"), "unsettled")
        removed(named)
        return found

    def links(self) -> DataFrame:
        """Links (a, b, na, nb, common) between classes that connect all that is connected.

        This is a connecting part of all links: in large buckets those within a component already known are not looked for.
        """
        buckets = self.buckets().withColumn("component", F.col("cid"))
        large = buckets.where(F.col("m") > SMALL_BUCKET)
        pairs, hubs = self.against_hubs(large)
        found = self.linked(self.possible(self.pairs_within(buckets.where(F.col("m") <= SMALL_BUCKET)).unionByName(pairs)))
        known = components(found)
        rows = large.where(F.col("m") >= HUB_BUCKET)
        for _ in range(HUB_ROUNDS - 1):  # further hubs where many classes meet
            done = hubs.select(F.col("hgram").alias("gram"), F.col("bcid").alias("cid"))
            rows = self.unsettled(rows.join(done, ["gram", "cid"], "left_anti"), known)
            if not rows.limit(1).count():
                break
            pairs, hubs = self.against_hubs(rows)
            new = self.linked(self.possible(pairs))
            if not new.limit(1).count():
                break
            some, found = found, written(found.unionByName(new), "found")
            removed(some, new, known)
            known = components(found)
        rest = self.unsettled(large, known)
        new = self.linked(self.possible(self.pairs_in_blocks(rest)))
        some, found = found, written(found.unionByName(new), "found")
        removed(rest, some, new, *self.parts)
        return found


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def grouped(df: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, n_shingles, component, component_id) of every row; component is a number, null without n-grams."""
    join = Join(df, n, num, den, id_col, text_col)
    known = components(join.links())
    named = join.classes.select("cid", "key", "least").join(known, "cid", "left")
    named = written(named.select("key", "least", F.coalesce("component", "cid").alias("component")), "named")
    join.order.destroy()
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(named.join(ids, "component").select("key", "component", "component_id"), "membership")
    rows = join.docs.select("doc_id", "text_md5", "n_shingles", "key")
    worded = rows.where("key is not null").join(of, "key").select("doc_id", "text_md5", "n_shingles", "component", "component_id")
    found = written(worded.unionByName(rows.where("key is null").select("doc_id", "text_md5", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))), "grouped")
    removed(named, of, join.docs, join.classes)
    return found


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Documents are linked where den * |A & B| >= num * |A | B| for their sets of word n-grams (A-Z lower-cased; a text of fewer
    words is one n-gram); component_id is the least id reachable by links. Null and empty texts, and those of blanks, have no
    n-grams and are linked with nothing. Null ids are linked but never a component's id unless it has no other. Repeated rows
    stay and are linked with each other. Other columns are ignored. An empty table gives an empty result.
    """
    return grouped(df, n, num, den, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def similar_pairs(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a, b, na, nb, common), every link between different n-gram sets, and (doc_id, n_shingles, cid), the set of every row.

    Rows of one set are linked too; they are not written out as pairs. Rows without n-grams have no set (cid null). Other cases
    are as in ``near_duplicates``. A group of near copies has many links; for groups alone ``near_duplicates`` is cheaper.
    """
    join = Join(df, n, num, den, id_col, text_col)
    links = join.all_links()
    of = join.docs.select("doc_id", "n_shingles", "key").join(join.classes.select("key", "cid"), "key", "left")
    of = written(of.select(F.col("doc_id").alias(id_col), "n_shingles", "cid"), "membership")
    join.order.destroy()
    removed(join.docs, join.classes)
    return links, of


def keep_one(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component, one row with the least id.

    Of rows with that id in one component the one with the least MD5 of the text stays, of rows equal in both any one. Texts
    without n-grams all stay, repeated ones too. All columns are kept. Null ids come last within a component. An empty table
    gives an empty one.
    """
    found = grouped(df, n, num, den, id_col, text_col).where("component is not null")
    later = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = written(found.groupBy("component").agg(F.min(F.struct(later.alias("later"), "text_md5")).alias("best")), "best")
    rows = found.join(best, "component").withColumn("gone", later | (F.col("text_md5") != F.col("best.text_md5")))
    # Of a row that stays, repeated ones go too: these are equal in id and text.
    marked = written(rows.groupBy("doc_id", "text_md5").agg(F.max("gone").alias("gone"), F.count("*").alias("rows")).where("gone or rows > 1"), "marked")
    removed(best)
    taken = set(df.columns)
    doc, md5, gone, rows = (next(c for c in (f"_{x}{i or ''}" for i in range(99)) if c not in taken) for x in ("doc", "md5", "gone", "rows"))
    marks = marked.select(F.col("doc_id").alias(doc), F.col("text_md5").alias(md5), F.col("gone").alias(gone))
    if marked.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    joined = df.join(marks, F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (F.md5(text_of(text_col)) == F.col(md5)), "left")
    kept = joined.where(F.col(gone).isNull()).select(df["*"])
    if not marked.where("not gone").limit(1).count():
        return kept
    return kept.unionByName(joined.where(~F.col(gone)).select(df["*"]).dropDuplicates([id_col, text_col]))

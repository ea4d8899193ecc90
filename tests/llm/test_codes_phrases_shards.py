"""Vector codes, phrase collocations and shards: plain versions, both ways of each join, edges."""

import hashlib
import itertools
import math
import pickle
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from facetlake.llm import phrases, sharding, vectors

from ..conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, _label string"
DOCS = "doc_id long, text string, lang string, shard string, slot string, _place string, c0 string, id string, n string"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes by brute force with Python's integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), y) for i, v, y in kept]
    step = width // parts
    part = lambda v, p: v[p * step : (p + 1) * step]
    least = {}
    for i, v, _ in kept:
        least[i] = min(v, least.get(i, v))
    seeds = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[part(least[i], p) for i in seeds] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, y in kept:
        near = [nearest(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), y))
    errors = Counter()
    for _, _, e, y in out:
        errors[y] += e
    return sorted(((i, c, e, errors[y], digest) for i, c, e, y in out), key=str)


def codes(df, **options):
    return sorted((tuple(r) for r in vectors.compress(df, **options).collect()), key=str)


def test_codes_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert codes(spark.read.parquet(f"{SF}/embeddings.parquet")) == plain_codes(rows)


def test_codes_edges(spark):
    """Bad and null vectors go; ties, repeated rows, null ids and labels, lengths that no part divides, clashing columns."""
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(19)], i % 3 or None) for i in range(40)]
    rows += rows[:5] + [(None, [0.5] * 19, 1), (None, [-0.25] * 11, None), (90, [], 2), (3, [0.0] * 19, 7)]
    bad = [(91, None, 1), (92, [1.0, None], 1), (93, [float("nan")] * 19, 1), (94, [float("inf")], 1), (95, [float("-inf")] * 19, None)]
    table = lambda some: spark.createDataFrame([(*r, "x", "y", "z") for r in some], VECTORS)
    as_floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert codes(table(rows + bad)) == plain_codes(as_floats)
    assert codes(table(rows[:3] + bad)) == plain_codes(as_floats[:3])
    assert codes(table([])) == [] and codes(table(bad)) == []
    assert len(codes(table([(1, [3e38, -3e38], 1), (2, [1e9, 0.0], 1)]))) == 2


def test_labels_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 4 or None, "", "", "") for i in range(60)], VECTORS)
    expected = codes(df)
    monkeypatch.setattr(vectors, "BROADCAST_LABELS", 0)
    assert codes(df) == expected


@pytest.mark.parametrize("width", [1, 2, 3, 8, 13])
def test_bounds_lose_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    for scale in (3, 4000, 1 << 27):
        rows = rng.integers(-scale, scale + 1, (400, width))
        rows[::3] = rows[::3, :1]  # no residual
        book = np.concatenate([rows[:12], rng.integers(-scale, scale + 1, (4, width)), rows[:1]])
        found, distance = vectors.Entries(book).nearest(rows)
        exact = ((rows[:, None] - book[None]) ** 2).sum(2)
        assert (found == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def plain_phrases(rows, most=3, least=10, share=50, top=2000):
    """Collocations by brute force; rows are (lang, text)."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        many = [p for p, a in f.items() if len(p) > 1 and a >= least]
        found = []
        for p in many:
            longer = [q for q in many if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= share * f[p] for q in longer):
                continue
            a = f[p]
            score, k = min((int(Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, total[lang], -s))
    return sorted(out)


def phrase_rows(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def phrase_table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "t", "p", "c", "i", "n") for i, (lang, t) in enumerate(rows)], DOCS)


def made_texts():
    rng = random.Random(4)
    words = ["New", "york", "city", "é", " x", "z" * 3000, "the", "of", "a-b", "日本"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", None, "und", "de"]), text()) for _ in range(120)]
    return [*rows, *rows[:9], ("en", None), ("en", ""), ("xx", " .\n"), ("en", "new york city hall " * 3000)]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_phrases_by_brute_force(spark, most):
    rows = made_texts()
    df = phrase_table(spark, rows)
    assert phrase_rows(df, max_words=most, least=4) == plain_phrases(rows, most, least=4)
    assert phrase_rows(df, max_words=most, least=3, share=90, top=7) == plain_phrases(rows, most, 3, 90, 7)


def test_phrases_beyond_what_is_broadcast(spark):
    """Words and pairs that are not broadcast get their numbers by shuffle: the same rows."""
    rows = made_texts()
    df = phrase_table(spark, rows)
    expected = plain_phrases(rows, 4, least=4)
    for hot_most, hot_pairs in ((3, 1 << 20), (1 << 20, 5), (1, 0)):
        assert phrase_rows(df, max_words=4, least=4, hot_most=hot_most, hot_pairs=hot_pairs) == expected


def test_phrases_of_chunks_without_other_words(spark, monkeypatch):
    """Chunks that ask for no name beside chunks that do, with a single part and with many; numbers of 32 and of 64 bits."""
    rows = [("de", "a b a b a b a b"), ("en", "a b c d e f. a b c d"), ("en", "c d e f a b c"), ("fr", "x x x"), (None, "e f e f e")] * 4
    df, expected = phrase_table(spark, rows), plain_phrases(rows, 3, least=4)
    plain = phrases.next_level
    for part, beyond in ((1 << 16, 0), (1, 0), (2, 1 << 40)):
        monkeypatch.setattr(phrases, "PART_NAMES", part)
        monkeypatch.setattr(phrases, "next_level", lambda chunks, known, others, last, total: plain(chunks, known, others, last, total + beyond))  # noqa: B023
        assert phrase_rows(df, least=4, hot_most=2, hot_pairs=1) == expected


def test_pairs_that_workers_hold(spark):
    """Twelve bytes a pair, and no copy of them for a chunk; the same names as without packing."""
    rng = np.random.default_rng(3)
    left, right = np.divmod(np.unique(rng.integers(0, 1 << 40, 200_000)), 1 << 20)
    held = phrases.Pairs.__new__(phrases.Pairs)
    held.keep(left, right, np.arange(len(left))[::-1])
    assert len(pickle.dumps(held)) < 13 * len(left)
    x, y = np.append(left[::100], [1 << 40, 5]), np.append(right[::100], [3, 1 << 40])
    keys = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["left", "right"])
    tracemalloc.start()
    found = held.of("en", keys)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.dtype == np.int64 and found[-2:].tolist() == [-1, -1] and (found[:-2] == np.arange(len(left))[::-1][::100]).all()
    assert most < 4 * len(left)
    held.keep(left << 20, right, np.arange(len(left)))
    assert (held.found(left[::7] << 20, right[::7]) == np.arange(len(left))[::7]).all()


def test_phrases_of_nothing(spark):
    assert phrase_rows(phrase_table(spark, [])) == [] and phrase_rows(phrase_table(spark, [("en", None), (None, "a b")])) == []


def test_phrase_scores_are_exact(spark):
    """Products far beyond 64 bits."""
    rng = random.Random(1)
    rows = []
    for i in range(200):
        x, y = (rng.randint(10, 10 ** rng.randint(2, 15)) for _ in range(2))
        rows.append((i, "en", rng.randint(1, min(x, y)), ["p", "q"], [x], [y]))
    found = {r["phrase"]: r for r in phrases.scored(spark.createDataFrame([(i, e, n, [f"w{i}", "q"], b, a) for i, e, n, _, b, a in rows], phrases.GRAM)).collect()}
    for i, _, n, _, (x,), (y,) in rows:
        assert found[f"w{i} q"]["score"] == 10**6 * n * n // (x * y)


def test_pairs_with_large_numbers():
    """Numbers beyond 32 bits are told apart by both halves."""
    rng = np.random.default_rng(0)
    for top in (1 << 20, 1 << 40):
        left, right = rng.integers(0, 9, (2, 500)) * (top // 9)
        x, y, n, places = phrases.distinct(left, right)
        expected = Counter(zip(left.tolist(), right.tolist(), strict=True))
        assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)) == expected
        assert (x[places] == left).all() and (y[places] == right).all()
        asked = rng.integers(0, 11, (2, 300)) * (top // 9)
        at = phrases.located(x, y, *asked)
        for k, a, b in zip(at.tolist(), *(v.tolist() for v in asked), strict=True):
            assert (a, b) == (x[k], y[k]) if k >= 0 else (a, b) not in expected


def ring_of(shards, nodes):
    place = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    return sorted((place(f"shard#{s}#{v}"), s) for s in range(shards) for v in range(nodes)), place


def plain_shards(ids, shards, nodes, room):
    """The ring's own rule, one document after the other, in the order of hops; ids are distinct."""
    circle, place = ring_of(shards, nodes)
    used, waiting, out = [0] * shards, sorted(ids, key=lambda i: place(str(i))), {}
    for hop in range(shards):
        rest = []
        for i in waiting:
            at = next((k for k, (p, _) in enumerate(circle) if p >= place(str(i))), 0)
            way = list(dict.fromkeys(circle[(at + k) % len(circle)][1] for k in range(len(circle))))
            if used[way[hop]] < room[way[hop]]:
                out[i] = (way[hop], used[way[hop]])
                used[way[hop]] += 1
            else:
                rest.append(i)
        waiting = rest
    return out


@pytest.mark.parametrize(("shards", "nodes", "factor"), [(8, 16, None), (3, 4, 1.1), (5, 32, 1.0), (1, 2, None)])
def test_ring_by_its_own_rule(spark, shards, nodes, factor):
    ids = list(range(7, 1500, 7))
    found = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(spark.createDataFrame([(i,) for i in ids], "doc_id long"), shards=shards, nodes=nodes, factor=factor).collect()}
    expected = plain_shards(ids, shards, nodes, sharding.capacities(len(ids), shards, factor))
    assert {i: s for i, (s, _) in found.items()} == {i: s for i, (s, _) in expected.items()}
    for s in range(shards):
        assert sorted(slot for x, slot in found.values() if x == s) == list(range(sum(x == s for x, _ in expected.values())))


def test_shards_edges(spark):
    """A third of the rows has one id; null ids and texts, repeated rows, clashing columns."""
    rows = [(5, "same", None)] * 100 + [(None, None, None)] * 7 + [(i, "x" * (i % 50), "en") for i in range(200)] + [(1000, "é" * 100_000, "en")]
    df = spark.createDataFrame([(*r, "s", "t", "p", "c", "i", "n") for r in rows], DOCS)
    found = sharding.assign(df, tie_cols=("text",)).collect()
    assert [f.name for f in sharding.assign(df).schema] == [c for c in df.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert sorted(str(r[:3]) for r in ((x["doc_id"], x["text"], x["lang"]) for x in found)) == sorted(map(str, rows))
    counts = Counter(r["shard"] for r in found)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in found} == {(s, k) for s in counts for k in range(counts[s])}
    sizes = sharding.shard_documents(df).groupBy("doc_id", "size").count().collect()
    assert {(r["doc_id"], r["size"]): r["count"] for r in sizes} == Counter((i, len((t or "").encode()) + 1) for i, t, _ in rows)
    assert sharding.assign(df.limit(0)).count() == 0 and sharding.shard_documents(df.limit(0)).count() == 0


def test_few_rows_move_when_a_shard_is_added(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before, after = sharding.assign(df), sharding.assign(df, shards=9)
    moved = before.join(after.withColumnRenamed("shard", "then"), "doc_id").where("shard <> then").count()
    assert moved < 20_000 * 0.25  # the least is a ninth; taken modulo the shards it is 8 of 9
    loose = sharding.assign(df, factor=1.25).join(sharding.assign(df, shards=9, factor=1.25).withColumnRenamed("shard", "then"), "doc_id").where("shard <> then")
    assert loose.count() < 20_000 * 0.16 and loose.where("then <> 8").count() < 20_000 * 0.04


def test_written_shards(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    expected = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.assign(df).collect()}
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in back.collect()} == expected
    assert sum(1 for _ in itertools.islice((tmp_path / "out").glob("shard=*"), 99)) == 8

"""What the methods add, against plain versions: links, spans, cutoffs, lattices, ranks, features, and the pipeline's edges."""

import hashlib
import itertools
import math
import random
import re
import string
import uuid
from collections import Counter
from math import comb

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from facetlake.llm import linededup, media, ngramjoin, packing, quality, secrets, toxicity, urlgraph

from ..conftest import SF, same

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_links(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    return {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


@pytest.fixture(scope="module")
def copies(spark):
    """Copies, near copies, one passage in many texts, frames with small changes, empty and null texts, null ids."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    passage, rows = rng.sample(words, 40), []
    for g in range(6):
        base = rng.sample(words, rng.choice([5, 30, 80, 200]))
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                t[rng.randrange(len(t))] = rng.choice(words[:40])
            rows.append(" ".join(t))
        rows += [" ".join(base)] * 3
    rows += [" ".join(passage + rng.sample(words, rng.choice([2, 4, 8, 60]))) for _ in range(60)]
    rows += ["", None, " \t", "a", "A", "a b", "x y z"]
    rng.shuffle(rows)
    out = [(i if i % 17 else None, t) for i, t in enumerate(rows)]
    return out, spark.createDataFrame(out, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("setting", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_every_link_and_component(spark, copies, setting):
    rows, df = copies
    links = plain_links(rows, *setting)
    sets = [shingles(t, setting[0]) for _, t in rows]
    found, of = ngramjoin.similar_pairs(df, *setting)
    cid = {}
    for r in of.collect():
        if r["doc_id"] is not None:
            cid[r["doc_id"]] = (r["cid"], r["n_shingles"])
    want = {frozenset((cid[i][0], cid[j][0])) for i, j in links if sets[i] != sets[j] and rows[i][0] is not None and rows[j][0] is not None}
    null = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    known = {c for c, _ in cid.values()}
    assert {frozenset(p) for p in null if set(p) <= known} == want
    assert all(cid[i] == ((cid[i][0]), len(sets[i])) for i in cid)
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in links:
        a, b = sorted((root(i), root(j)))
        least[b] = a
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    want = Counter((rows[i][0], len(sets[i]), min((x for x in members[root(i)] if x is not None), default=None)) for i in range(len(rows)))
    got = ngramjoin.near_duplicates(df, *setting)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_a_bucket_of_thousands(spark, monkeypatch):
    """Texts that share first n-grams in one bucket, most of them near copies of a text, others of none."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 64)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(2000):
        t = list(base)
        for _ in range(rng.randint(1, 3) if i % 5 else 12):
            t[rng.randrange(20, 120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = [shingles(t, 4) for _, t in rows]
    grams = {}
    for i, s in enumerate(sets):
        for x in s:
            grams.setdefault(x, len(grams))
    m = np.zeros((len(rows), len(grams)), np.float32)
    for i, s in enumerate(sets):
        m[i, [grams[x] for x in s]] = 1
    common = m @ m.T
    n = m.sum(1)
    near = 100 * common >= 85 * (n[:, None] + n[None] - common)
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None], len(rows)).min(1)
        if (new == label).all():
            break
        label = new
    found = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert found == dict(enumerate(label.tolist())) and Counter(label.tolist()).most_common(1)[0][1] > 500


def test_signatures_of_other_lengths(spark):
    """A bound from signatures never falls below the true overlap, for sets of like and of twice the size."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows = []
    for a, b in ((250, 260), (255, 300), (1000, 1030), (40, 40)):
        x = rng.integers(-(2**62), 2**62, a)
        y = np.concatenate([x[: int(0.9 * a)], rng.integers(-(2**62), 2**62, b - int(0.9 * a))])
        rows.append((a, b, len(np.intersect1d(x, y)), ngramjoin.signature(np.unique(x)), ngramjoin.signature(np.unique(y))))
    df = spark.createDataFrame(rows, "na long, nb long, common long, a array<long>, b array<long>")
    for r in df.withColumn("most", ngramjoin.most_common(*(F.col(c) for c in ("na", "nb", "a", "b")))).collect():
        assert r["common"] <= r["most"] <= 1.06 * r["common"]


def test_keep_one_keeps_what_is_no_copy(spark):
    rows = [(4, ""), (4, ""), (5, None), (5, None), (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six")]
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(4, ""), (4, ""), (5, None), (5, None), (1, "one two three four five six")])


SECRETS = {
    "base62 of 16": (16, string.ascii_letters + string.digits, 0.9),
    "base62 of 24": (24, string.ascii_letters + string.digits, 0.99),
    "base64 of 32": (32, string.ascii_letters + string.digits + "+/", 0.97),
    "letters of 32": (32, string.ascii_letters, 0.99),
    "lower case of 32": (32, string.ascii_lowercase, 0.97),
    "hex of 24": (24, "0123456789abcdef", 0.97),
}


@pytest.mark.parametrize("name", SECRETS)
def test_recall_of_random_strings(name):
    n, letters, least = SECRETS[name]
    coder, rng = secrets.coder(RANKS, public_tokenizers.PATTERN), random.Random(3)
    hits = sum(bool(secrets.all_spans(f"see {''.join(rng.choices(letters, k=n))} here", coder, 2.2)[1]) for _ in range(300))
    assert hits >= least * 300


def test_no_alarm_for_identifiers():
    coder, rng = secrets.coder(RANKS, public_tokenizers.PATTERN), random.Random(4)
    words = "user data image config page index article server client session update value report export archive search product".split()
    for _ in range(300):
        w = lambda: rng.choice(words)
        n = lambda a, b: rng.randint(a, b)
        plain = [
            f"id/{uuid.UUID(int=rng.getrandbits(128))}",
            f"{w()}_{uuid.UUID(int=rng.getrandbits(128))}_{w()}",
            f"20{n(10, 25)}-{n(1, 12):02}-{n(1, 28):02}T{n(0, 23):02}-{n(0, 59):02}-{n(0, 59):02}-{n(0, 999):03}Z",
            f"{w()}/20{n(10, 25)}/{n(1, 12):02}/{n(1, 28):02}/{w()}-{w()}",
            "/".join(w() + (str(n(1, 9999)) if rng.random() < 0.5 else "") for _ in range(n(3, 6))),
            "_".join(w() + (str(n(0, 99)) if rng.random() < 0.5 else "") for _ in range(n(3, 6))),
            "_".join(w().upper() for _ in range(4)),
            f"{w()}/{''.join(rng.choices('0123456789ABCDEF', k=40))}",
            "".join(rng.choices(string.digits, k=24)),
        ]
        for text in plain:
            assert secrets.all_spans(f"see {text} here", coder, 2.2)[1] == secrets.base_spans(f"see {text} here"), text


def test_random_spans_beside_base_spans():
    """Runs are held against the base spans before them and over them, in one walk."""
    coder = secrets.coder(RANKS, public_tokenizers.PATTERN)
    key, text = "zQ8xK2vLp9Wm4Tn7Rb3Y", []
    for i in range(50):
        text.append(f"password: hunter{i:04d}abc {key} token=abcdefghijkl0{i}")
    text = " ".join(text)
    base, every = secrets.all_spans(text, coder, 2.2)
    found = [s for s in every if s[1] == 3]
    runs = [(m.start(), 3, m.end()) for m in re.finditer(key, text)]
    assert found == runs and [s for s in every if s[1] != 3] == base


def exact_level(row, cutoffs):
    return next((k for k in range(quality.STEPS) if any(row[s] > c[k] for s, c in cutoffs.items())), quality.STEPS)


def test_quality_levels_cutoffs_and_verdicts(spark):
    """Levels by the definition, certified steps by exact binomial sums, and what they keep."""
    rng = random.Random(5)
    words = [a + b for a in ("lo", "mer", "tan", "vi") for b in ("den", "rak", "tu", "pim", "gor", "s")]
    rows, labels = [], []
    for i in range(900):
        t = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(80)]
        for _ in range(rng.choice([0, 0, 0, 4, 12, 40]) if i % 3 else 0):
            t[rng.randrange(80)] += rng.choice("#*$")
        rows.append((i, " ".join(t), "en" if i % 3 else "de"))
        labels.append((i, 1))
    rows += [(9001, "word " * 60, "en"), (9002, None, None), (9003, "", "fr")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    level = {}
    for i, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        share = lambda a, b: a / b if b else 0.0
        level[i] = exact_level({"symbol_share": share(symbols, n), "repeat_share": share(got[i]["n_repeat_words"], n), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)), "long_words": share(chars, n), "short_words": share(n, chars)}, quality.CUTOFFS)
        assert got[i]["level"] == level[i], i
    strata = {"en": [i for i, _, s in rows if s == "en" and i < 900], "de": [i for i, _, s in rows if s == "de" and i < 900]}
    tests = len(strata) * quality.STEPS
    for name, ids in strata.items():
        n, best = len(ids), None
        for k in range(quality.STEPS):
            rejected = sum(level[i] <= k for i in ids)
            tail = sum(comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(rejected + 1)) if rejected < 0.05 * n else 1.0
            if tail <= 0.05 / tests:
                best = k
        assert {got[i]["cutoff"] for i in ids} == {best}, name
        for i in ids:
            failed = got[i]["n_words"] < 50 or 100 * got[i]["n_repeat_words"] > 50 * got[i]["n_words"]
            assert got[i]["kept"] == (not failed and not (best is not None and level[i] <= best))
    assert got[9001]["base_failed"] and got[9002]["base_failed"] and got[9003]["cutoff"] is None


def test_decode_against_all_paths():
    """The best path of small lattices, found by trying all of them."""
    text = "the stupid idiot said hello to the nice people in this little town " * 50
    c = toxicity.classes("  " + text + " ")
    cells, n = np.unique(c[:-2] * 784 + c[1:-1] * 28 + c[2:], return_counts=True)
    restorer = toxicity.Restorer(toxicity.log_model(cells, n))
    model = toxicity.log_model(cells, n)

    def best(word):
        top = (-math.inf, None)
        for path in itertools.product(*restorer.lattice(word)):
            score, a, b, out = sum(p for _, p in path), 0, 0, ""
            for x, _ in (*path, (" ", 0.0)):
                if not x:
                    continue
                k = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else toxicity.OTHER
                if k == 0 and b == 0:
                    continue
                score, out, a, b = score + model[a, b, k], out + x, b, k
            top = max(top, (score, out.strip()), key=lambda v: v[0])
        return top[1]

    for word in ("st0p1d", "1d10t", "i d 1 o t", "heelllo", "n!c3", "t.o.w.n", "@@l", "p3*ple", "1,2"):
        assert restorer.decode(word) == best(word), word


def test_classifier_learns_and_moves_its_cutoff(spark):
    rng = random.Random(6)
    plain = [a + b for a in ("lo", "mer", "tan", "vi", "sol") for b in ("den", "rak", "tu", "pim", "gor")]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (["scum"] if i % 10 == 0 else []))) for i in range(1000)]
    labels = [(i, int(i % 10 == 0)) for i in range(1000)]
    found = toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 10 == 0) for r in found)
    assert {r["held_out"] for r in found} == {True, False}
    x, y = np.random.default_rng(0).normal(size=(200, 3)).astype(np.float32), np.zeros(200)
    assert toxicity.cutoff(x, y, -1.0, 1e-3) == 0.0


def graph_pages():
    """Pages of a planted host graph: hubs, cycles, dangling hosts, both seeds, hosts that no link reaches."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">{h}</a>' for h in hosts)
    pages = [
        ("http://good.com/a", link("friend.org", "far.org")),
        ("http://shop.com/a", link("friend.org", "hub.org")),
        ("http://bad.net/es/a", link("friend.org")),
        ("http://bad.net/es/b", link("loop1.org")),
        ("http://worse.net/fr/a", ""),
        ("http://farm1.org/a", link("bad.net", "worse.net")),
        ("http://farm2.org/a", link("farm1.org")),
        ("http://loop1.org/a", link("loop2.org")),
        ("http://loop2.org/a", link("loop1.org", "bad.net")),
        ("http://hub.org/a", link("friend.org", "far.org", "farm1.org", "loop1.org", "lone.org")),
        ("http://friend.org/a", link("far.org")),
        ("http://far.org/a", None),
        ("http://lone.org/a", "<a href='/local'>x</a>"),
        ("http://apart.org/a", ""),
        ("http://www.example.com/en/x", link("bad.net")),
        (None, link("bad.net")),
        ("no scheme", ""),
    ]
    return [(i, u, h) for i, (u, h) in enumerate(pages)]


def test_url_verdicts_on_a_planted_graph(spark):
    pages = graph_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    got = urlgraph.judge(df).toPandas()
    same(got, con.execute(urlgraph.oracle()).df())
    verdict = {u: v for u, v in zip([p[1] for p in pages], got.sort_values("page_id")["verdict"], strict=True)}
    assert {u for u, v in verdict.items() if v == "block"} == {"http://bad.net/es/a", "http://bad.net/es/b", "http://worse.net/fr/a", "http://farm1.org/a", "http://farm2.org/a", "http://hub.org/a"}


def test_ranks_against_plain_pagerank(spark):
    rng = random.Random(8)
    hosts = [f"h{i}" for i in range(30)]
    edges = sorted({(a, b) for a, b in ((rng.choice(hosts[:25]), rng.choice(hosts)) for _ in range(90)) if a != b})
    seeds = hosts[:4]
    df = spark.createDataFrame([("trust", a, b) for a, b in edges], "kind string, src string, dst string")
    found = {r["host"]: r["rank"] for r in urlgraph.propagate(df, spark.createDataFrame([("trust", h) for h in seeds], "kind string, host string")).collect()}
    restart = np.array([h in seeds for h in hosts]) / len(seeds)
    rank = restart.copy()
    out = {h: [b for a, b in edges if a == h] for h in hosts}
    for _ in range(20):
        moved = np.zeros(30)
        for h, to in out.items():
            for b in to:
                moved[hosts.index(b)] += 0.85 * rank[hosts.index(h)] / len(to)
        rank = moved + (1 - moved.sum()) * restart
    assert rank.sum() == pytest.approx(1) and all(found.get(h, 0) == pytest.approx(r, abs=1e-12) for h, r in zip(hosts, rank, strict=True))


def test_media_against_plain_values(spark):
    texts = ["", "a", "x" * 64, "é\U0001f600" * 500, "line\n" * 3000]
    got = {r["doc_id"]: r for r in media.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        x = np.frombuffer(raw, np.uint8).astype(int) - 128
        head = b"RIFF" + (36 + len(raw)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
        assert got[i]["media_sha256"] == hashlib.sha256(media.wav(raw)).hexdigest() and media.wav(raw).startswith(head) and media.wav(raw).endswith(raw)
        parts = [int(sum(p)) for p in np.split(x, 8)]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x[1:], x[:-1], strict=True))
        assert got[i]["feature"] == f"peak={max(abs(x))};sum={sum(x)};energy={sum(int(v) ** 2 for v in x)};crossings={crossings};slices={'/'.join(map(str, parts))}"


def test_equal_pieces_spread(spark):
    """Rows equal in all that is packed go to several groups."""
    rows = [(None, 0, 0, 1, 7)] * 4000
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack_pieces(df, 2048, group=500)
    sizes = [r["count"] for r in packed.selectExpr("sequence_id >> 32 AS g").groupBy("g").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 5 and max(sizes) < 2000


EDGES = "doc_id long, text string, lang string, source string, n_chars long, _gone int, key string, sequence_id string"


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing names and empty tables through all stages."""
    long = " ".join(f"word{i % 977} gap{i % 31}" for i in range(20_000))
    rows = [(1, "one two three four five six seven", "en", "a", 5), (1, "one two three four five six seven", "en", "a", 5), (None, "no id here at all", None, None, None), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "", None, "a", 0), (4, "", None, "a", 0), (6, long, "en", "b", 1), (7, "key zQ8xK2vLp9Wm4Tn7Rb3Yc6Hd1Jf5Gs0 end of it", "en", "b", 1)]
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(*r, 9, "k", "s") for r in rows], EDGES).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for frame, kept in ((docs, len(rows) - 1), (docs.where("false"), 0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert now.columns == docs.columns, name
                assert now.count() == (len(rows) if kept and name in ("toxicity", "line_dedup") else kept), name
        packed = now.collect()
        assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == (Counter([1, None, 3, 3, 4, 4, 6, 7]) if kept else Counter())


def test_pipeline_against_a_plain_version(spark):
    """The stages after the classifier on the smallest tables: lines, groups, secrets and ids worked out without Spark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    rows = [tuple(r) for r in clean.select("doc_id", "text", "source").collect()]
    pages, texts = {}, {}
    for _, text, source in rows:
        texts.setdefault(source, set()).add(text)
    for source, some in texts.items():
        pages[source] = Counter(x for t in some for x in {y for y in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)})
    kept = []
    for doc_id, text, source in rows:
        def bad(x, source=source):
            ratio = linededup.LONG_RATIO if len(re.split(r"[\x20\x09-\x0D]+", x)) >= linededup.LONG_WORDS else linededup.RATIO
            return pages[source][x] >= 3 and pages[source][x] > ratio * len(texts[source])
        lines = [x for x in (text or "").split("\n")]
        kept.append((doc_id, "\n".join(x for x in lines if not bad(x)) if text is not None else None))
    links = plain_links(kept, 5, 80, 100)
    least = {i: i for i, _ in kept}
    changed = True
    ids = [i for i, _ in kept]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[ids[a]], least[ids[b]])
            changed |= least[ids[a]] != low or least[ids[b]] != low
            least[ids[a]] = least[ids[b]] = low
    left = [(i, t) for i, t in kept if least[i] == i]
    coder = secrets.coder(RANKS, public_tokenizers.PATTERN)
    want = {i: secrets.redacted(t or "", secrets.all_spans(t or "", coder, 2.2)[1], "[SECRET]") for i, t in left}
    now = clean
    for name, stage in corpus_pipeline.STAGES[1:4]:
        now = stage(spark, now, SF)
    got = {r["doc_id"]: r["text"] or "" for r in now.collect()}
    assert got == want

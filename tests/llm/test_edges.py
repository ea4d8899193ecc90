"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names, for every operator."""

import itertools

import public_tokenizers
import pytest

from facetlake.llm import bpe, linededup, media, ngramjoin, packing, quality, secrets, toxicity, urlgraph, warc

BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
LONG = " ".join(f"word{i % 977} gap{i % 31}" for i in range(30_000))
ROWS = [(1, "one two three four five six", "a", "x"), (1, "one two three four five six", "a", "x"), (None, "no id here at all", None, None), (3, None, "a", "x"), (4, "", None, "y"), (5, " \n\t", "b", "y"), (6, LONG, "b", None), (7, "é ü \U0001f600 日本語", "b", "y")]
SCHEMA = "doc_id long, text string, source string, lang string, _gone int, key string, _site string, n_lines string, sequence_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 9, "k", "s", "l", "q") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (6, None, None), (7, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "bpe": lambda d, y: bpe.encode_column(d, BYTE, with_ids=True),
    "secrets": lambda d, y: secrets.find_secrets(d, RANKS, public_tokenizers.PATTERN),
    "redact": lambda d, y: secrets.redact(d, RANKS, public_tokenizers.PATTERN),
    "media": lambda d, y: media.round_trip(d),
    "quality": lambda d, y: quality.judge(d, y),
    "line dedup": lambda d, y: linededup.drop_boilerplate(d),
    "toxicity": lambda d, y: toxicity.judge(d, y),
    "n-gram join": lambda d, y: ngramjoin.near_duplicates(d),
    "warc": lambda d, y: warc.round_trip(d, id_col="doc_id", url_col="source", html_col="text"),
    "urls": lambda d, y: urlgraph.judge(d, id_col="doc_id", url_col="source", html_col="text", rounds=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(docs, none, labels, name):
    found = OPERATORS[name](docs, labels).collect()
    key = "page_id" if name == "warc" else "doc_id"
    assert sorted(str(r[key]) for r in found) == sorted(str(r[0]) for r in ROWS)
    first = [r for r in found if r[key] == 1]
    if name not in ("warc",):
        assert first[0] == first[1]
    assert OPERATORS[name](none, labels).count() == 0


def test_packing_edges(docs, none):
    rows = packing.pack_documents(docs, WORD).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert max(r["length"] for r in rows) == 2048
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert packing.pack_documents(none, WORD).count() == 0


def test_near_duplicate_edges(docs):
    rows = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngramjoin.near_duplicates(docs).collect()}
    assert rows[1, 2] == 1 and rows[3, 0] == 3 and rows[4, 0] == 4 and rows[5, 0] == 5 and rows[None, 1] is None
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (1, None, 3, 4, 5, 6, 7)))


def test_large_bucket_loses_no_link(spark):
    """More texts share each n-gram than a small bucket has; groups differ, so that hubs cannot reach all of them."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for g, v in itertools.product(range(6), range(6)):
        words = base[:40] + [f"g{g}x{i}" for i in range(40)]
        words[60 + v] = f"v{v}"
        rows.append((g * 100 + v, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2, num=80, den=100).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    assert found == least


def test_bpe_agrees_on_odd_texts():
    from tokenizers import Tokenizer

    coder, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    odd = ["", " ", "  a  b ", "\n\n x", "<|endoftext|>", "a<|endoftext|> b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "it's  we'll\tgo", "　x y", "日本語テキスト", "\U0001f600" * 5, "é" * 40, "x" * 5000, "12 345 6,7.8"]
    for text, ids in zip(odd, own.encode(odd), strict=True):
        expected = coder.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, expected)), text
        assert own.decode(ids) == coder.decode(expected, skip_special_tokens=False).encode()


def test_warc_segments(spark, tmp_path):
    rows = [(1, "http://a/1", "x" * 5000), (2, "http://a/2", "x" * 5000), (3, None, None), (4, "http://b", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.write_archives(pages, f"file://{tmp_path}/w", segment=600, chunk=100, roll=2000)
    back = {r["page_id"]: r for r in warc.read_archives(spark, made, keep_payload=True).collect()}
    assert bytes(back[2]["payload"]) == b"x" * 5000 and back[2]["n_segments"] > 8
    assert (back[1]["record_type"], back[1]["refers_to"], back[1]["payload_bytes"]) == ("revisit", 2, 5000)
    assert (back[3]["record_type"], back[3]["refers_to"]) == ("revisit", 4)


def test_warc_framing_errors():
    assert warc.dechunked(warc.chunked(b"abc" * 100, 7)) == b"abc" * 100
    for bad in (b"", b"5\r\nab", b"zz"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_media_retries_a_member(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1/3.wav", media.wav(media.padded(b"abc")))
    reader = media.MediaReader({"folder": str(tmp_path), "attempts": "2"})
    files, path = media.opened(str(tmp_path / "a.zip"))
    info = zipfile.ZipFile(tmp_path / "a.zip").infolist()[0]

    class Broken:
        def seek(self, at):
            raise OSError("lost")

    assert media.samples_of(reader.member(files, path, Broken(), info)) == media.padded(b"abc")
    info.header_offset += 1
    with pytest.raises(OSError):
        reader.member(files, path, Broken(), info)


def test_secret_spans():
    coder = secrets.coder(RANKS, public_tokenizers.PATTERN)
    kinds = lambda t: secrets.shown(secrets.all_spans(t, coder, 2.2)[1])
    assert kinds("key zQ8xK2vLp9Wm4Tn7Rb3Yc6Hd1Jf5Gs0 end").startswith("random:4:")
    assert kinds("id 123e4567-e89b-12d3-a456-426614174000 end") == ""
    assert kinds("an internationalisation_of_everything2 end") == ""
    assert kinds("password: short") == "" and kinds("password: longenough1") == "assign:0:21"
    assert secrets.redacted("a password: longenough1 b", [(2, 0, 23)], "[S]") == "a [S] b"


def test_secrets_of_letters_alone():
    import random
    import string

    coder, rng = secrets.coder(RANKS, public_tokenizers.PATTERN), random.Random(5)
    for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase):
        for _ in range(50):
            key = "".join(rng.choices(letters, k=32))
            assert secrets.shown(secrets.all_spans(f"key {key} end", coder, 2.2)[1]) == "random:4:36"
    for plain in ("internationalisation_of_everything", "Donaudampfschifffahrtsgesellschaft", "12345678901234567890123", "-" * 40, "DEADBEEF" * 4):
        assert secrets.all_spans(f"an {plain} end", coder, 2.2)[1] == []


def test_quality_tail():
    from math import comb

    from pyspark.sql import functions as F

    for k, n in ((0, 50), (3, 200), (7, 90)):
        exact = sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
        from pyspark.sql import SparkSession

        got = SparkSession.active().range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.05)).first()[0]
        assert got == pytest.approx(exact if k < n * 0.05 else 1.0)


def test_packing_is_tight():
    import numpy as np

    lengths = np.random.default_rng(1).integers(1, 1500, 3000)
    bins = packing.pack(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 2048
    assert len(bins) <= 1.01 * -(-lengths.sum() // 2048) + 1


def test_restored_text():
    import numpy as np

    text = "the stupid idiot said hello to the nice people in this little town " * 50
    c = toxicity.classes("  " + text + " ")
    cells, n = np.unique(c[:-2] * 784 + c[1:-1] * 28 + c[2:], return_counts=True)
    restorer = toxicity.Restorer(toxicity.log_model(cells, n))
    assert restorer.restore("you st0p1d 1di0t") in ("you stopid idiot", "you stupid idiot", "you stopld idiot")
    assert restorer.restore("an i d i o t here") == "an idiot here"
    assert restorer.restore("heeeello people") == "hello people"
    assert restorer.restore("") == ""


@pytest.mark.parametrize(
    "hidden",
    ["1 d 1 0 t", "i d 1 o t", "iddiot", "iidioot", "i  d  i  o  t", "i\nd\ni\no\nt", "id iot", "1d i0t", "i'd'i'o't", "i,d,i,o,t", "i, d, i, o, t", "1dd10t", "i d d i o t", "!d!0t", "i*d*i*o*t", "id10t!", "1 d d 1 0 t"],
)
def test_hidden_words_are_read(hidden):
    import numpy as np

    text = "the stupid idiot said hello to the nice people in this little town " * 50
    c = toxicity.classes("  " + text + " ")
    cells, n = np.unique(c[:-2] * 784 + c[1:-1] * 28 + c[2:], return_counts=True)
    restorer = toxicity.Restorer(toxicity.log_model(cells, n), frozenset({*text.split(), "ass", "clown", "scum"}))
    assert restorer.restore(f"hello {hidden} in this little town") == "hello idiot in this little town"
    assert restorer.restore("c l 0 w n, scu m and 455") == "clown , scum and ass"
    assert restorer.restore("the nice people, 1 2 3 and 1990") == "the nice people, 1 2 3 and 1990"


def test_hidden_toxic_texts_are_caught(spark):
    import random

    rng = random.Random(3)
    plain = [a + b for a in ("lo", "mer", "tan", "vi", "sol") for b in ("den", "rak", "tu", "pim", "gor")]
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=20), *more], 20 + len(more)))
    rows = [(i, text(*(["idiot"] if i % 4 == 0 else []))) for i in range(400)]
    hidden = ["1 d 1 0 t", "iddiot", "id iot", "i,d,i,o,t", "1 d d 1 0 t"]
    docs = spark.createDataFrame(rows + [(1000 + i, text("HIDDEN").replace("HIDDEN", h)) for i, h in enumerate(hidden)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.judge(docs, labels).collect()}
    assert found == {i: int(i % 4 == 0) for i in range(400)} | {1000 + i: 1 for i in range(len(hidden))}


def test_line_dedup_ratio(spark):
    rows = [(i, f"Footer\nbody {i}\n\nFooter", "a") for i in range(4)] + [(9, "Footer\nalone", "b")]
    kept = {r["doc_id"]: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.5).collect()}
    assert kept[0]["text"] == "body 0\n" and (kept[0]["n_lines"], kept[0]["n_dropped"]) == (4, 2)
    assert kept[9]["text"] == "Footer\nalone"

"""Both ways of a step that depends on a counted bound, attempts of a task, and scores of blocks against single texts."""

import random

import numpy as np
import pytest

from facetlake.llm import linededup, media, storage, toxicity, warc

LINES = "doc_id long, text string, source string, _key string, n_lines string, _digest int"


@pytest.mark.parametrize("copies", [True, False])
def test_line_dedup_by_set_and_by_join(spark, monkeypatch, copies):
    rng = random.Random(1)
    line = lambda: rng.choice([*(f"shared {i} " * rng.choice([1, 12]) for i in range(9)), f"own {rng.random()}", "", " "])
    rows = [(i, "\n".join(line().strip() for _ in range(rng.randint(1, 12))), rng.choice(["a", "a", "b", None]), "k", "n", 1) for i in range(120)]
    rows += rows[:9] + [(900, None, "a", None, None, None), (901, "", None, "k", "n", 2), (None, "shared 1\nshared 2", "a", "k", "n", 3)]
    df = spark.createDataFrame(rows, LINES)
    found = []
    for bound in (linededup.BROADCAST_LINES, 0):
        monkeypatch.setattr(linededup, "BROADCAST_LINES", bound)
        got = linededup.drop_boilerplate(df, ratio=0.1, long_ratio=0.05, copies=copies)
        assert got.columns == ["doc_id", "text", "source", "_key", "_digest", "n_lines", "n_dropped"]
        found.append(sorted(map(str, got.collect())))
        assert linededup.drop_boilerplate(df.limit(0), ratio=0.1).count() == 0
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert any("n_dropped=2" in r for r in found[0])


def test_attempts_of_a_task_leave_each_other_alone(spark, tmp_path):
    """A task that writes twice makes two files; the manifest names one of them and reading goes by it."""
    names = set()
    for _ in range(2):
        sink = storage.Sink(f"file://{tmp_path}/x", "part-00000-0000.zip")
        sink.write(b"abc")
        sink.close()
        names.add(sink.uri)
        assert sink.uri.startswith(f"file://{tmp_path}/x/part-00000-0000-") and sink.uri.endswith(".zip")
    assert len(names) == 2
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    made = media.write_archives(docs, f"file://{tmp_path}/m")
    late = storage.Sink(f"file://{tmp_path}/m", "part-00000-0000.zip")  # a second attempt that never counts
    late.write(b"half a member")
    late.close()
    back = media.read_media(spark, f"file://{tmp_path}/m").collect()
    assert len(back) == 20 and {r["archive"] for r in back} == {r["archive"] for r in made.collect() if r["members"]}
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * i) for i in range(20)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    storage.Sink(f"file://{tmp_path}/w", "part-00000-0000.warc.gz").close()
    assert sorted(r["page_id"] for r in warc.read_archives(spark, manifest).collect()) == list(range(20))


def small_model():
    text = "the stupid idiot said hello to the nice people in this little town clown scum " * 50
    c = toxicity.classes("  " + text + " ")
    cells, n = np.unique(c[:-2] * 784 + c[1:-1] * 28 + c[2:], return_counts=True)
    known = frozenset({*text.split(), "ass"})
    features = {f: i for i, f in enumerate(["=idiot", "=the", "idio", "stup", "stupi", "=clown", "=ass", "=people", "peop"])}
    return toxicity.Model(toxicity.log_model(cells, n), features, np.linspace(-1, 1, len(features)), 0.1, known)


def test_blocks_score_as_single_texts_do():
    rng = random.Random(4)
    words = ["the", "idiot", "1d10t", "id iot", "i d i o t", "(a s s)", "c l 0 w n!", "stu pid,", "peo", "ple", "iddiot", "\U0001f600", "i’d’i’o’t", "x", "hello.", "unknownish", "scu m", "", "\n", " ", "455", "1 d 1 0 t"]
    texts = ["", " ", *(rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(400))]
    model = small_model()
    for known in (model.known, frozenset()):
        single, block = (toxicity.Scorer(toxicity.Restorer(model.trigrams, known), model.features) for _ in range(2))
        expected = [toxicity.probability(model, single.count(t)) for t in texts]
        assert block.scores(texts, model).tolist() == pytest.approx(expected, abs=1e-12)
        assert block.scores([], model).tolist() == []
    empty = toxicity.Model(model.trigrams, {}, np.zeros(0), 0.3, model.known)
    assert toxicity.Scorer(toxicity.Restorer(model.trigrams, model.known), {}).scores(texts[:5], empty) == pytest.approx(1 / (1 + np.exp(-0.3)))


def test_gate_of_spaced_letters_misses_nothing():
    rng = random.Random(5)
    signs = "ab1@$!| .,'’_/:;~\\=-(\"[*é \n^%"
    for _ in range(20_000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 14)))
        assert toxicity.spaced_out(text) or not toxicity.SPACED.search(text)
    assert not toxicity.spaced_out("a man saw I am in it") and toxicity.spaced_out("a b\U0001f600 c d")


def test_long_spaced_stretch_takes_linear_time():
    restorer = toxicity.Restorer(small_model().trigrams, small_model().known)
    import time

    took = []
    for n in (2000, 16_000):
        began = time.process_time()
        assert restorer.known_reading(" ".join("idiot" * n)) == " ".join(["idiot"] * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_words_of_texts():
    import re
    from collections import Counter

    rng = random.Random(6)
    parts = ["word", "Wörter", "日本", "x1y", "\U0001d4d0b", "\U0001f600", " ", "\n", "-", "_", "é", "", "don't", "A"]
    texts = ["", "a", *("".join(rng.choices(parts, k=rng.randint(0, 12))).lower() for _ in range(60))]
    words, n = toxicity.words_of(texts)
    expected = Counter(w for t in texts for w in set(re.findall(r"[^\W\d_]+", t)))
    assert dict(zip(words.to_pylist(), n.tolist(), strict=True)) == expected
    assert toxicity.words_of([])[0].to_pylist() == [] and toxicity.words_of([""])[0].to_pylist() == []

"""The stages of the corpus pipeline on planted cases, and the whole over the smallest tables."""

import corpus_pipeline
import pytest
from facetlake.llm import packing, toxicity

from ..conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_take_effect(spark, docs):
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.5}
    lines = corpus_pipeline.drop_boilerplate(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count()


def test_copies_go(spark):
    words = [f"w{i}" for i in range(80)]
    near = [*words]
    near[40] = "other"
    rows = [(5, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "t", 1), (9, " ".join(words), "en", "s", 1), (4, "something else", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4]


def test_rare_notices_and_passages_go(spark):
    """A notice and a long passage on a few of many pages of a source, under the 2 % of the registered query."""
    notice, passage = "All rights reserved.", " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"first line of {i}\n" + (notice if i < 6 else passage if i < 9 else f"last line of {i}"), "en", "s", 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, docs, SF).collect()}
    assert {i for i, t in kept.items() if t == f"first line of {i}"} == set(range(9))
    assert all(kept[r[0]] == r[1] for r in rows[9:])


def test_one_of_a_group_of_copies_stays_whole(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(5))
    rows = [(i, text + "\nfooter", "en", "s", 1) for i in range(40)] + [(100 + i, f"page {i}\nfooter", "en", "s", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_boilerplate(spark, docs, SF), SF)
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert found == {0: text} | {100 + i: f"page {i}" for i in range(8)}


def test_secrets_go(spark):
    docs = spark.createDataFrame([(1, "my password: hunter2hunter2 ok", "en", "s", 30), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    assert rows[1]["text"] == "my [SECRET] ok" and rows[1]["n_chars"] == 14 and rows[2]["text"] is None


def test_run(spark, docs):
    rows = corpus_pipeline.run(spark, SF)
    found = rows.collect()
    assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5 and found
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert max(map(sum, by.values())) <= 2048


def test_sequences_hold_their_pieces(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    (row,) = packing.sequences(packed).collect()
    assert len(row["ids"]) == sum(r["length"] for r in packed.collect()) == 7

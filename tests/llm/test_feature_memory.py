"""What a task holds while it counts the features of the texts that the classifier learns from."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from facetlake.llm import toxicity

TRIGRAMS = toxicity.log_model(np.array([0], np.int32), np.array([1]))


def test_listed():
    kind = pa.list_(pa.struct([("f", pa.string()), ("n", pa.int32())]))
    for counts in ([], [Counter()], [Counter({"=a": 2, "ab": 1}), Counter(), Counter({"é": 3})]):
        assert toxicity.listed(counts).to_pylist() == pa.array([[{"f": f, "n": n} for f, n in c.items()] for c in counts], kind).to_pylist()


def counting(monkeypatch):
    """The function that tasks run over batches (id, text, label)."""
    taken = []
    sent = SimpleNamespace(value=(TRIGRAMS, frozenset()), destroy=lambda: None)
    context = SimpleNamespace(broadcast=lambda value: sent)
    rows = SimpleNamespace(mapInArrow=lambda run, schema: taken.append(run))
    kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    monkeypatch.setattr(toxicity, "written", lambda df, name: df)
    toxicity.feature_counts(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), select=lambda *c: rows, schema={"_doc": kind}), TRIGRAMS, frozenset())
    return taken[0]


def test_counting_many_texts_takes_little_memory(monkeypatch):
    rng = np.random.default_rng(0)
    words = ["".join(w) for w in rng.choice(list("bcdfghjklmnpqrstvwxz"), (4000, 9))]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 250)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts), pa.array([0] * 1000, pa.int32())], ["_doc", "_text", "_label"])
    run, plain = counting(monkeypatch), toxicity.Scorer(toxicity.Restorer(TRIGRAMS), None)
    rows = 0
    tracemalloc.start()
    for found in run(iter([batch])):
        got = found.column(2)[0].as_py()
        assert {x["f"]: x["n"] for x in got} == plain.count(texts[rows])
        rows += found.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1000 and most < 100e6

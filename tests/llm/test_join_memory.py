"""What a Python worker keeps after a step of the n-gram join: it waits while the JVM joins, and both share an executor."""

import re
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from facetlake.llm import ngramjoin, secrets

COUNTS = ngramjoin.Counts(np.empty(0, np.int64), np.empty(0, np.int64))


class Taken(Exception):
    """Ends what made a plan, with the function that tasks were to run."""


class Table:
    """In place of a table, and of the functions of columns, as there is no session."""

    def __getattr__(self, name):
        return lambda *args, **options: self

    def mapInArrow(self, run, schema):
        raise Taken(run)


def taken(plan) -> Callable:
    functions, ngramjoin.F = ngramjoin.F, Table()
    try:
        plan()
    except Taken as found:
        return found.args[0]
    finally:
        ngramjoin.F = functions


def counting() -> Callable:
    """The function that counts what is frequent in batches (text)."""
    return taken(lambda: ngramjoin.frequent(Table(), 5))


def describing() -> Callable:
    """The function that describes batches (id, digest, text)."""
    join = ngramjoin.Join.__new__(ngramjoin.Join)
    join.n, join.num, join.den, join.id_type, join.texts = 5, 80, 100, "bigint", Table()
    join.order = SimpleNamespace(value=ngramjoin.Order(COUNTS, COUNTS, 5))
    return taken(join.described)


def texts(rng: np.random.Generator, n: int, words: int) -> list[str]:
    return [" ".join(map(str, rng.integers(0, 100_000, words))) for _ in range(n)]


def resident() -> float:
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def main() -> None:
    rng = np.random.default_rng(0)

    def batches():
        for _ in range(3):
            some = texts(rng, 700, 1000)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array([""] * len(some)), pa.array(some)], ["doc_id", "md5", "text"])

    for _ in describing()(batches()):
        pass
    described = resident()
    for _ in counting()(b.select(["text"]) for b in batches()):
        pass
    print(described, resident())


def test_steps_give_memory_back():
    """Each step works on 2.1 million words, some 80 MB of numbers; in a process of its own, as a worker is."""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", "from tests.llm import test_join_memory as t; t.resident() and print(t.resident()); t.main()"], cwd=root, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr
    before, described, counted = map(float, done.stdout.split())
    assert described - before < 40 and counted - before < 40, (before, described, counted)


def test_counts_are_those_of_all_n_grams():
    some = texts(np.random.default_rng(1), 3, 40) * 3 + ["", "a a a a a a a", "one"]
    found = pa.Table.from_batches(list(counting()(iter([pa.RecordBatch.from_arrays([pa.array(some)], ["text"])])))).to_pylist()
    for word, least in ((False, 1), (True, ngramjoin.FREQUENT // 8)):
        every = [ngramjoin.word_hashes(t).view(np.int64) if word else ngramjoin.gram_set(t, 5) for t in some]
        hashes, n = np.unique(np.concatenate(every), return_counts=True)
        assert [(r["hash"], r["n"]) for r in found if r["word"] == word] == [(h, k) for h, k in zip(hashes.tolist(), n.tolist(), strict=True) if k > least]
    assert not sum(b.num_rows for b in counting()(iter([pa.RecordBatch.from_arrays([pa.array([""])], ["text"])])))


def test_redaction_unpacks_little_text_at_a_time():
    """A task gives rows after about a megabyte of text, not after four."""
    table = Table()
    table.columns = ["text"]
    run = taken(lambda: secrets.redact(table, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    some = ["word " * 20_000] * 40
    found = list(run(iter([pa.RecordBatch.from_arrays([pa.array(some)], ["text"])])))
    assert [t for b in found for t in b.column(0).to_pylist()] == some
    assert max(b.num_rows for b in found) <= 11

"""The registered queries over the smallest tables: against their SQL, or against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from facetlake.llm import queries

from ..conftest import SF, same


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


def digest(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df())


def test_op1(spark, texts):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.no_truncation()
    coder.no_padding()
    rows = queries.op1_bpe(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = coder.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = coder.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(decoded))


def test_op2(spark, texts):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = queries.op2_secrets(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == digest(base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_op4(spark, texts):
    rows = queries.op4_media(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), digest(payload), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(payload) + 44


def test_op5(spark, texts):
    for r in queries.op5_quality(spark, SF).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
        lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(lines.values()) - len(lines), len(repeat))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_op7(spark, texts):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder.no_truncation()
    coder.no_padding()
    rows = queries.op7_packing(spark, SF).collect()
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        ids = np.array([*coder.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert sorted(parts) == list(range(-(-len(ids) // 2048)))
        for k, r in parts.items():
            own = ids[2048 * k : 2048 * (k + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(own), zlib.crc32(own.tobytes()))
    for content in bins.values():
        ends = np.cumsum([n for _, n in sorted(content)])
        assert [a for a, _ in sorted(content)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.05 * -(-total // 2048) + 1


def test_op9(spark, texts):
    rows = queries.op9_toxicity(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op9_on_rows_it_has_not_learned_from(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    known = [(r["score"], labels[r["doc_id"]]) for r in queries.op9_toxicity(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = ([s for s, y in known if y == k] for k in (1, 0))
    assert len(toxic) >= 5 and np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.85

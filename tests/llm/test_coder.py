"""The packing coder's ids against the library's on whole texts."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from facetlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The théâtre's straße, élève! ÉCOLE Straße ÿ þorn ð ñandú×÷ naïve...", "étude résumé İstanbul İzmir ΣΑΣ ſtop ﬁn 12ab ab12 a-b a.b ''s 's it'll", "", " \t\n ",
    "<|endoftext|> <|ENDOFTEXT|> word<|endoftext|>word", "zqxj " * 50 + "zqxj, zqxj. zqxj### ,.", "日本語 текст ТЕКСТ ünï µ ª º ß ẞ",
]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_words_by_the_model_alone_have_the_ids_of_whole_texts():
    c = packing.Coder(PATH)
    assert c.direct and packing.LOWER_WORD("élève".encode()) and not packing.LOWER_WORD("Élève".encode()) and not packing.LOWER_WORD("a×b".encode())
    assert c.encode(TEXTS) == whole(TEXTS)


def test_chunks_that_come_again_outlive_a_full_cache(monkeypatch):
    c = packing.Coder(PATH)
    c.encode(["common words here"])
    c.cache.bytes = c.cache.most + 1
    c.turn()
    held, asked = c.before, []
    monkeypatch.setattr(packing.Coder, "ids_of_word", lambda self, word: asked.append(word) or whole([word.decode()])[0])
    assert c.encode(["common words again"]) == whole(["common words again"])
    assert asked == [b"again"] and b"here" in held and b"common" not in held

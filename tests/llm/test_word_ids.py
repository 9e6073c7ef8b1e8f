"""Ids of texts that are encoded together, and what a worker remembers of them."""

import random

import pyarrow as pa
import pytest

from symgraph.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


ODD = [
    "", " ", "\n\t", " a", "b ", "...", "é!!", "É?! x.", "ß.,;", "a-b\"", "日本語。!", "x́!", "²!", "½.", "٠.", "a\x00b. \x00", "\x1c\x85a!", "İ! ΑΣ.", "ﬁ.!",
    "UPPER'S don't. I'll!!", "a" * 33 + "!", "B" * 60 + " " + "c" * 49 + ".", "<|endoftext|>!", "\U0001f600!", "12.5 %", "ŉ.", "ǅ!", "\x7f!", "_!", "a_!", "\u0958!", "\ufb1d.", "\xa0!", "K!",
]


@pytest.mark.parametrize("size", [1, 40, 10**9])
def test_ids_of_many_texts(tokenizer, size):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choices([w for t in ODD for w in t.split()], k=rng.randrange(9))) for _ in range(300)]
    words = packing.WordTokenizer(packing.tokenizer_path())
    got = []
    for part in packing._portions(pa.array(["cut", *texts]).slice(1), size):
        got += words.encode_all(part, (1).to_bytes(4, "little")).to_pylist()
    assert len(got) == len(texts)
    for text, ids in zip(texts, got, strict=True):
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_words_that_come_again_are_learnt_once(monkeypatch):
    """However many others come between: what is forgotten is what didn't come again."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words, learnt = packing.WordTokenizer(packing.tokenizer_path()), []
    own = words._ids
    monkeypatch.setattr(words, "_ids", lambda texts: learnt.extend(texts) or own(texts))
    rng = random.Random(6)
    for _ in range(40):
        words.encode("often again, " + " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(20)))
    assert learnt.count(b"often") == learnt.count(b"again") == 1 and len(learnt) > 700
    assert len(words.latest) <= 50 and len(words.before) <= 50

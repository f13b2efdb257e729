import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer as Library
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from veilframe.llm import common
from veilframe.llm.bpe import Tokenizer, decode, encode
from veilframe.llm.common import slices

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "   ", "Hello, World's don't\n\t x", "café CAFÉ é", "a<|endoftext|>b <|startoftext|> c", "x y z\x1fk\x85w​q",
    "İ ΣΑΣ ß ﬁ", "123abc", "日本語 テスト", "'S 'sx a'rex", "́a", "<|ENDOFTEXT|> <|endoftext|",
    "١٢ ½ Ⅷ", "a\x00b", "\U0001f600\U0001f600 x", "a_b-c!!!x", "\x1c\x1d\x1e\x1f|\x0b\x0c᠎﻿", "e<|endoftext|>́e", "a" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def test_equals_library(library):
    rng = random.Random(5)
    signs = "aAbethtiéσΣ ́\n\x1f\x7f'sdl123!?.<|>語ñ ­\x80\U0001f600"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    parts = ["th", "in", "er", "an", "re", "on", "st", "ing", "a", "e", "s", "ou", "tion", "x", "q"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    ids, counts = Tokenizer(PATH).encode(texts)
    at = 0
    for text, n, want in zip(texts, counts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == want.ids, text
        at += n


def test_frames(spark, odd_docs, no_docs, library):
    both = decode(encode(odd_docs, PATH), PATH)
    assert both.columns == [*odd_docs.columns, "ids", "decoded"]
    for r in both.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode(no_docs, PATH).collect() == []
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in decode(nothing, PATH).collect()] == ["", ""]


def test_learned_words_take_few_bytes():
    """Ids of learned words stay in each Python process, so they are kept as bytes, not as lists of numbers."""
    tokenizer = Tokenizer(PATH)
    tokenizer.encode(["information retrieval zqxjkvbw 12345 naïveté"])
    assert all(isinstance(ids, bytes) and len(ids) % 4 == 0 for ids in tokenizer.lately.values())


def test_slices_are_bounded_and_whole():
    texts = pa.array(["ab", None, "é" * 5, "", "x" * 40, "yz", "w" * 9, "v"])
    got = list(slices(texts, 12))
    assert [texts.slice(*s).to_pylist() for s in got] == [["ab", None, "é" * 5, ""], ["x" * 40], ["yz", "w" * 9, "v"]]
    assert list(slices(texts[:0])) == []


def test_tasks_give_memory_back(monkeypatch):
    """Only once all batches are worked on and the function's own variables are gone."""
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append("given back"))

    def work(batches):
        for b in batches:
            yield b
        done.append("worked")

    assert list(common.tidy(work)(iter([1, 2]))) == [1, 2] and done == ["worked", "given back"]
    monkeypatch.undo()
    common.give_back()


def test_a_kept_text_is_sent_once(odd_docs):
    """Tasks get the text that they also return, not a copy of it beside it."""
    plan = encode(odd_docs, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "encoded_text" not in plan

import random
import re

import numpy as np
import pytest
from compare import connect, differences
from conftest import SF
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from veilframe.llm import decontaminate, oracle, queries
from veilframe.llm.decontaminate import FmIndex, Phrases, contamination, decontaminated

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(text, items, width):
    own = words(text)
    hit, found = set(), set()
    for item, phrase in items:
        theirs = words(phrase)
        k = min(width, len(theirs))
        windows = {tuple(theirs[i : i + k]) for i in range(len(theirs) - k + 1)} if theirs else set()
        for i in range(len(own) - k + 1) if windows else ():
            if tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(own), sorted(hit), sorted(found)


def answers(frame):
    return sorted(
        (str(r.id), r.n_words, [i for s in r.spans for i in range(s.start, s.end)], list(r["items"])) for r in frame.collect()
    )


def expected(docs, items, width):
    return sorted((str(i), *brute_force(text, items, width)) for i, text in docs)


def made_tables(seed, vocabulary=12, docs=120, items=25):
    rng = random.Random(seed)
    pool = [f"W{i}" if i % 3 else f"é{i}" for i in range(vocabulary)]
    phrase = lambda n: " ".join(rng.choices(pool, k=n))
    bench = [(i % (items - 2), phrase(rng.choice([0, 1, 2, 3, 4, 5, 9]))) for i in range(items)]
    texts = [(i, rng.choice([", ", "\n", "-"]).join(words(phrase(rng.randrange(60))) + ["new"] * rng.randrange(2))) for i in range(docs)]
    return texts + texts[:5], bench


def test_query_matches_sql(spark):
    assert differences(queries.decontamination(spark, SF), oracle.ORACLE["op12_decontamination"], connect(SF)) == []


@pytest.mark.parametrize("shard, block, piece", [(400_000, 2_000_000, 50_000), (70, 2_000_000, 3), (300, 40, 2)])
def test_spans_match_brute_force(spark, monkeypatch, shard, block, piece):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    docs, bench = made_tables(shard)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert answers(contamination(spark, rows, items, width=4, shard_words=shard)) == expected(docs, bench, 4)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(7)
    for _ in range(30):
        symbols = int(rng.integers(1, 40))
        text = rng.integers(0, symbols + 1, int(rng.integers(1, 400)))
        if rng.random() < 0.5:  # long repeats
            text = np.tile(text, 4)
        text[-1] = 0
        pieces = [" ".join(map(str, rng.integers(1, symbols + 1, int(rng.integers(1, 7))))).encode() for _ in range(40)]
        phrases = Phrases(["x"] * len(pieces), pieces, 3)
        numbers = {int(w): n for w, n in phrases.vocabulary.items()}
        coded = np.array([numbers.get(int(t), 0) for t in text])
        which, places = FmIndex(coded, len(numbers)).search(phrases)
        got = sorted(zip(which.tolist(), places.tolist(), strict=True))
        want = []
        for w, (window, length) in enumerate(zip(phrases.windows, phrases.lengths, strict=True)):
            want += [(w, i) for i in range(len(coded) - length + 1) if (coded[i : i + length] == window[-length:]).all()]
        assert got == sorted(want)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    long = next(t for i, t in docs if i == 10)
    bench = [(1, " ".join(words(long)[5000:5020])), (1, "word"), (None, "WORD"), (7, None), (8, ""), (9, "?!"), (2, " ".join(words(docs[0][1] or "x")))]
    items = spark.createDataFrame([(*b, "k") for b in bench], "item_id long, text string, Doc_Id string")
    found = answers(contamination(spark, odd_docs, items))
    assert found == expected(docs, bench, 10)
    assert any(len(hit) >= 20 for _, _, hit, _ in found)
    empty = spark.createDataFrame([], items.schema)
    assert [a[2:] for a in answers(contamination(spark, odd_docs, empty))] == [([], [])] * len(docs)
    assert contamination(spark, no_docs, items).collect() == []


def test_spans_do_not_reach_into_the_next_text(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a b c d"), (4, "a b"), (5, "a b")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b c d"), (2, "b"), (3, "a")], "item_id long, text string")
    want = expected([(1, "a b"), (2, "c d"), (3, "a b c d"), (4, "a b"), (5, "a b")], [(1, "a b c d"), (2, "b"), (3, "a")], 4)
    assert answers(contamination(spark, rows, items, width=4)) == want


def test_removal(spark):
    passage = "One two, THREE four-five six; seven eight nine ten."
    rows = spark.createDataFrame(
        [(1, f"Before é. {passage} After."), (2, "clean text"), (3, None), (4, passage + passage), (5, "")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    got = {r.id: (r.text, r.n_hit, r["items"]) for r in decontaminated(spark, rows, items).collect()}
    assert got == {1: ("Before é. . After.", 10, ["1"]), 2: ("clean text", 0, []), 3: (None, 0, []), 4: (".", 20, ["1"]), 5: ("", 0, [])}

"""Language, quality and class models: held-out accuracy, brute force, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from veilframe.llm import classlm, langid, quality
from veilframe.llm.common import bounded_sample, held_out, learnable
from veilframe.llm.queries import QUERIES


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_folds(spark):
    rows = spark.createDataFrame([(1,), (25,), (None,)], "doc_id long").select("doc_id", held_out("doc_id", 5, 0), learnable("doc_id", 5, 0))
    assert [tuple(r) for r in rows.collect()] == [(i, fold(i, 5) == 0, fold(i, 5) != 0) for i in (1, 25)] + [(None, False, False)]


def test_bounded_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 50 = 0, 'rare', 'hot') AS g")
    first = [bounded_sample(rows.repartition(n), "g", "id", 60).groupBy("g").agg(F.count("*"), F.sum("id")).orderBy("g").collect() for n in (1, 7)]
    assert first[0] == first[1] and [r[1] for r in first[0]] == [60, 60]


def phrases(text, known):
    """Greedy longest matches, block by block, by plain substring search."""
    count = 0
    for start in range(0, len(text), langid.BLOCK):
        block, at = text[start : start + langid.BLOCK], 0
        while at < len(block):
            end = at + 1
            while end < len(block) and block[at : end + 1] in known:
                end += 1
            count, at = count + 1, end
    return count


def test_phrase_counts_equal_substring_search():
    samples = (("aa", ("abracadabra abra ",)), ("bb", ("barbara barbarossa bar ",)))
    parser = langid.Parser(samples)
    texts = ["abrabarba", "rossabra cadabra", "zzz", "a", "barbarossa abracadabra " * 60]
    symbols, sizes, letters = parser.symbols(texts)
    got = parser.phrases(symbols, sizes)
    ends = np.cumsum(sizes)
    for language, (_, sample) in enumerate(samples):
        known = "".join(map(chr, parser.symbols(list(sample))[0]))
        for t, end in enumerate(ends):
            assert got[language, t] == phrases("".join(map(chr, symbols[end - sizes[t] : end])), known)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op2_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) > 0.93
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(spark, odd_docs, no_docs):
    everything = langid.train(odd_docs, F.lit(True))
    assert [n for n, _ in everything] == ["de", "en", "fr"]
    got = odd_docs.select("text", langid.predicted(F.col("text"), everything).alias("p")).collect()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert tuple(r.p) == ("und", 0.0)
        else:
            assert r.p.lang in ("de", "en", "fr") and 0 <= r.p.score <= 1
    nothing = langid.train(no_docs, F.lit(True))
    assert nothing == () and {r.p.lang for r in odd_docs.select(langid.predicted(F.col("text"), nothing).alias("p")).collect()} == {"und"}
    assert no_docs.select(langid.predicted(F.col("text"), everything)).collect() == []


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")  # the smaller ones hold a few bad documents only
    found = QUERIES["op7_quality"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r for r in found if r.quality == q] for q in (1, 0))
    assert len(bad) > 50 and np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_additive_model_finds_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing to see in a single feature
    model = quality.fit(x[:3000], y[:3000], pairs=1)
    assert model.pairs == [(1, 0)] and np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.95
    total = model.base + sum(t[b] for t, b in zip(model.tables, model.bins(x, model.edges), strict=True))
    coarse = model.bins(x, model.coarse)
    total += model.pair_tables[0][coarse[1], coarse[0]]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)))


def test_quality_scores_do_not_drift_with_the_number_of_labels(spark):
    """Four of five rows have label 1, and texts say nothing about it. With ten times the rows the sample is capped."""
    means = []
    for rows in (200, 2000):
        table = spark.range(rows).selectExpr("id AS doc_id", "concat('some words ', id % 7) AS text", "IF(id % 5 = 0, 0, 1) AS quality").cache()
        model = quality.train(table.select("doc_id", "text"), table.select("doc_id", "quality"), F.lit(True), per_class=160)
        means.append((model.base, table.select(F.avg(quality.scored(F.col("text"), model))).first()[0]))
    (small, small_mean), (large, large_mean) = means
    assert large == pytest.approx(small, abs=0.02) and small_mean == pytest.approx(0.8, abs=0.03) and large_mean == pytest.approx(0.8, abs=0.03)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, 0), (None, 1, 1), (99, 0, 0), (13, 5, 0), (8, 0, 0)], "doc_id long, quality int, toxic int"
    )
    model = quality.train(odd_docs, labels, learnable("doc_id", 5, 0))
    scores = odd_docs.select(quality.scored(F.col("text"), model).alias("s")).collect()
    assert len(scores) == odd_docs.count() and all(0 <= r.s <= 1 for r in scores)
    for rows in (labels.where("quality = 1"), labels.where("false")):
        alike = quality.train(odd_docs, rows, F.lit(True))
        assert len({r.s for r in odd_docs.select(quality.scored(F.col("text"), alike).alias("s")).collect()}) == 1
    assert no_docs.select(quality.scored(F.col("text"), model)).collect() == []


def test_exchange_separates_alternating_words():
    counts = np.zeros((7, 7))
    for a in (1, 2, 3):  # 1-3 are always followed by 4-6, and the other way round
        for b in (4, 5, 6):
            counts[a, b] = counts[b, a] = 50 + a + b
    counts[0, 1] = counts[4, 0] = 5
    own = classlm.exchange(counts, 3)
    assert own[0] == 0 and own[1] == own[2] == own[3] != own[4] == own[5] == own[6]


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_class_model_counts(spark, odd_docs, head):
    """Base figures by brute force, whether words are broadcast or joined, and the score by the model's own tables."""
    may = learnable("doc_id", 7, 2)
    model = classlm.train(odd_docs, may, classes=5, core=20, endings=10, head=head)
    got = classlm.score(odd_docs, model, keep=["row"]).collect()
    rows = {r.row: r for r in odd_docs.collect()}
    tokens = {i: (r.text or "").encode().lower().split() + [b""] for i, r in rows.items()}
    count = Counter(w for i, ws in tokens.items() if rows[i].doc_id is not None and fold(rows[i].doc_id, 7) != 2 for w in ws)
    total, distinct, lex = sum(count.values()), len(count), model.lexicon
    assert (model.tokens, model.distinct) == (total, distinct)
    assert len(got) == len(rows)
    for r in got:
        words = tokens[r.row]
        assert (r.n_tokens, r.n_known) == (len(words), sum(count[w] > 0 for w in words))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words))
        want, before = 0.0, 0
        for w in words:
            c = lex.classes[lex.units[w]]
            want += lex.moves[before, c] + (math.log10(count[w]) + lex.known[c] if count[w] else lex.unknown[c])
            before = c
        assert r.score == pytest.approx(want)
    # Probabilities sum to one: over classes, and over a class's words with the unknown one.
    assert np.allclose((10**lex.moves).sum(axis=1), 1)
    mass = 10**lex.unknown
    for w, n in count.items():
        c = lex.classes[lex.units[w]]
        mass[c] += n * 10 ** lex.known[c]
    filled = [c for c in range(5) if any(lex.classes[lex.units[w]] == c for w in count)]
    assert np.allclose(mass[filled], 1)


def test_tokens_are_cut_without_an_object_each(monkeypatch):
    """All texts of a chunk at once; the same words as bytes.split() gives, and an end token after each text."""
    rng = np.random.default_rng(5)
    signs = [*"aB\u00c9z \t\n\v\f\r\x1c\x1f\x85\xa0\u3000\x00.", "Ab", "  "]
    texts = ["", " ", "a", " A b\x0bc ", "\u65e5\u672c X", *("".join(rng.choice(signs, n)) for n in rng.integers(0, 40, 300)), "", ""]
    want = [[*t.encode().lower().split(), b""] for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for array in (pa.array(texts, kind), pa.array(["x y", *texts, "z"], kind).slice(1, len(texts))):
            distinct, used, lengths = classlm._coded(array)
            names = distinct.to_pylist()
            assert len(set(names)) == len(names) and lengths.tolist() == [*map(len, want)]
            assert [names[i] for i in used.tolist()] == [w for ws in want for w in ws]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    counted = Counter(dict(zip(*(c.to_pylist() for b in classlm._count_words(iter([batch])) for c in b.columns), strict=True)))
    assert counted == Counter(w for ws in want for w in ws)


def test_distinct_rows_of_wide_columns():
    """Rows are told apart by one number each, also where the columns' ranges multiply beyond 64 bits."""
    rng = np.random.default_rng(6)
    for most in (3, 1 << 40):
        columns = [rng.choice(np.array([-most, -1, 0, 7, most]), 500) for _ in range(4)]
        rows = Counter(zip(*(c.tolist() for c in columns), strict=True))
        at, n = classlm._distinct(*columns)
        assert {tuple(int(c[i]) for c in columns): int(k) for i, k in zip(at, n, strict=True)} == rows and len(at) == len(rows)
    none = np.empty(0, np.int64)
    assert [len(x) for x in classlm._distinct(none, none)] == [0, 0]


def test_class_model_without_rows(spark, odd_docs, no_docs):
    model = classlm.train(no_docs, F.lit(True), classes=4)
    got = classlm.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r.n_known == 0 and math.isfinite(r.score) and r.base_score == 0 for r in got)
    assert classlm.score(no_docs, model).collect() == []


def class_table(sequence, own, classes):
    table = np.zeros((classes, classes))
    for a, b in zip([0, *sequence[:-1]], sequence, strict=True):
        table[own[a], own[b]] += 1
    return table


def test_better_classes_by_recounting():
    """Each word's new class is the one with the highest likelihood of bigrams that are counted anew; rare words come close to it."""
    rng = np.random.default_rng(3)
    sequence = [int(x) for x in np.minimum(rng.integers(0, 12, 4000) + 3 * (np.arange(4000) % 2), 12)]
    own = np.array([0, *(1 + np.arange(12) % 4)])
    table = class_table(sequence, own, 5)
    bigrams = class_table(sequence, np.arange(13), 13)
    member = np.eye(5)[own]
    right, left, twice = bigrams @ member, bigrams.T @ member, np.diag(bigrams)
    for w, got in list(enumerate(classlm.better_classes(table, own, right, left, twice)))[1:]:
        tried = [classlm.likelihood(class_table(sequence, [*own[:w], c, *own[w + 1 :]], 5)) for c in range(1, 5)]
        assert tried[got - 1] == pytest.approx(max(tried), abs=1e-6)
    # Rare words: four that come up three times each.
    rare = sequence + [1, 13, 2, 5, 14, 6, 9, 15, 10, 1, 16, 1] * 3
    own = np.array([*own, 4, 1, 2, 3])
    table, bigrams, member = class_table(rare, own, 5), class_table(rare, np.arange(17), 17), np.eye(5)[own]
    got = classlm.better_rare_classes(table, own[13:], (bigrams @ member)[13:], (bigrams.T @ member)[13:])
    for w, c in enumerate(got, start=13):
        tried = [classlm.likelihood(class_table(rare, [*own[:w], k, *own[w + 1 :]], 5)) for k in range(1, 5)]
        assert tried[c - 1] == pytest.approx(max(tried), abs=0.02)


@pytest.mark.parametrize("head", [1 << 18, 6])
def test_every_word_is_clustered(spark, head):
    """Words beyond the core that end alike, whether broadcast or joined: they get their class from their neighbours, and bigrams are those of all classes."""
    rows = [(i, f"the n{i % 2 * (i % 41)}same to v{i % 3 * (i % 37)}same") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = classlm.train(docs, F.lit(True), classes=5, core=4, endings=4, head=head, prior=1e-9)
    lex = model.lexicon
    assert (model.vocabulary.count() > 0) == (head == 6)
    of = lambda w: int(lex.classes[lex.units[w]])
    nouns, verbs = ({of(w) for _, t in rows if (w := t.split()[at].encode())} for at in (1, 3))
    assert len(nouns) == len(verbs) == 1 and nouns != verbs
    table = np.zeros((5, 5))
    for _, text in rows:
        before = 0
        for w in [*text.encode().split(), b""]:
            table[before, of(w)] += 1
            before = of(w)
    used = table.sum(axis=1) > 0
    assert np.allclose(10 ** lex.moves[used], table[used] / table[used].sum(axis=1, keepdims=True))

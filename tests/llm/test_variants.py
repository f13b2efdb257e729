import random
import zlib

import pytest
from compare import connect, differences
from conftest import SF
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from veilframe.llm import oracle, queries, variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(words, times):
    out, forms = {}, {}
    for word, n in words.items():
        near = sorted((-words[o], o) for o in words if one_edit(word, o))
        if near and -near[0][0] >= times * n:
            forms[word] = near[0][1]
        out[word] = (n, len(near))
    rows = []
    for word, (n, n_near) in out.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        rows.append((word, form, root, n, n_near, words[form] if form else None))
    return sorted(rows)


def found(spark, words, times=5):
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = variants.variants(frame, times).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in rows)


def test_query_matches_sql(spark):
    assert differences(queries.spelling(spark, SF), oracle.ORACLE["op13_variants"], connect(SF)) == []


@pytest.mark.parametrize("seed, letters, sizes", [(1, "ab", (4, 9)), (2, "abcé", (4, 8)), (3, "a", (4, 30)), (4, "abcdefgh", (5, 6))])
def test_all_pairs_match_brute_force(spark, seed, letters, sizes):
    """Few letters make repeated bigrams, equal counts and long chains."""
    rng = random.Random(seed)
    words = {}
    for _ in range(300):
        word = "".join(rng.choices(letters, k=rng.randint(*sizes)))
        words[word] = rng.choice([1, 1, 2, 5, 10, 50, 260, 1300])
        at = rng.randrange(len(word))
        if len(word) > 4:
            words[word[:at] + word[at + 1 :]] = rng.choice([1, 5, 26])
    assert found(spark, words) == brute_force(words, 5)


def test_crowded_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(variants, "SLICE_PIVOTS", 3)
    words = {f"qx{a}{b}zzzz": 1 + ord(a) for a in "abcdefghij" for b in "klmnop"}
    assert found(spark, words) == brute_force(words, 5)


def test_long_chains_reach_their_root(spark):
    words = {"a" * i: 2**i for i in range(4, 20)}
    rows = found(spark, words, times=2)
    assert rows == brute_force(words, 2) and {r[2] for r in rows} == {"a" * 19}
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame([], "word string, n long"), 1)


def test_runs_and_misspellings(spark, odd_docs, no_docs):  # noqa: F811
    extra = spark.createDataFrame([(i, "Éclair ÀB×CD÷ef naïve-Straße x ZZĀſ 12ab") for i in range(400)], "doc_id long, text string")
    for docs in (odd_docs, extra):
        rows = variants.runs(docs)
        got = sorted(tuple(r) for r in rows.select("id", "run", variants.misspelled(rows, 7).alias("word")).collect())
        want = []
        for r in docs.select("doc_id", "text").collect():
            run, text = "", (r.text or "") + "\n"
            for c in text:
                if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                    run += c.lower() if c.isascii() else c
                elif run:
                    name = "" if r.doc_id is None else str(r.doc_id)
                    h = zlib.crc32(f"{name}:{run}".encode())
                    want.append((name, run, run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run))
                    run = ""
        assert got == sorted(want)
    rows = variants.runs(no_docs)
    empty = variants.vocabulary(rows.select(F.col("run").alias("word")), 6, 5)
    assert variants.variants(empty).collect() == []


def test_very_long_words(spark):
    base = "".join(random.Random(9).choices("abcdefghij", k=3_000))
    words = {base: 100, base[:700] + base[701:]: 2, base + "k": 3, base[:-2]: 1}
    assert found(spark, words) == brute_force(words, 5)

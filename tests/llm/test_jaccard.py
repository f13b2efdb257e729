import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from veilframe.llm import jaccard
from veilframe.llm import shingles as shingling
from veilframe.llm.common import SLICE_BYTES
from veilframe.llm.components import components
from veilframe.llm.jaccard import close_sets, first_shingles, linked, near_duplicates, print_of, signatures
from veilframe.session import materialize

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b) > 0:
            low, high = sorted((find(i), find(j)))
            parent[high] = low
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def check(docs, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_duplicates(docs, width, percent).collect()), key=repr)
    assert got == brute_force(rows, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_odd_rows(odd_docs, width, percent):
    check(odd_docs.where("doc_id is null or doc_id <> 11"), width, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_chains_and_large_families_in_blocks(spark, monkeypatch, percent):
    # Each text drops a word of the one before: neighbours link, ends don't. Small blocks force both rounds.
    for name, value in (("BLOCK_SETS", 4), ("MOST_BLOCK_SETS", 4)):
        monkeypatch.setattr(jaccard, name, value)
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[i * 2 : i * 2 + 80])) for i in range(30)]
    rows += [(100 + i, " ".join(words[:60] + [f"v{i}x{j}" for j in range(i % 9)])) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2, percent)


def test_sets_that_link_share_a_signature():
    rng = np.random.default_rng(3)
    for size in [1, 2, 5, 9, 10, 11, 19, 20, 40, 150, 700]:
        for percent in (80, 90):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = (100 - percent) * len(a) // 100
            for gone in range(most + 1):
                b = a[gone:]
                if 100 * len(b) < percent * len(a) or not len(b):
                    continue
                key, owner = signatures([a, b], percent)
                assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()), (size, percent, gone)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_the_smaller_of_two_linked_sets_is_indexed_under_a_first_shingle_of_the_larger(spark, percent):
    rng = np.random.default_rng(percent)
    sets, linking = [], []
    for size in [1, 2, 5, 9, 10, 19, 20, 41, 150]:
        for _ in range(12):
            both = rng.integers(0, 1 << 62, size)
            a, b = (np.unique(np.append(both, rng.integers(0, 1 << 62, rng.integers(0, size // 5 + 2)))) for _ in "ab")
            a, b = sorted((a, b), key=len)
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                linking.append((len(sets), len(sets) + 1))
            sets += [a, b]
    rows = [(i, len(s), int(x)) for i, s in enumerate(sets) for x in s]
    got = first_shingles(spark.createDataFrame(rows, "node long, tag long, shingle long"), percent).collect()
    firsts, indexed = {}, {}
    for r in got:
        firsts.setdefault(r.node, set()).add(r.family)
        indexed.setdefault(r.node, set()).update([r.family] if r.indexed else [])
    assert len(linking) > 20
    assert all(indexed.get(a, set()) & firsts.get(b, set()) for a, b in linking)


def test_sets_that_are_not_indexed_meet_only_those_that_are():
    sets = [np.arange(10, dtype=np.uint64)] * 3
    assert linked([1, 2, 3], sets, 90, [1, 2, 3], [False, False, False]) == []
    assert {frozenset(x) for x in linked([1, 2, 3], sets, 90, [1, 2, 3], [False, True, False])} == {frozenset((1, 2)), frozenset((2, 3))}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_copies_that_share_signatures_but_hardly_link(spark, monkeypatch, width, percent):
    # Copies with one to four words changed: few link, all share much. Some are pairs that link with each other only.
    for name, value in (("BLOCK_SETS", 4), ("MOST_BLOCK_SETS", 8)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(160):
        words = [f"w{k}" for k in range(60)]
        for at in rng.choice(60, i % 5, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
        if i % 7 == 0:
            rows.append((1000 + i, " ".join([*words, "more"])))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width, percent)


def test_sets_that_link_are_close_by_their_prints():
    rng = np.random.default_rng(5)
    told = {True: [], False: []}
    for _ in range(600):
        percent, size = int(rng.choice([50, 80, 90, 100])), int(rng.choice([1, 2, 9, 20, 41, 150, 330, 700]))
        both, share = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2), rng.choice([0, 0.03, 0.06, 0.1])
        a, b = (np.unique(np.append(both[rng.random(size) >= share], rng.integers(0, 1 << 63, rng.integers(0, size // 8 + 2), dtype=np.uint64))) for _ in "ab")
        if len(a) and len(b):
            link = 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            told[link].append(close_sets(np.array([1, 2]), np.array([len(a), len(b)]), [print_of(a, percent), print_of(b, percent)], percent).all())
    assert len(told[True]) > 100 and all(told[True])
    assert len(told[False]) > 100 and sum(told[False]) < 0.2 * len(told[False])


def test_sets_of_one_component_are_not_close():
    prints = [print_of(np.arange(9, dtype=np.uint64) << np.uint64(60), 90)] * 3
    assert close_sets(np.array([1, 1, 1]), np.array([9, 9, 9]), prints, 90).tolist() == [False] * 3
    assert close_sets(np.array([1, 1, 2]), np.array([9, 9, 9]), prints, 90).tolist() == [True] * 3


def test_texts_are_picked_out_where_they_lie_and_pointers_are_not_multiplied(spark, monkeypatch):
    # Copies of three texts with single words changed: each shares signatures with many others of its batch and of other batches.
    plans = {}

    def keep_plan(frame, label):
        plans.setdefault(label, []).append(frame._jdf.queryExecution().toString())
        return materialize(frame, label)

    monkeypatch.setattr(jaccard, "materialize", keep_plan)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        words = [f"t{i % 3}w{k}" for k in range(70)]
        for at in rng.choice(70, i % 4, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["bodies"] and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans["bodies"])
    assert plans["pointed"] and not any("Generate" in p for p in plans["pointed"])


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7), (20, 20)] + [(100, 100 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 6)} | {7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 150)}


def test_sketch_holds_the_sets_of_a_slice(monkeypatch):
    """Texts are taken a bounded slice at a time; of equal sets, also across slices, the smallest id stands for all that have an id."""
    asked = []
    plain = jaccard.shingle_sets
    monkeypatch.setattr(jaccard, "shingle_sets", lambda texts, width: asked.append(sum(map(len, texts))) or plain(texts, width))
    long = ["a b c " * 500_000, "d e f g " * 400_000]
    texts = [long[0], "", "x y z u", long[1], "X y  z u", "q", long[0] + " ", "x y z u"]
    ids = [7, 8, 3, 6, 2, 1, 5, None]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], names=["id", "text"])
    first, *packed = jaccard._sketch(3, 80, 5)(iter([batch]))
    assert len(asked) > 1 and max(asked) <= SLICE_BYTES
    assert first["node"].to_pylist() == ids
    assert first["other"].to_pylist()[:7] == [5, 8, 2, 6, 2, 1, 5] and first["other"].to_pylist()[7] is None
    assert first["size"].to_pylist() == [3, 0, 2, 4, 2, 1, 3, 2]
    keys = [k for p in packed for k in p["key"].to_pylist()]
    assert keys == sorted(set(keys)) and set(keys) <= set(range(5))
    nodes = {n for p in packed for body in p["packed"].to_pylist() for n in jaccard._unpack(body)[1].tolist()}
    assert nodes == {1, 2, 5, 6}


def test_powers_of_long_texts_are_not_kept():
    assert len(list(shingling.shingle_sets(["a b " * 800_000, "c"], 2))) == 2
    assert all(len(x) <= 2 * shingling.CHUNK_BYTES for x in shingling._powers)

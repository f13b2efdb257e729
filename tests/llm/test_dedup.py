import hashlib

import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from veilframe.llm.common import split_by_keys
from veilframe.llm.dedup import drop_duplicates, duplicate_groups


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_groups_equal_brute_force(odd_docs, keep, fan_in):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    got = [tuple(r) for r in duplicate_groups(odd_docs, keep=keep, fan_in=fan_in).collect()]
    best = max if keep == "largest" else min
    want = []
    for i, text in rows:
        ids = [j for j, t in rows if t == text]
        known = [j for j in ids if j is not None]
        want.append((i, best(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=repr) == sorted(want, key=repr)
    # Exactly one row of each text is kept, and it is the one named.
    kept = [(e, a, b) for a, b, _, k, e in got if k]
    assert len(kept) == len({e for e, _, _ in kept}) == len({t for _, t in rows})
    assert all(a == b for _, a, b in kept)


def test_hot_text_over_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', concat('t', id)) AS text").repartition(40)
    got = duplicate_groups(docs).where("sha256 = sha2('same', 256)").groupBy("keep_id", "group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(2997, 1000, True, 1), (2997, 1000, False, 999)}


def test_drop_keeps_all_columns(odd_docs):
    kept = drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd_docs.collect()})


def test_empty(no_docs):
    assert duplicate_groups(no_docs).collect() == []
    assert drop_duplicates(no_docs).collect() == []


def test_bad_arguments(no_docs):
    with pytest.raises(ValueError):
        duplicate_groups(no_docs, keep="any")
    with pytest.raises(ValueError):
        duplicate_groups(no_docs, fan_in=1)


def test_texts_that_stay_are_not_shuffled_however_many_go(spark):
    rows = [(i, f"text {i % 40}") for i in range(60)] + [(None, "text 1"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = drop_duplicates(docs)
        assert sorted(r.doc_id for r in left.collect()) == [*range(20, 60), 100]
        # One part of the rows comes through a broadcast filter only.
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftAnti" in plan.split("BroadcastHashJoin", 1)[1].split("\n", 1)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_split_by_keys_without_losing_any(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(500)] + [(None, "none")], "k int, filter_word string")
    keys = spark.createDataFrame([(i,) for i in range(0, 500, 5)], "k long")
    may, none = split_by_keys(rows, keys, "k")
    first, second = ([r.k for r in part.collect()] for part in (may, none))
    assert sorted(first + second, key=str) == sorted([*range(500), None], key=str)
    assert set(range(0, 500, 5)) <= set(first) and len(first) < 150
    assert may.columns == none.columns == rows.columns

"""A registry over several runs: old ids stay, new people follow, nothing is half committed."""

import os

import pytest
from conftest import AS_OF, ordered
from pyspark.sql import functions as F

from veilframe import Registry, Sheet, Workbook, clean_workbook, preview
from veilframe.operators.ids import format_id
from veilframe.operators.registry import RegistryConflict
from veilframe.plans.rules import Rule, RuleSet
from veilframe.sinks.outputs import write_outputs

RULES = RuleSet((Rule("equals", "nhi", "anonymize", output_name="ID"), Rule("equals", "carer", "anonymize", output_name="Carer")))


def run(registry, *sheets):
    return clean_workbook(Workbook(list(sheets)), RULES, registry, as_of=AS_OF)


def model(ids, rows):
    """The sequential rule: one counter, one dictionary."""
    out = []
    for row in rows:
        keys = [(c or "").strip() for c in row]
        out.append(tuple(ids.setdefault(k, f"ID-{len(ids) + 1:03d}") if k else "" for k in keys))
    return list(dict.fromkeys(out))


def test_runs_follow_the_sequential_rule(spark, sheet, tmp_path):
    registry, ids = Registry(spark, str(tmp_path / "r")), {}
    runs = [
        [("b", "a"), (" a ", None), ("", "c")],
        [("c", "d"), ("e", "b"), ("d", "f"), ("e", "b")],
        [("a", "b")],
        [("g", "")],
    ]
    for version, rows in enumerate(runs):
        book = run(registry, sheet("NHI string, Carer string", rows))
        assert ordered(book["sheet"]) == model(ids, rows)
        book.commit_ids()
        assert {r.key: r.id for r in registry.read().collect()} == ids
    assert registry.versions() == [1, 2, 3]  # the third run met nobody new
    assert sorted((r.version, r.number) for r in registry.read().collect()) == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6), (3, 7)]
    assert registry.compact() == 4 and len(registry.newest().parts) == 1
    assert {r.key: r.id for r in registry.read().collect()} == ids
    assert registry.newest().next_number == 8


@pytest.mark.parametrize("limit", ["10MB", "1500b", "-1"])
def test_every_join_gives_the_same_ids(spark, tmp_path, limit):
    """A hot key, many keys, and registries on either side of the broadcast limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    registry, ids = Registry(spark, str(tmp_path / "r")), {}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for low, count in ((0, 2000), (1990, 15), (1500, 2500)):
            rows = spark.range(count).select(
                F.col("id").alias("_pos"),
                F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") + low)).alias("NHI"),
            )
            book = run(registry, Sheet("s", rows, "_pos"))
            want = model(ids, [("hot" if i % 3 == 0 else f"k{i + low}",) for i in range(count)])
            assert ordered(book["s"]) == want
            book.commit_ids()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_a_commit_counts_and_only_the_first(spark, sheet, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    first, second = (run(registry, sheet("NHI string", [(k,)])) for k in ("x", "y"))
    assert first["sheet"].rows.first().ID == second["sheet"].rows.first().ID == "ID-001"
    assert registry.versions() == [] and registry.read().count() == 0
    assert first.commit_ids() == 1 and first.commit_ids() == 1
    with pytest.raises(RegistryConflict):
        second.commit_ids()
    second.mapping.discard()
    assert len(os.listdir(tmp_path / "r" / "keys")) == 1
    # Two commits of one version at the same moment: the second rename finds its target taken.
    with pytest.raises(RegistryConflict):
        registry._commit(registry.newest())
    assert [f for f in os.listdir(tmp_path / "r" / "commits") if not f.endswith(".crc")] == ["000000000001.json"]
    again = run(registry, sheet("NHI string", [("y",), ("x",)]))
    assert ordered(again["sheet"]) == [("ID-002",), ("ID-001",)]


def test_a_preview_lends_and_outputs_commit(spark, sheet, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    book = run(registry, sheet("NHI string, v int", [("a", 1), ("b", 2)]))
    assert [tuple(r) for r in preview(book["sheet"]).collect()] == [("ID-001", 1), ("ID-002", 2)]
    assert registry.versions() == []
    write_outputs(book, str(tmp_path / "out"), "in.xlsx")
    assert registry.versions() == [1] and registry.newest().rows == 2


def test_seeds(spark, sheet, tmp_path):
    pairs = lambda rows: spark.createDataFrame(rows, "key string, id string")
    registry = Registry(spark, str(tmp_path / "r"))
    for bad in ([("a", "1"), (" a", "2")], [("a", "1"), ("b", "1")], [(" ", "1")], [("a", None)], [(None, "1")], [("a", "")]):
        with pytest.raises(ValueError):
            registry.seed(pairs(bad))
    assert registry.seed(pairs([(" a ", "ID-0041"), ("b", "P-7"), ("c", "ID-99999999999999999999")])) == 1
    with pytest.raises(ValueError):
        registry.seed(pairs([]))
    book = run(registry, sheet("NHI string", [("new",), ("a",), ("b",)]))
    assert ordered(book["sheet"]) == [("ID-042",), ("ID-0041",), ("P-7",)]


def test_nothing_to_number(spark, sheet, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    for rows in ([], [(None,), (" ",)]):
        book = run(registry, sheet("NHI string", rows))
        book["sheet"].rows.collect()
        assert book.commit_ids() == 0
    assert run(registry, sheet("v int", [(1,)])).commit_ids() == 0
    assert spark.range(1).select(format_id(F.lit(7))).first()[0] == "ID-007"

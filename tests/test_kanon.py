import pytest

from veilframe import RuleSet, Workbook, clean_workbook, equivalence_classes, k_histogram, k_report, workbook_k
from veilframe.operators.kanon import workbook_reports


@pytest.fixture
def rows(spark):
    data = [(31, "A1", "f", "x"), (31, "A1", "f", "y"), (31, "A1", "f", "z"), (42, "B2", "m", "x"), (42, "B2", "m", "y"), (55, "C3", "m", "q")]
    return spark.createDataFrame(data, "Age int, Zone string, Sex string, Finding string")


def test_report(rows):
    r = k_report(rows, ["age", " ZONE ", "nope", "", None, "Sex"], 5, histogram=True).first()
    assert (r["applicable"], r["k"], r["totalRows"], r["uniqueGroups"], r["singletonRows"]) == (True, 1, 6, 3, 1)
    assert r["quasiIdentifiers"] == ["Age", "Zone", "Sex"] and r["reason"] is None
    assert (r["minK"], r["satisfiesMinK"]) == (5, False)
    assert [tuple(h) for h in r["histogram"]] == [(1, 1), (2, 1), (3, 1)]
    assert [tuple(h) for h in k_histogram(rows, ["Age"]).orderBy("k").collect()] == [(1, 1), (2, 1), (3, 1)]


def test_threshold_reached_and_unset(rows):
    pairs = rows.where("Age < 50")
    assert k_report(pairs, ["Age"], 2).first()["satisfiesMinK"] is True
    unset = k_report(pairs, ["Age"]).first()
    assert unset["minK"] is None and unset["satisfiesMinK"] is None and unset["k"] == 2


def test_null_and_empty_are_one_value(spark):
    frame = spark.createDataFrame([(1, None), (1, ""), (1, None), (None, "")], "n int, s string")
    assert sorted((r[0] or 0, r[1], r[2]) for r in equivalence_classes(frame, ["n", "s"]).collect()) == [(0, "", 1), (1, "", 3)]


def test_repeated_names_take_the_first(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b")], "x int, y string").toDF("q", "Q")
    assert k_report(frame, ["q"]).first()["k"] == 2


@pytest.mark.parametrize(
    ("names", "empty", "reason"),
    [([], False, "no quasi"), ([], True, "no quasi"), (["Age"], True, "no data rows"), (["zz"], True, "no data rows"), (["zz"], False, "not present")],
)
def test_not_applicable(rows, names, empty, reason):
    r = k_report(rows.where("false") if empty else rows, names, 3, histogram=True).first()
    assert not r["applicable"] and reason in r["reason"]
    assert (r["k"], r["totalRows"], r["uniqueGroups"], r["singletonRows"], r["histogram"]) == (None, 0, 0, 0, [])
    assert r["quasiIdentifiers"] == [] and r["satisfiesMinK"] is None


def test_workbook_takes_the_least_k(sheet):
    one = sheet("g string, v int", [("a", 1), ("a", 2), ("b", 3), ("b", 4)], "one")
    two = sheet("g string, v int", [("a", 1), ("a", 2), ("a", 3)], "two")
    other = sheet("h string", [("z",)], "other")

    def score(min_k, names=("G",)):
        rules = RuleSet((), names, min_k)
        return workbook_k(workbook_reports(clean_workbook(Workbook([one, two, other]), rules), rules), names, min_k).first()

    assert tuple(score(2)) == (True, 2, 2, True, ["G"])
    assert score(3)["satisfiesMinK"] is False and score(None)["satisfiesMinK"] is True
    assert tuple(score(2, ("none",))) == (False, None, None, None, None)

import pytest
from pyspark.sql import functions as F

from veilframe.plans.columns import plan_catalog, plan_tables
from veilframe.plans.rules import DEFAULT_RULES, Rule, RuleError, RuleSet


def rule(match, action="drop", **more):
    return {"rules": [{"match": match, "action": action, **more}]}


@pytest.mark.parametrize(
    ("raw", "message"),
    [
        (None, "object"),
        ([], "object"),
        ({}, "array"),
        ({"rules": "drop"}, "array"),
        ({"rules": [7]}, r"rules\[0\]"),
        ({"rules": [{"action": "drop"}]}, "match"),
        (rule({}), "exactly one"),
        (rule({"equals": "a", "contains": "b"}), "exactly one"),
        (rule({"glob": "a*"}), "exactly one"),
        (rule({"equals": "a"}, "shred"), "action"),
        (rule({"equals": "a"}, "rename"), "outputName"),
        (rule({"equals": "a"}, "anonymize", outputName=5), "outputName"),
        (rule({"equals": "a"}, "ageFromDate"), "outputName"),
        (rule({"equals": "a"}, "redact"), "replaceWith"),
        (rule({"regex": "("}), "regex"),
        ({"rules": [], "kAnonymity": 3}, "kAnonymity"),
        ({"rules": [], "kAnonymity": {"quasiIdentifiers": "Age"}}, "quasiIdentifiers"),
        ({"rules": [], "kAnonymity": {"minK": 0}}, "minK"),
        ({"rules": [], "kAnonymity": {"minK": 2.5}}, "minK"),
        ({"rules": [], "kAnonymity": {"minK": True}}, "minK"),
    ],
)
def test_bad_rule_sets_are_refused(spark, raw, message):  # regexes are compiled by the session
    with pytest.raises(RuleError, match=message):
        RuleSet.from_dict(raw)


def test_json_round_trip_and_bad_files(tmp_path):
    rules = RuleSet((Rule("contains", "mail", "redact", replace_with="-"), Rule("empty", True, "drop")), ("Age",), 4)
    assert RuleSet.from_json(rules.to_json()) == rules
    path = tmp_path / "rules.json"
    path.write_text(rules.to_json())
    assert RuleSet.load(str(path)) == rules
    path.write_text("{nope")
    with pytest.raises(RuleError, match="JSON"):
        RuleSet.load(str(path))


def actions(spark, headers, rules):
    return {p.index: (p.action, p.name) for p in plan_tables(spark, [headers], rules)[0]}


def test_default_rules(spark):
    headers = ["", "  ", "Column7", "COLUMN x", " nhi ", "Dob", "contact", "ADDRESS", "Contact No", "Notes"]
    assert actions(spark, headers, DEFAULT_RULES) == {
        4: ("anonymize", "ID"), 5: ("ageFromDate", "Age"), 8: ("keep", "Contact No"), 9: ("keep", "Notes"),
    }


def test_each_match_kind(spark):
    def hit(kind, target, header):
        return actions(spark, [header], RuleSet((Rule(kind, target, "drop"),))) == {}

    assert hit("empty", True, " ") and not hit("empty", False, "")
    assert hit("equals", " Name ", "NAME\t") and not hit("equals", "name", "names")
    assert hit("startsWith", "PRE", "Prefix") and not hit("startsWith", " pre", "prefix")
    assert hit("contains", "Mid", "amidst") and hit("contains", "", "anything")
    assert hit("regex", "B+C", "aBBc") and not hit("regex", "^b", "ab")


def test_first_match_wins_and_names(spark):
    rules = RuleSet(
        (
            Rule("equals", "a", "keep", output_name="first"),
            Rule("contains", "a", "redact", output_name="second", replace_with="*"),
            Rule("contains", "", "drop"),
        )
    )
    assert actions(spark, ["A", "ba", "c"], rules) == {0: ("keep", "first"), 1: ("redact", "second")}


def test_catalog_and_table_plans_agree(spark):
    rules = RuleSet((Rule("regex", "^x|y$", "rename", output_name="R"), Rule("empty", True, "drop"), Rule("contains", "m", "drop")))
    headers = ["x1", "gray", "", "mm", "other"]
    catalog = spark.createDataFrame(list(enumerate(headers)), "at int, header string")
    planned = plan_catalog(catalog, rules).orderBy("at").where("action <> 'drop'").collect()
    assert {r["at"]: (r["action"], r["output_name"]) for r in planned} == actions(spark, headers, rules)


def test_no_rules_keep_everything(spark):
    frame = spark.range(1).select(F.lit("h").alias("header"))
    assert plan_catalog(frame, RuleSet()).select("action", "output_name").first()[:] == ("keep", "h")

"""From headers to column plans.

First match wins, so a rule set is one CASE chain over the normalised header. That is a narrow
projection: a catalog with millions of headers is planned without any join against the rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import normalize_header
from veilframe.plans.rules import Rule, RuleSet


@dataclass(frozen=True)
class ColumnPlan:
    index: int
    action: str
    name: str
    replace_with: str | None = None


def matches(header: Column, rule: Rule) -> Column:
    """Does a normalised header satisfy the rule's match clause?"""
    if rule.kind == "empty":
        return (header == "") if rule.target else F.lit(False)
    if rule.kind == "equals":
        return header == normalize_header(F.lit(rule.target))
    target = F.lower(F.lit(rule.target))
    if rule.kind == "startsWith":
        return header.startswith(target)
    if rule.kind == "contains":
        return header.contains(target)
    return header.rlike(f"(?iu){rule.target}")


def first_match(header: Column, rules: RuleSet) -> Column:
    """Index of the first rule that matches the raw header, null when none does."""
    if not rules.rules:
        return F.lit(None).cast("int")
    chain = None
    normal = normalize_header(header)
    for i, rule in enumerate(rules.rules):
        hit = matches(normal, rule)
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    return chain


def plan_catalog(catalog: DataFrame, rules: RuleSet, header: str = "header") -> DataFrame:
    """Add ``rule_idx``, ``action``, ``output_name`` and ``replace_with`` to a frame of headers."""
    rules.check_regexes(catalog.sparkSession)
    idx = F.col("rule_idx")

    def per_rule(values: list[str | None]) -> Column:
        if not values:
            return F.lit(None).cast("string")
        table = F.array(*[F.lit(v).cast("string") for v in values])
        return F.when(idx.isNotNull(), F.get(table, F.coalesce(idx, F.lit(0))))

    action = F.coalesce(per_rule([r.action for r in rules.rules]), F.lit("keep"))
    name = F.coalesce(per_rule([r.output_name for r in rules.rules]), F.col(header).cast("string"))
    return (
        catalog.withColumn("rule_idx", first_match(F.col(header), rules))
        .withColumn("action", action)
        .withColumn("output_name", F.when(F.col("action") != "drop", name))
        .withColumn("replace_with", F.when(F.col("action") != "drop", per_rule([r.replace_with for r in rules.rules])))
    )


def plan_tables(spark: SparkSession, tables: Sequence[Sequence[str]], rules: RuleSet) -> list[list[ColumnPlan]]:
    """Plan the columns of several tables at once; dropped columns are absent from the result.

    The same CASE chain runs over the headers in one small job, so that a table and a catalog obey
    the same regex engine.
    """
    rules.check_regexes(spark)
    rows = [(t, i, header) for t, headers in enumerate(tables) for i, header in enumerate(headers)]
    plans: list[list[ColumnPlan]] = [[] for _ in tables]
    if not rows:
        return plans
    headers = spark.sql("SELECT 1").select(F.posexplode(F.lit([header for _, _, header in rows])).alias("at", "header"))
    chosen = dict(map(tuple, headers.select("at", first_match(F.col("header"), rules)).collect()))
    for at, (t, i, header) in enumerate(rows):
        rule = None if chosen[at] is None else rules.rules[chosen[at]]
        if rule is None:
            plans[t].append(ColumnPlan(i, "keep", header))
        elif rule.action != "drop":
            name = header if rule.output_name is None else rule.output_name
            plans[t].append(ColumnPlan(i, rule.action, name, rule.replace_with))
    return plans

"""Rule sets: ordered header rules in plain JSON, checked before any job starts."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

# The rule vocabulary.
MATCH_KINDS = ("empty", "equals", "startsWith", "contains", "regex")
ACTIONS = ("drop", "keep", "rename", "redact", "anonymize", "ageFromDate")
NAMED_ACTIONS = ("rename", "anonymize", "ageFromDate")


class RuleError(ValueError):
    """The rule set is not usable."""


@dataclass(frozen=True)
class Rule:
    kind: str
    target: Any
    action: str
    output_name: str | None = None
    replace_with: str | None = None

    def to_dict(self) -> dict:
        out: dict[str, Any] = {"match": {self.kind: self.target}, "action": self.action}
        if self.output_name is not None:
            out["outputName"] = self.output_name
        if self.replace_with is not None:
            out["replaceWith"] = self.replace_with
        return out


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise RuleError(message)


def _parse_rule(raw: Any, where: str) -> Rule:
    _need(isinstance(raw, dict), f"{where} must be an object")
    match, action = raw.get("match"), raw.get("action")
    _need(isinstance(match, dict), f'{where} needs a "match" object')
    _need(
        len(match) == 1 and next(iter(match)) in MATCH_KINDS,
        f"{where}: match takes exactly one of {', '.join(MATCH_KINDS)}",
    )
    _need(action in ACTIONS, f"{where}: action must be one of {', '.join(ACTIONS)}")
    if action in NAMED_ACTIONS:
        _need(isinstance(raw.get("outputName"), str), f'{where}: action "{action}" needs an "outputName" string')
    if action == "redact":
        _need(isinstance(raw.get("replaceWith"), str), f'{where}: action "redact" needs a "replaceWith" string')
    kind, target = next(iter(match.items()))
    name, text = raw.get("outputName"), raw.get("replaceWith")
    return Rule(
        kind,
        target if kind == "empty" else "" if target is None else str(target),
        action,
        None if name is None else str(name),
        None if text is None else str(text),
    )


def _parse_k(raw: Any) -> tuple[tuple[str, ...], int | None]:
    if raw is None:
        return (), None
    _need(isinstance(raw, dict), '"kAnonymity" must be an object')
    names, min_k = raw.get("quasiIdentifiers"), raw.get("minK")
    _need(names is None or isinstance(names, list), "the k block needs quasiIdentifiers as an array of names")
    if min_k is not None:
        number = isinstance(min_k, (int, float)) and not isinstance(min_k, bool) and math.isfinite(min_k)
        _need(number and min_k == int(min_k) and min_k >= 1, "the k block's minK is a whole number of 1 or more")
        min_k = int(min_k)
    return tuple("" if n is None else str(n) for n in names or ()), min_k


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    quasi_identifiers: tuple[str, ...] = ()
    min_k: int | None = None
    version: str = field(default="1", compare=False)

    @classmethod
    def from_dict(cls, raw: Any) -> RuleSet:
        _need(isinstance(raw, dict), "a rule set must be an object")
        _need(isinstance(raw.get("rules"), list), 'a rule set needs a "rules" array')
        names, min_k = _parse_k(raw.get("kAnonymity"))
        rules = tuple(_parse_rule(rule, f"rules[{i}]") for i, rule in enumerate(raw["rules"]))
        made, spark = cls(rules, names, min_k, str(raw.get("version", "1"))), SparkSession.getActiveSession()
        return made if spark is None else made.check_regexes(spark)

    def check_regexes(self, spark: SparkSession) -> RuleSet:
        """Compile every header regex with the engine that will run it.

        Reading a rule set does this if a session is active; planning columns always does, before any job starts.
        """
        for i, rule in enumerate(self.rules):
            if rule.kind == "regex":
                try:
                    spark._jvm.java.util.regex.Pattern.compile(f"(?iu){rule.target}")
                except (Py4JJavaError, IllegalArgumentException) as problem:
                    raise RuleError(f"rules[{i}]: regex is invalid: {problem}") from None
        return self

    @classmethod
    def from_json(cls, text: str) -> RuleSet:
        try:
            raw = json.loads(text)
        except ValueError as problem:
            raise RuleError(f"the rule set is not valid JSON: {problem}") from problem
        return cls.from_dict(raw)

    @classmethod
    def load(cls, path: str) -> RuleSet:
        """Read a rule file. A bad file raises; it never falls back to other rules."""
        with open(path, encoding="utf-8") as handle:
            return cls.from_json(handle.read())

    def to_dict(self) -> dict:
        out: dict[str, Any] = {"version": self.version, "rules": [rule.to_dict() for rule in self.rules]}
        if self.quasi_identifiers or self.min_k is not None:
            out["kAnonymity"] = {"quasiIdentifiers": list(self.quasi_identifiers)}
            if self.min_k is not None:
                out["kAnonymity"]["minK"] = self.min_k
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)


# The rules used when none are given.
DEFAULT_RULES = RuleSet(
    (
        Rule("empty", True, "drop"),
        Rule("startsWith", "column", "drop"),
        Rule("equals", "nhi", "anonymize", output_name="ID"),
        Rule("equals", "dob", "ageFromDate", output_name="Age"),
        Rule("equals", "contact", "drop"),
        Rule("equals", "address", "drop"),
    )
)

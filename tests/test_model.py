"""Random workbooks against a sequential model: one row at a time, one dictionary, one set."""

import datetime as dt
import random

from conftest import AS_OF, ordered, stats

from veilframe import Rule, RuleSet, Workbook, clean_workbook

RULES = RuleSet(
    (
        Rule("startsWith", "id", "anonymize", output_name="ID"),
        Rule("equals", "born", "ageFromDate", output_name="Age"),
        Rule("equals", "phone", "redact", replace_with="<p>"),
        Rule("equals", "note", "drop"),
    )
)
ACTIONS = ["id", "id", "age", "redact", "drop", "keep"]
SCHEMA = "id1 string, id2 string, born string, phone string, note string, v int"


def random_row(rng):
    if rng.random() < 0.1:
        return tuple(rng.choice(["", None]) for _ in range(5)) + (None,)
    person = rng.choice(["a", " a ", "b", "c ", "\td", "", "  ", None, f"p{rng.randrange(40)}"])
    other = rng.choice(["a", "e", "", None])
    born = rng.choice(["1990-06-30", "7/1/1990", "oops", "", None, "2030-01-01"])
    return (person, other, born, rng.choice(["1", "", None]), rng.choice(["n", ""]), rng.choice([0, 1, None]))


def model_age(text):
    day = {"1990-06-30": dt.date(1990, 6, 30), "7/1/1990": dt.date(1990, 7, 1)}.get(text)
    return None if day is None else AS_OF.year - day.year - ((AS_OF.month, AS_OF.day) < (day.month, day.day))


def model(sheets):
    ids, results = {}, []
    for rows in sheets:
        seen, out, counts = set(), [], [0, 0, 0, 0, 0]
        for row in rows:
            if all(c is None or c == "" for c in row):
                continue
            counts[0] += 1
            cleaned = []
            for action, cell in zip(ACTIONS, row):
                if action == "id":
                    key = (cell or "").strip()
                    counts[3] += not key
                    cleaned.append(ids.setdefault(key, f"ID-{len(ids) + 1:03d}") if key else "")
                elif action == "age":
                    cleaned.append(model_age(cell))
                    counts[2] += cleaned[-1] is None and bool(cell)
                elif action == "redact":
                    counts[4] += bool(cell)
                    cleaned.append("<p>")
                elif action == "keep":
                    cleaned.append(cell)
            if tuple(cleaned) in seen:
                counts[1] += 1
            else:
                seen.add(tuple(cleaned))
                out.append(tuple(cleaned))
        results.append((out, tuple(counts)))
    return results


def test_random_workbooks(spark, sheet):
    rng = random.Random(7)
    for size in (1, 40, 900):
        data = [[random_row(rng) for _ in range(size)] for _ in range(3)]
        book = clean_workbook(Workbook([sheet(SCHEMA, rows, f"s{i}") for i, rows in enumerate(data)]), RULES, as_of=AS_OF)
        assert [(ordered(s), stats(s)) for s in book] == model(data)

"""Sensitive-column detection: names and sampled values scored against fixed patterns.

The score of every (column, pattern) pair is a projection over one row per column; no join pairs
columns with patterns. Samples are raw identifiers, so reports leave them out unless asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.dates import date_shape, shape_hits
from veilframe.functions.numbers import text_to_number, to_fixed2, whole_number_between
from veilframe.functions.text import WHITESPACE, blank_sql, is_text, normalize_header, plain_number_sql, trim_ws
from veilframe.plans.rules import Rule, RuleSet
from veilframe.sources.sheets import POSITION, Sheet, Workbook

# Sampled values per column, reported values and candidates, suggested threshold.
SAMPLE_SIZE = 25
REPORTED_VALUES = 3
REPORTED_CANDIDATES = 3
SUGGESTED_MIN_K = 5
# The first rows scanned for samples, as a multiple of the sample size.
LOOKAHEAD = 40

UNBOUNDED = 2**31 - 1
TEXT, NUMBER, BOOLEAN, DATE, OTHER = "text", "number", "boolean", "date", "other"


@dataclass(frozen=True)
class Pattern:
    type: str
    severity: str
    hints: tuple[str, ...] = ()
    regex: str | None = None
    lengths: tuple[int, int] = (0, UNBOUNDED)  # lengths the regex can match; a cheap exact pre-test
    needs: str | None = None  # text that every match contains; another one
    predicate: Callable[[Callable[[str], Column]], Column] | None = None
    is_date: bool = False
    header_required: bool = False
    header_only: bool = False
    weight: float | None = None
    suggested: tuple[str, str | None, str | None] | None = None  # action, output name, replacement

    def value_hits(self, of: Callable[[str], Column] = F.col) -> list[Column]:
        """Columns of which exactly one isn't null if a value satisfies the pattern, else none. Empty when it has no value test.

        ``of`` gives what ``measure`` knows of the value, each computed once per value.
        """
        tests = []
        if self.regex is not None:
            test = of("is_text") & of("chars").between(*self.lengths)
            if self.needs is not None:
                test = test & of("value").contains(self.needs)
            tests.append(test & of("value").rlike(self.regex))
        if self.predicate is not None:
            tests.append(self.predicate(of))
        hits = [F.when(reduce(lambda a, b: a | b, tests), 1)] if tests else []
        if self.is_date:
            dated = shape_hits(of("value"), of("shape"), of("trimmed"))
            hits += [F.when(hits[0].isNull(), d) for d in dated] if hits else dated
        return hits

    def literal(self, idx: int) -> str:
        """The pattern as an SQL struct; an absent weight is 1."""
        action, name, text = self.suggested or (None, None, None)
        fields = {
            "pattern_idx": str(idx), "tie": str(-idx), "type": _quoted(self.type), "severity": _quoted(self.severity),
            "hints": f"CAST(array({', '.join(map(_quoted, self.hints))}) AS ARRAY<STRING>)",
            "header_required": str(self.header_required), "header_only": str(self.header_only),
            "weight": f"{self.weight or 1.0}D",
            "action": _quoted(action), "output_name": _quoted(name), "replace_with": _quoted(text),
        }
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _quoted(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else f"'{text}'"


def _is_age(of: Callable[[str], Column]) -> Column:
    return (of("is_boolean") & of("value").isNotNull()) | whole_number_between(of("number"), 0, 130)


# Answers that make a gender column.
GENDERS = ("m", "f", "male", "female", "x", "other", "nonbinary", "non-binary", "nb", "unknown", "prefer not to say")


def _is_gender(of: Callable[[str], Column]) -> Column:
    return of("is_text") & F.lower(of("trimmed")).isin(*GENDERS)


_SPACE = r"\s" + WHITESPACE

# The pattern library. Order decides ties, so it is part of the meaning.
PATTERNS: tuple[Pattern, ...] = (
    Pattern(
        "email", "direct", ("email", "e-mail", "mail"),
        regex=rf"^[^{_SPACE}@]+@[^{_SPACE}@]+\.[^{_SPACE}@]+\z", lengths=(5, UNBOUNDED), needs="@",
        suggested=("redact", None, "<email>"),
    ),
    Pattern(
        "ssn", "direct", ("ssn", "social security", "social_security", "tin"),
        regex=r"^\d{3}-?\d{2}-?\d{4}\z", lengths=(9, 11),
        suggested=("redact", None, "<ssn>"),
    ),
    Pattern(
        "creditcard", "direct", ("credit_card", "creditcard", "card_number", "cardnumber", "cc_number"),
        regex=r"^(?:\d[ -]?){13,19}\z", lengths=(13, 38), header_required=True,
        suggested=("redact", None, "<cc>"),
    ),
    Pattern(
        "phone", "direct", ("phone", "mobile", "cell", "tel", "telephone", "contact"),
        regex=rf"^[+]?[\d][\d{_SPACE}\-().]{{6,}}\z", lengths=(7, UNBOUNDED), header_required=True,
        suggested=("redact", None, "<phone>"),
    ),
    Pattern(
        "nhi", "direct", ("nhi", "national health"),
        regex=r"^[A-Za-z]{3}\d{4}\z", lengths=(7, 7),
        suggested=("anonymize", "ID", None),
    ),
    Pattern(
        "mrn", "direct",
        ("mrn", "medical record", "patient_id", "patientid", "patient id", "patient code", "patient_code"),
        regex=r"(?i)^(?=.*\d)[A-Z0-9-]{4,20}\z", lengths=(4, 20), header_required=True,
        suggested=("anonymize", "PatientID", None),
    ),
    Pattern(
        "ip", "direct", ("ip", "ip_address", "ipaddress", "client_ip"),
        regex=r"^(?:\d{1,3}\.){3}\d{1,3}\z", lengths=(7, 15),
        suggested=("redact", None, "<ip>"),
    ),
    Pattern(
        "dob", "direct", ("dob", "date of birth", "birth_date", "birthdate", "birth date"),
        is_date=True, header_required=True,
        suggested=("ageFromDate", "Age", None),
    ),
    Pattern(
        "name", "direct",
        ("name", "full name", "first name", "firstname", "last name", "lastname", "surname", "given name",
         "family name", "middle name"),
        header_only=True,
        suggested=("redact", None, "<name>"),
    ),
    Pattern(
        "address", "direct", ("address", "street", "addr", "home_address", "mailing_address"),
        header_only=True,
        suggested=("drop", None, None),
    ),
    Pattern(
        "postcode", "quasi", ("postcode", "postal_code", "postal code", "zip", "zipcode", "zip_code"),
        regex=r"(?i)^[A-Z0-9][A-Z0-9 -]{2,9}\z", lengths=(3, 10), header_required=True,
    ),
    Pattern("age", "quasi", ("age",), predicate=_is_age, header_required=True),
    Pattern("gender", "quasi", ("gender", "sex"), predicate=_is_gender, header_required=True),
    Pattern("date", "quasi", is_date=True, weight=0.85),
)

_PLACE = ["sheet_idx", "sheet", "col_idx", "header"]


def _kind(dtype: T.DataType) -> str:
    if is_text(dtype):
        return TEXT
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return DATE if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else OTHER


def _as_text(name: str, dtype: T.DataType) -> str:
    """SQL for a cell's text form, null when blank; whole numbers without a fraction.

    Nested and binary cells have no text form.
    """
    if _kind(dtype) == OTHER:
        return "CAST(NULL AS STRING)"
    return f"IF({blank_sql(name, dtype)}, NULL, {plain_number_sql(name, dtype)})"


def _cells(frame: DataFrame, sheet: Sheet, columns: list[int]) -> DataFrame:
    """Long form ``(_pos?, col_idx, value)`` of the chosen columns, blank cells left out."""
    cells = ", ".join(f"{i}, {_as_text(f'c{i}', sheet.types[i])}" for i in columns)
    order = [POSITION] if POSITION in frame.columns else []
    return frame.selectExpr(*order, f"stack({len(columns)}, {cells}) AS (col_idx, value)").where("value IS NOT NULL")


def _stack_sheets(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.withColumn("sheet_idx", F.lit(i)) for i, p in enumerate(parts)])


def _smallest(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For (position, column 0, column 1, ...): each column's ``n`` non-null values at the smallest positions of a partition."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            for c in range(1, batch.num_columns):
                found = batch.column(c).is_valid()
                if not found.true_count:
                    continue
                new = pa.table({"at": batch.column(0).filter(found), "value": batch.column(c).filter(found)})
                new = new.take(pc.select_k_unstable(new, n, [("at", "ascending")]))
                both = pa.concat_tables([held[c], new]) if c in held else new
                held[c] = both.take(pc.select_k_unstable(both, n, [("at", "ascending")]))
        for c, rows in held.items():
            column = pa.array([c - 1] * len(rows), pa.int32())
            yield from pa.table({POSITION: rows["at"], "place": column, "value": rows["value"]}).to_batches()

    return walk


def _first_of(frame: DataFrame, sheet: Sheet, columns: list[int], n: int) -> DataFrame:
    """``(_pos, col_idx, value)`` of the first ``n`` values of some columns, from one scan.

    Each task keeps ``n`` values a column, so no more than that leaves it, however many values a column has.
    """
    wide = frame.selectExpr(POSITION, *[f"{_as_text(f'c{c}', sheet.types[c])} AS c{c}" for c in columns])
    some = wide.where(reduce(lambda a, b: a | b, [F.col(f"c{c}").isNotNull() for c in columns]))
    found = some.mapInArrow(_smallest(n), f"{POSITION} long, place int, value string")
    return found.select(POSITION, F.get(F.lit(columns), "place").cast("int").alias("col_idx"), "value")


def first_values(sheets: list[Sheet], n: int = SAMPLE_SIZE) -> DataFrame:
    """``(sheet_idx, col_idx, rank, value)``: the first ``n`` non-blank values of every column in row order.

    Dense columns fill their sample within the first rows. So find the position that bounds those
    rows from the position column alone, and read only up to it (the bound reaches the scan as a
    pushed filter). Columns still short of ``n`` get an exact second look, all of a sheet's in one
    scan. No partition ever sorts a whole column. All sheets share the two small probing jobs,
    which bring two numbers per sheet and one per column to the driver.
    """
    for sheet in sheets:
        sheet.require_order("sampling")
    frames = [s.positional() for s in sheets]
    columns = [list(range(len(s.headers))) for s in sheets]
    heads = [f.select(POSITION).orderBy(POSITION).limit(n * LOOKAHEAD) for f in frames]
    probes = _stack_sheets([h.agg(F.max(POSITION).alias("bound"), F.count(F.lit(1)).alias("seen")) for h in heads])
    bounds = {r["sheet_idx"]: (r["bound"], r["seen"]) for r in probes.collect()}
    near = [
        _cells(f.where(F.col(POSITION) <= F.lit(bounds[i][0])) if bounds[i][1] else f, sheets[i], columns[i])
        for i, f in enumerate(frames)
    ]
    longer = [i for i, (_, seen) in bounds.items() if seen == n * LOOKAHEAD]
    filled: dict[tuple[int, int], int] = {}
    if longer:
        probed = _stack_sheets(near).where(F.col("sheet_idx").isin(longer))
        filled = {(r[0], r[1]): r[2] for r in probed.groupBy("sheet_idx", "col_idx").count().collect()}
    ranked = []
    for i, sheet in enumerate(sheets):
        short = [c for c in columns[i] if i in longer and filled.get((i, c), 0) < n and _kind(sheet.types[c]) != OTHER]
        found = near[i].where(~F.col("col_idx").isin(short)) if short else near[i]
        ranked.append(found.unionByName(_first_of(frames[i], sheet, short, n)) if short else found)
    by_column = Window.partitionBy("sheet_idx", "col_idx").orderBy(POSITION)
    numbered = _stack_sheets(ranked).withColumn("rank", F.row_number().over(by_column))
    return numbered.where(F.col("rank") <= n).select("sheet_idx", "col_idx", "rank", "value")


def _columns_of(workbook: Workbook) -> list[tuple[int, int]]:
    return [(i, c) for i, s in enumerate(workbook) for c in range(len(s.headers))]


def _with_kind(values: DataFrame, sheets: list[Sheet]) -> DataFrame:
    """Add the column's kind: one map from (sheet, column) to kind instead of a name per row."""
    kinds = [F.lit([_kind(t) for t in s.types]) for s in sheets]
    return values.withColumn("kind", F.get(F.get(F.array(*kinds), "sheet_idx"), "col_idx"))


def sampled_values(workbook: Workbook, sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """``sheet_idx, col_idx, kind, value, rank`` of the sampled cells.

    Every column contributes one row without a value, so that columns without samples are reported too.
    """
    sheets = list(workbook)
    columns = sheets[0].frame.sparkSession.createDataFrame(_columns_of(workbook), "sheet_idx int, col_idx int")
    return _with_kind(first_values(sheets, sample_size).unionByName(columns, allowMissingColumns=True), sheets)


def measure(samples: DataFrame) -> DataFrame:
    """Add what several patterns ask of a value."""
    value, kind = F.col("value"), F.col("kind")
    kinds = {"is_text": kind == TEXT, "is_number": kind == NUMBER, "is_boolean": kind == BOOLEAN, "trimmed": trim_ws(value)}
    trimmed = F.col("trimmed")
    number = F.when(F.col("is_text"), text_to_number(value, trimmed)).when(F.col("is_number"), value.try_cast("double"))
    return samples.withColumns(kinds).withColumns({"chars": F.length(value), "shape": date_shape(value, trimmed), "number": number})


def _shown() -> Column:
    """The reported first values, in order."""
    return F.sort_array(F.collect_list(F.when(F.col("rank") <= REPORTED_VALUES, F.struct("rank", "value"))))["value"]


def _hits() -> list[Column]:
    """A counter of the values that pass, for each pattern with a value test.

    The JVM never compiles a method beyond 8000 bytes, and the tests of all patterns are longer. Spark gives counters of plain conditions a method
    each; ``count_if`` would have all conditions in one, as columns of a projection. The date test is too long for one method and has several counters.
    """
    tests = [(i, p.value_hits()) for i, p in enumerate(PATTERNS)]
    counters = [(i, [F.count(hit) for hit in of]) for i, of in tests if of]
    return [reduce(lambda a, b: a + b, of).alias(f"h{i}") for i, of in counters]


def sample_counts(samples: DataFrame) -> DataFrame:
    """``sheet_idx, col_idx, sample_size, sample_values`` and the hits ``h<pattern>`` of every column's sample."""
    by_column = measure(samples).groupBy("sheet_idx", "col_idx")
    return by_column.agg(F.count("value").alias("sample_size"), _shown().alias("sample_values"), *_hits())


def full_counts(workbook: Workbook) -> DataFrame:
    """``sheet_idx, col_idx, sample_size`` and the hits ``h<pattern>`` over every value.

    Cells are dealt out one by one inside the compiled scan stage, and counted there: a row per column leaves each task. So the tests
    are compiled once, however many columns there are. A wide aggregate with a counter per column and pattern compiles them per column,
    and testing a row's cells side by side in a lambda interprets them; both took twice as long on the same tables.
    """
    sheets = list(workbook)
    cells = _stack_sheets([_cells(s.positional().drop(POSITION), s, list(range(len(s.headers)))) for s in sheets])
    counted = measure(_with_kind(cells, sheets)).groupBy("sheet_idx", "col_idx").agg(F.count("value").alias("sample_size"), *_hits())
    columns = sheets[0].frame.sparkSession.createDataFrame(_columns_of(workbook), "sheet_idx int, col_idx int")
    # Columns without a value: one row each, by the few rows that are left.
    return columns.join(counted, ["sheet_idx", "col_idx"], "left").withColumn("sample_size", F.coalesce("sample_size", F.lit(0).cast("long")))


def match_rates(counts: DataFrame, workbook: Workbook) -> DataFrame:
    """One row per column: sample size and ``rates`` in pattern order, and the sampled values if ``counts`` has them.

    A pattern without a value test has rate null; a column without samples has rate 0.
    """
    n = F.col("sample_size")
    rates = [
        F.lit(None).cast("double") if not p.value_hits() else F.when(n > 0, F.col(f"h{i}") / n).otherwise(0.0)
        for i, p in enumerate(PATTERNS)
    ]
    names = F.get(F.lit([s.name for s in workbook]), "sheet_idx")
    headers = F.get(F.get(F.array(*[F.lit(s.headers) for s in workbook]), "sheet_idx"), "col_idx")
    place = [F.col("sheet_idx"), names.alias("sheet"), F.col("col_idx"), headers.alias("header")]
    shown = [c for c in ("sample_values",) if c in counts.columns]
    return counts.select(*place, "sample_size", *shown, F.array(*rates).alias("rates"))


# The confidence model. A pattern without a value test has rate 0 here.
_CONFIDENCE = """
CASE WHEN c.header_only THEN IF(c.hit, 0.92D, NULL)
     WHEN c.header_required AND NOT c.hit THEN NULL
     WHEN c.hit AND c.rate >= 0.5D THEN least(0.99D, (0.95D + least(0.04D, c.rate - 0.5D)) * c.weight)
     WHEN c.rate >= 0.9D THEN least(0.99D, 0.9D * c.weight)
     WHEN c.hit THEN least(0.99D, (0.6D + IF(c.rate >= 0.25D, 0.1D, 0.0D)) * c.weight)
     WHEN c.rate >= 0.5D THEN least(0.99D, (0.65D + least(0.1D, c.rate - 0.5D)) * c.weight)
END
"""


def score(rates: DataFrame) -> DataFrame:
    """Add ``candidates``: every pattern that applies, best first, ties to the earlier pattern.

    The patterns are a constant array, so scoring is one projection and needs no join.
    """
    patterns = ", ".join(p.literal(i) for i, p in enumerate(PATTERNS))
    evidence = f"""
        transform(array({patterns}), p -> named_struct(
            'p', p, 'weight', p.weight, 'header_only', p.header_only, 'header_required', p.header_required,
            'hit', exists(p.hints, hint -> contains(normal, hint)), 'rate', coalesce(rates[p.pattern_idx], 0.0D)))
    """
    scored = f"""
        transform({evidence}, c -> named_struct(
            'raw_confidence', {_CONFIDENCE}, 'tie', c.p.tie, 'pattern_idx', c.p.pattern_idx, 'type', c.p.type,
            'severity', c.p.severity, 'header_hit', c.hit, 'value_rate', IF(c.header_only, NULL, c.rate),
            'action', c.p.action, 'output_name', c.p.output_name, 'replace_with', c.p.replace_with))
    """
    held = F.expr(f"sort_array(filter({scored}, c -> c.raw_confidence IS NOT NULL), false)")
    return rates.withColumn("normal", normalize_header(F.col("header"))).withColumn("candidates", held).drop("normal")


def _with_best(scored: DataFrame) -> DataFrame:
    return scored.withColumn("best", F.get("candidates", F.lit(0)))


class Detection:
    """Lazy detection results for a workbook; ``rules`` runs the job."""

    def __init__(self, workbook: Workbook, sample_size: int | None):
        self.workbook, self.full = workbook, sample_size is None
        counts = full_counts(workbook) if self.full else sample_counts(sampled_values(workbook, sample_size))
        self.rates = match_rates(counts, workbook)
        self.scored = score(self.rates)

    @property
    def _with_samples(self) -> DataFrame:
        """The scored columns with their first values. A full scan reads those here, and only if someone asks."""
        if not self.full:
            return self.scored
        none = F.array().cast("array<string>")
        if any(s.pos is None for s in self.workbook):
            return self.scored.withColumn("sample_values", none)
        few = first_values(list(self.workbook), REPORTED_VALUES)
        listed = few.groupBy("sheet_idx", "col_idx").agg(_shown().alias("sample_values"))
        return self.scored.join(listed, ["sheet_idx", "col_idx"], "left").withColumn("sample_values", F.coalesce("sample_values", none))

    @property
    def candidates(self) -> DataFrame:
        """Flat: one row per (column, applicable pattern) with rank and two-place confidence."""
        exploded = self.scored.select(*_PLACE, "sample_size", F.posexplode("candidates").alias("at", "c"))
        return exploded.select(
            *_PLACE, "sample_size", (F.col("at") + 1).alias("rank"),
            "c.pattern_idx", "c.type", "c.severity", to_fixed2(F.col("c.raw_confidence")).alias("confidence"),
            "c.header_hit", "c.value_rate",
        )

    @property
    def _best(self) -> DataFrame:
        return _with_best(self.scored)

    def report(self, include_samples: bool = False) -> DataFrame:
        """One row per column: the best candidate, its suggestion and the leading candidates."""
        listed = F.transform(
            F.slice("candidates", 1, REPORTED_CANDIDATES),
            lambda c: F.struct(
                c["type"].alias("type"),
                c["severity"].alias("severity"),
                to_fixed2(c["raw_confidence"]).alias("confidence"),
                F.struct(c["header_hit"].alias("headerHit"), c["value_rate"].alias("valueRate")).alias("evidence"),
            ),
        )
        found = _with_best(self._with_samples) if include_samples else self._best
        return found.select(
            *_PLACE, "sample_size", *(["sample_values"] if include_samples else []),
            listed.alias("detections"),
            F.col("best.type").alias("best_type"), F.col("best.severity").alias("best_severity"),
            to_fixed2(F.col("best.raw_confidence")).alias("best_confidence"),
            "best.action", "best.output_name", "best.replace_with",
        )

    @property
    def summary(self) -> DataFrame:
        """Columns whose best candidate is direct or quasi, repeated headers counted each time."""
        severity = F.col("best.severity")
        return self._best.agg(
            F.count_if(severity == "direct").alias("directIdentifiers"), F.count_if(severity == "quasi").alias("quasiIdentifiers")
        )

    @property
    def headers(self) -> DataFrame:
        """One row per distinct header: its first suggestion and its first quasi-identifying column.

        ``place`` orders (sheet, column); the first one wins.
        """
        place = F.shiftleft(F.col("sheet_idx").cast("long"), 32) + F.col("col_idx")
        placed = self._best.select(normalize_header(F.col("header")).alias("normal"), place.alias("place"), "header", "best")
        rule = F.struct("place", "header", "best.action", "best.output_name", "best.replace_with")
        return placed.groupBy("normal").agg(
            F.min_by(rule, F.when(F.col("best.action").isNotNull(), F.col("place"))).alias("rule"),
            F.min_by(F.struct("place", "header"), F.when(F.col("best.severity") == "quasi", F.col("place"))).alias("quasi"),
        )

    @property
    def suggested(self) -> DataFrame:
        """``place, header, action, output_name, replace_with``: one rule per distinct header."""
        return self.headers.where("rule IS NOT NULL").select("rule.*")

    @property
    def quasi_headers(self) -> DataFrame:
        """``place, header`` of the distinct quasi-identifying headers."""
        return self.headers.where("quasi IS NOT NULL").select("quasi.*")

    @cached_property
    def rules(self) -> RuleSet:
        """The suggestion as a rule set ready to run. One row per distinct header reaches the driver."""
        found = self.headers.collect()
        suggested = sorted(r["rule"] for r in found if r["rule"] is not None)
        quasi = sorted(r["quasi"] for r in found if r["quasi"] is not None)
        rules = [Rule("equals", r["header"], r["action"], r["output_name"], r["replace_with"]) for r in suggested]
        rules += [Rule("empty", True, "drop"), Rule("startsWith", "column", "drop")]
        return RuleSet(tuple(rules), tuple(r["header"] for r in quasi), SUGGESTED_MIN_K if quasi else None)


def detect(workbook: Workbook | Sheet, sample_size: int | None = SAMPLE_SIZE) -> Detection:
    """Score every column of every sheet by its first values, or with ``sample_size=None`` by all of them."""
    if isinstance(workbook, Sheet):
        workbook = Workbook([workbook])
    return Detection(workbook, sample_size)

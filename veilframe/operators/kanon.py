"""k-anonymity measured on cleaned, deduplicated rows. Nothing is suppressed or generalised.

Everything follows from the class-size histogram: rows -> equivalence classes (hash aggregate with
map-side combine, so one huge class costs one row per map task) -> sizes -> report.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import WHITESPACE, is_text
from veilframe.operators.clean import CleanWorkbook
from veilframe.plans.rules import RuleSet

# Why a report does not apply, in order of precedence.
NO_QUASI = "no quasi-identifiers configured"
NO_ROWS = "no data rows"
NOT_PRESENT = "requested quasi-identifiers not present in cleaned output"


def resolve(columns: Sequence[str], wanted: Sequence[str | None]) -> list[int]:
    """Column places of the wanted names, in request order; unknown and empty names are skipped."""

    def normal(name: str | None) -> str:
        return ("" if name is None else str(name)).strip(WHITESPACE).lower()

    places: dict[str, int] = {}
    for i, name in enumerate(columns):
        places.setdefault(normal(name), i)
    names = [normal(w) for w in wanted]
    return [places[n] for n in names if n and n in places]


def equivalence_classes(rows: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """One row per quasi-identifier tuple, null equal to the empty string, with its size ``n``."""
    places = resolve(rows.columns, quasi_identifiers)
    types = [f.dataType for f in rows.schema.fields]
    frame = rows.toDF(*[f"c{i}" for i in range(len(types))])
    # A typed column needs no text form: equal values have equal text, and null stands for ''.
    keys = [
        (F.coalesce(F.col(f"c{i}"), F.lit("")) if is_text(types[i]) else F.col(f"c{i}")).alias(f"q{n}")
        for n, i in enumerate(places)
    ]
    names = [rows.columns[i] for i in places]
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).toDF(*names, "n")


def k_histogram(rows: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """``(k, groupCount)``: how many classes have each size. Sort by ``k`` to print it."""
    classes = equivalence_classes(rows, quasi_identifiers)
    sizes = classes.toDF(*[f"c{i}" for i in range(len(classes.columns) - 1)], "k")
    return sizes.groupBy("k").agg(F.count(F.lit(1)).alias("groupCount"))


def _not_applicable(reason: Column | str, names: Sequence[str], min_k: int | None) -> list[Column]:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    zero = F.lit(0).cast("long")
    return _report_columns(F.lit(False), reason, F.lit(None).cast("long"), zero, zero, zero, names, min_k)


def _report_columns(
    applicable: Column, reason: Column, k: Column, rows: Column, groups: Column, single: Column,
    names: Sequence[str], min_k: int | None,
) -> list[Column]:
    out = [
        applicable.alias("applicable"),
        reason.alias("reason"),
        k.cast("long").alias("k"),
        rows.cast("long").alias("totalRows"),
        groups.cast("long").alias("uniqueGroups"),
        single.cast("long").alias("singletonRows"),
        (F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")).alias("quasiIdentifiers"),
        F.lit(min_k).cast("long").alias("minK"),
    ]
    satisfied = F.when(applicable, F.coalesce(k >= min_k, F.lit(False))) if min_k is not None else F.lit(None).cast("boolean")
    return [*out, satisfied.alias("satisfiesMinK")]


def k_report(
    rows: DataFrame, quasi_identifiers: Sequence[str], min_k: int | None = None, histogram: bool = False
) -> DataFrame:
    """One row: k, totals, singleton rows and the threshold test, or the reason for none of it.

    ``histogram=True`` adds the histogram as a sorted array (distinct class sizes only).
    """
    spark = rows.sparkSession
    places = resolve(rows.columns, quasi_identifiers)
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("groupCount", T.LongType())])))
    if not quasi_identifiers:
        report = spark.range(1).select(*_not_applicable(NO_QUASI, [], min_k))
        return report.withColumn("histogram", empty) if histogram else report
    if not places:
        some = rows.limit(1).agg(F.count(F.lit(1)).alias("some"))
        reason = F.when(F.col("some") == 0, NO_ROWS).otherwise(NOT_PRESENT)
        report = some.select(*_not_applicable(reason, [], min_k))
        return report.withColumn("histogram", empty) if histogram else report
    names = [rows.columns[i] for i in places]
    sizes = k_histogram(rows, quasi_identifiers)
    totals = [
        F.min("k").alias("k"),
        F.coalesce(F.sum(F.col("k") * F.col("groupCount")), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("groupCount"), F.lit(0)).alias("groups"),
        F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("groupCount"))), F.lit(0)).alias("single"),
    ]
    if histogram:
        totals.append(F.sort_array(F.collect_list(F.struct("k", "groupCount"))).alias("histogram"))
    any_row = F.col("rows") > 0
    report = sizes.agg(*totals).select(
        *_report_columns(
            any_row, F.when(~any_row, NO_ROWS), F.col("k"), F.col("rows"), F.col("groups"), F.col("single"), names, min_k
        ),
        *(["histogram"] if histogram else []),
    )
    return report.withColumn(
        "quasiIdentifiers", F.when(F.col("applicable"), F.col("quasiIdentifiers")).otherwise(F.array().cast("array<string>"))
    )


def workbook_reports(book: CleanWorkbook, rules: RuleSet) -> DataFrame:
    """The k report of every sheet, with the sheet's place and name."""
    reports = [
        k_report(s.scoring_rows, rules.quasi_identifiers, rules.min_k).select(
            F.lit(i).alias("sheet_idx"), F.lit(s.name).alias("sheet"), "*"
        )
        for i, s in enumerate(book)
    ]
    return reduce(DataFrame.unionByName, reports)


def workbook_k(reports: DataFrame, requested: Sequence[str], min_k: int | None = None) -> DataFrame:
    """The least k over the applicable sheets; satisfied when no threshold is set."""
    applicable = F.col("applicable")
    folded = reports.agg(
        F.coalesce(F.bool_or("applicable"), F.lit(False)).alias("applicable"), F.min(F.when(applicable, F.col("k"))).alias("k")
    )
    satisfied = F.lit(True) if min_k is None else F.coalesce(F.col("k") >= min_k, F.lit(False))
    names = F.array(*[F.lit(n) for n in requested]) if requested else F.array().cast("array<string>")
    return folded.select(
        "applicable",
        "k",
        F.when(applicable, F.lit(min_k).cast("long")).alias("minK"),
        F.when(applicable, satisfied).alias("satisfiesMinK"),
        F.when(applicable, names).alias("quasiIdentifiers"),
    )

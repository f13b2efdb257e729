import datetime as dt

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from veilframe.functions.dates import age_years, looks_like_date, parse_date
from veilframe.functions.numbers import text_to_number, to_fixed2
from veilframe.functions.text import sanitize_name, trim_ws
from veilframe.operators.ids import format_id


def column(spark, values, expression, dtype="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


DATES = {
    "1990-01-15": dt.date(1990, 1, 15),
    " 1990-1-5 ": dt.date(1990, 1, 5),
    "1990": dt.date(1990, 1, 1),
    "1990-03": dt.date(1990, 3, 1),
    "1990/03/04": dt.date(1990, 3, 4),
    "1990-01-15T10:00:00": dt.date(1990, 1, 15),
    "1990-01-15 10:00": dt.date(1990, 1, 15),
    "1990-01-15T23:30:00-02:00": dt.date(1990, 1, 16),
    "5/15/1990": dt.date(1990, 5, 15),
    "05-15-1990": dt.date(1990, 5, 15),
    "5/15/90": dt.date(1990, 5, 15),
    "5/15/07": dt.date(2007, 5, 15),
    "May 15, 1990": dt.date(1990, 5, 15),
    "15 September 1990": dt.date(1990, 9, 15),
    "1990-02-30": None,
    "15/05/1990": None,
    "5/15-1990": None,
    "15 Nay 1990": None,
    "not-a-date": None,
    "10:30": None,
    "": None,
    None: None,
}


def test_date_grammar(spark):
    assert dict(zip(DATES, column(spark, list(DATES), parse_date))) == DATES
    assert column(spark, ["15/05/1990", "5/6/1990"], lambda c: parse_date(c, day_first=True)) == [
        dt.date(1990, 5, 15), dt.date(1990, 6, 5),
    ]


def test_whole_years(spark):
    born = ["2000-02-29", "1990-06-30", "1990-07-01", "2024-06-30", "2024-07-01", "1894-07-01", "1894-06-30"]
    years = column(spark, born, lambda c: age_years(parse_date(c), AS_OF))
    assert years == [24, 34, 33, 0, None, 129, None]
    assert column(spark, ["2000-02-29"], lambda c: age_years(parse_date(c), dt.date(2023, 2, 28))) == [22]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1985-12-01", True), ("2021-05-06T07:08:09", True), ("2021-99-99 anything", True), ("31/12/1999", True),
        ("1-2-03", True), ("99/99/123", True), ("1/1/1800", False), ("1432-01-01", False), ("2100-01-01", False),
        ("never", False), ("", False), ("May 4, 1999", True), ("May 4, 1899", False), ("1950", True), ("1900", False),
        ("12345", False), ("72", False), (None, False),
    ],
)
def test_date_shape(spark, text, expected):
    assert column(spark, [text], looks_like_date) == [expected]


def test_names_trim_and_ids(spark):
    names = [" Case Mix (2024)! ", "__a__b__", "", None, "ÄÖ", "A b"]
    assert column(spark, names, lambda c: sanitize_name(c, "sheet")) == ["case_mix_2024", "a_b", "sheet", "sheet", "sheet", "a_b"]
    assert column(spark, ["　\t x y ﻿"], trim_ws) == ["x y"]
    assert column(spark, [7, 999, 1000, 1234567], format_id, "long") == ["ID-007", "ID-999", "ID-1000", "ID-1234567"]


def test_script_numbers(spark):
    texts = ["12", " 1e2 ", ".5", "5.", "-0", "0x1F", "0b101", "0o17", "", "  ", "1d", "NaN", "Infinity", "1_000", "twelve"]
    assert column(spark, texts, text_to_number) == [12, 100, 0.5, 5, 0, 31, 5, 15, 0, 0, None, None, None, None, None]


def test_two_places_follow_the_binary_value(spark):
    values = [0.595, 0.765, 0.9 * 0.85, 0.545, 0.99, 0.5525, (0.65 + (0.55 - 0.5)) * 0.85]
    assert column(spark, values, to_fixed2, "double") == [float(f"{v:.2f}") for v in values]

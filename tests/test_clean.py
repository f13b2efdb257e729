import pytest
from conftest import AS_OF, ordered, stats
from pyspark.sql import functions as F

from veilframe import DEFAULT_RULES, Rule, RuleSet, Sheet, Workbook, clean_sheet, clean_workbook
from veilframe.sources.sheets import OrderError


def test_default_rules_end_to_end(sheet):
    people = sheet(
        "NHI string, DOB string, Contact string, Height int",
        [
            ("PQ77", "1991-02-03", "1", 170),
            ("PQ77", "1991-02-03", "2", 170),  # equal once Contact is dropped
            ("RS88", "1980-07-01", "3", 181),
            ("", "soon", "4", 160),
            (None, "2001-02-03", None, 165),
            ("", "", "", None),  # blank row
        ],
    )
    clean = clean_sheet(people, as_of=AS_OF)
    assert clean.columns == ["ID", "Age", "Height"]
    assert ordered(clean) == [("ID-001", 33, 170), ("ID-002", 43, 181), ("", None, 160), ("", 23, 165)]
    assert stats(clean) == (5, 1, 1, 2, 0)


def test_blank_rows_keep_zero_and_spaces(sheet):
    clean = clean_sheet(sheet("a string, n int", [("", None), (None, 0), ("  ", None), (None, None)]))
    assert ordered(clean) == [(None, 0), ("  ", None)]


def test_dropped_columns_still_decide_blankness(sheet):
    clean = clean_sheet(sheet("a string, Contact string", [("", "x"), (None, "")]))
    assert ordered(clean) == [("",)]


def test_all_columns_dropped_leaves_one_empty_row(sheet):
    clean = clean_sheet(sheet("Column1 string, Column2 string", [("a", "b"), ("c", "d")]))
    assert clean.columns == [] and clean.rows.count() == 1
    assert stats(clean) == (2, 1, 0, 0, 0)
    empty = clean_sheet(sheet("Column1 string", []))
    assert empty.rows.count() == 0 and stats(empty) == (0, 0, 0, 0, 0)


def test_redact_covers_blanks_and_counts_values(sheet):
    rules = RuleSet((Rule("equals", "mobile", "redact", replace_with="#"),))
    clean = clean_sheet(sheet("who string, Mobile string", [("a", "1"), ("b", ""), ("c", None), ("d", "2")]), rules)
    assert ordered(clean) == [("a", "#"), ("b", "#"), ("c", "#"), ("d", "#")]
    assert stats(clean)[4] == 2


def test_dedup_is_exact_and_typed(sheet):
    rows = [("a", 1.0), ("A", 1.0), ("a ", 1.0), ("a", 1.0), ("a", None), ("", None), (None, None)]
    clean = clean_sheet(sheet("s string, x double", rows), RuleSet())
    assert ordered(clean) == [("a", 1.0), ("A", 1.0), ("a ", 1.0), ("a", None)]


def test_headers_empty_dotted_and_repeated(spark):
    frame = spark.createDataFrame([(0, "x", "1990-01-01", "t", "u")], "_pos long, a string, DOB string, c string, d string")
    clean = clean_sheet(Sheet("s", frame.toDF("_pos", "", "DOB", "a.b", "a.b"), "_pos"), as_of=AS_OF)
    assert clean.columns == ["Age", "a.b", "a.b"] and ordered(clean) == [(34, "t", "u")]


def test_numeric_ids_are_missing_unless_cast(sheet):
    numbers = sheet("NHI long, x int", [(7, 1), (8, 2)])
    with pytest.warns(UserWarning, match="cast_ids"):
        assert ordered(clean_sheet(numbers)) == [("", 1), ("", 2)]
    assert ordered(clean_sheet(numbers, cast_ids=True)) == [("ID-001", 1), ("ID-002", 2)]


def test_dates_by_column_type(spark, sheet):
    typed = spark.sql("SELECT 0L AS _pos, DATE'1990-06-30' AS DOB, 'k' AS x UNION ALL SELECT 1L, DATE'1990-07-01', 'l'")
    assert ordered(clean_sheet(Sheet("s", typed, "_pos"), as_of=AS_OF)) == [(34, "k"), (33, "l")]
    serials = sheet("DOB double, x int", [(32874.0, 1), (None, 2)])
    assert stats(clean_sheet(serials, as_of=AS_OF))[2] == 1
    assert ordered(clean_sheet(serials, as_of=AS_OF, numeric_dates="excel_serial")) == [(34, 1), (None, 2)]


def test_maps_pass_through_and_dedup(spark):
    frame = spark.range(4).select(F.col("id").alias("_pos"), F.create_map(F.lit("k"), F.col("id") % 2).alias("m"))
    clean = clean_sheet(Sheet("s", frame, "_pos"), RuleSet())
    assert ordered(clean) == [({"k": 0},), ({"k": 1},)] and stats(clean)[:2] == (4, 2)


def test_order_is_required_where_it_matters(sheet):
    plain = sheet("NHI string, x int", [("a", 1), ("a", 1)])
    unordered = Sheet("s", plain.frame.drop("_pos"))
    with pytest.raises(OrderError):
        clean_sheet(unordered).rows
    no_ids = clean_sheet(unordered, RuleSet())
    assert no_ids.rows.count() == 1 and stats(no_ids)[:2] == (2, 1)
    with pytest.raises(OrderError):
        no_ids.positioned


def test_workbook_shares_ids_in_sheet_row_column_order(sheet):
    rules = RuleSet((Rule("startsWith", "id", "anonymize", output_name="ID"),))
    one = sheet("id1 string, id2 string", [("m", "n"), (" n ", "o"), ("", "m")], "one")
    two = sheet("id string, v int", [("p", 1), ("o", 2)], "two")
    book = clean_workbook(Workbook([one, two]), rules)
    assert ordered(book["one"]) == [("ID-001", "ID-002"), ("ID-002", "ID-003"), ("", "ID-001")]
    assert ordered(book["two"]) == [("ID-004", 1), ("ID-003", 2)]
    # Each call numbers afresh.
    assert ordered(clean_workbook(Workbook([two]), rules)["two"]) == [("ID-001", 1), ("ID-002", 2)]


def test_given_mapping_is_used(spark, sheet):
    registry = spark.createDataFrame([("a", "ID-900")], "key string, id string")
    assert ordered(clean_sheet(sheet("NHI string", [(" a ",), ("b",), ("",)]), DEFAULT_RULES, registry)) == [("ID-900",), ("",)]


def test_zero_column_sheets_are_skipped_and_header_only_kept(spark, sheet):
    book = Workbook([Sheet("none", spark.range(1).drop("id")), sheet("a string", [], "empty")])
    assert [s.name for s in book] == ["empty"]
    assert stats(clean_workbook(book)["empty"]) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="no sheet"):
        clean_workbook(Workbook([]))

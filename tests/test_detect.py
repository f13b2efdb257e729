import pytest
from pyspark.sql import functions as F

from veilframe import Sheet, Workbook, clean_workbook, detect
from veilframe.functions.dates import date_shape, looks_like_date, shape_hits
from veilframe.functions.text import trim_ws
from veilframe.operators.detect import PATTERNS, _hits, first_values, measure


def best(sheet, header, values, dtype="string"):
    source = sheet("v " + dtype, [(v,) for v in values])
    frame = source.frame.toDF("_pos", header)
    r = detect(Sheet("s", frame, "_pos")).report().first()
    return r["best_type"], r["best_confidence"]


@pytest.mark.parametrize(
    ("header", "values", "dtype", "expected"),
    [
        ("E-Mail", ["a@b.org", "c@d.net"], "string", ("email", 0.99)),
        ("Handle", ["a@b.org", "c@d.net"], "string", ("email", 0.9)),
        ("Handle", ["a@b.org", "c@d.net", "e@f.nz", "none", "none"], "string", ("email", 0.75)),
        ("Handle", ["a@b.org", "none", "none"], "string", (None, None)),
        ("Tax", ["111-22-3333", "444-55-6666"], "string", ("ssn", 0.9)),
        ("cc_number", ["4000 0000 0000 0002", "4000000000000002"], "string", ("creditcard", 0.99)),
        ("Amount due", ["4000000000000002"], "string", (None, None)),
        ("Cell", ["+64 (21) 555-123"], "string", ("phone", 0.99)),
        ("NHI", ["ABC1234", "XYZ0001"], "string", ("nhi", 0.99)),
        ("Code", ["ABC1234", "XYZ0001"], "string", ("nhi", 0.9)),
        ("Patient code", ["P-0001", "P-0002"], "string", ("mrn", 0.99)),
        ("Patient code", ["none", "P-0002", "some", "else"], "string", ("mrn", 0.7)),
        ("Server", ["10.1.2.3"], "string", ("ip", 0.9)),
        ("Birthdate", ["1990-01-01", "31/12/1985"], "string", ("dob", 0.99)),
        ("Visited", ["2020-01-01", "2020-02-01"], "string", ("date", 0.77)),
        ("Visited", ["2020-01-01", "unknown"], "string", ("date", 0.55)),
        ("Family Name", ["Q"], "string", ("name", 0.92)),
        ("Street", ["1 Way"], "string", ("address", 0.92)),
        ("Zip", ["1010", "2020"], "string", ("postcode", 0.99)),
        ("Zip", [1010, 2020], "int", ("ip", 0.6)),  # both score .6; the earlier pattern wins
        ("Rating", [None], "string", ("ssn", 0.6)),
        ("Usage", [10, 20], "int", ("age", 0.99)),
        ("Age", [1.5, 200.0, 30.0], "double", ("age", 0.7)),
        ("Age", [True, False], "boolean", ("age", 0.99)),
        ("Sex", [" Male ", "F", "?"], "string", ("gender", 0.99)),
        ("Year", [1950, 2001], "int", ("date", 0.77)),
        ("Weight", [70, 80], "int", (None, None)),
        ("Mail", [], "string", ("email", 0.6)),
    ],
)
def test_best_candidate(sheet, header, values, dtype, expected):
    assert best(sheet, header, values, dtype) == expected


def test_pattern_order_is_fixed():
    assert [p.type for p in PATTERNS] == (
        "email ssn creditcard phone nhi mrn ip dob name address postcode age gender date".split()
    )


@pytest.fixture
def book(sheet):
    patients = sheet(
        "Name string, Email string, NHI string, DOB string, Postcode string, Note string",
        [("Al", "al@x.org", "ABC1234", "1990-01-01", "1010", "ok"), ("Bo", "bo@x.org", "DEF5678", "1985-02-02", "2020", "")],
        "patients",
    )
    stays = sheet("NHI string, Admitted string, Score int", [("ABC1234", "2024-01-05", 7), ("DEF5678", "2024-02-10", 5)], "stays")
    return Workbook([patients, stays, sheet("Column1 string", [], "empty")])


def test_workbook_report_and_rules(book):
    found = detect(book)
    report = {(r["sheet"], r["header"]): r for r in found.report(include_samples=True).collect()}
    assert len(report) == 10
    assert report["patients", "Note"]["best_type"] is None and report["patients", "Note"]["sample_size"] == 1
    email = report["patients", "Email"]
    assert email["sample_values"] == ["al@x.org", "bo@x.org"] and email["detections"][0]["evidence"][:] == (True, 1.0)
    assert "sample_values" not in found.report().columns
    assert tuple(found.summary.first()) == (5, 2)
    rules = found.rules
    assert [(r.kind, r.target, r.action) for r in rules.rules] == [
        ("equals", "Name", "redact"), ("equals", "Email", "redact"), ("equals", "NHI", "anonymize"), ("equals", "DOB", "ageFromDate"),
        ("empty", True, "drop"), ("startsWith", "column", "drop"),
    ]
    assert rules.quasi_identifiers == ("Postcode", "Admitted") and rules.min_k == 5


def test_detect_then_clean(book):
    clean = clean_workbook(book, detect(book).rules)
    assert clean["patients"].columns == ["Name", "Email", "ID", "Age", "Postcode", "Note"]
    assert {r["ID"] for r in clean["patients"].rows.collect()} == {r["ID"] for r in clean["stays"].rows.collect()}


def test_samples_of_sparse_columns_are_exact(spark):
    frame = spark.range(5000).select(
        F.col("id").alias("_pos"),
        F.concat(F.lit("d"), "id").alias("dense"),
        F.when(F.col("id") % 300 == 299, F.col("id").cast("string")).otherwise("").alias("sparse"),
        F.lit(None).cast("string").alias("never"),
    )
    got = {(r["col_idx"], r["rank"]): r["value"] for r in first_values([Sheet("s", frame, "_pos")]).collect()}
    want = {(0, i + 1): f"d{i}" for i in range(25)} | {(1, i + 1): str(300 * i + 299) for i in range(16)}
    assert got == want


def test_no_quasi_columns_means_no_threshold(sheet):
    rules = detect(sheet("Email string", [("a@b.co",)])).rules
    assert rules.min_k is None and rules.quasi_identifiers == ()


def test_sparse_columns_share_one_scan(spark, tmp_path):
    """Fifty columns that the first rows don't fill: one bounded read and one read of the whole sheet, exact values."""
    every = {c: 700 + 13 * c for c in range(50)}
    columns = [F.when(F.col("id") % every[c] == 0, F.concat(F.lit(f"v{c}-"), "id")).alias(f"sparse{c}") for c in range(50)]
    spark.range(20_000).select(F.col("id").alias("_pos"), *columns).repartition(6).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    found = first_values([Sheet("s", frame, "_pos")], 5)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    got = {(r["col_idx"], r["rank"]): r["value"] for r in found.collect()}
    assert got == {(c, i + 1): f"v{c}-{i * every[c]}" for c in range(50) for i in range(5)}


def test_full_scan_sees_late_values_and_reads_samples_on_request_only(spark):
    late = F.when(F.col("id") < 1500, F.lit("note")).otherwise(F.concat(F.lit("u"), "id", F.lit("@x.org")))
    frame = spark.range(20_000).select(F.col("id").alias("_pos"), late.alias("Remark"), (F.col("id") % 2 == 0).alias("Age"))
    sheet = Sheet("s", frame, "_pos")
    assert detect(sheet).report().where("header = 'Remark'").first().best_type is None
    found = detect(sheet, None)
    report = {r.header: r for r in found.report(include_samples=True).collect()}
    assert (report["Remark"].best_type, report["Remark"].sample_size, report["Remark"].sample_values) == ("email", 20_000, ["note"] * 3)
    # A column of booleans: every value passes, none twice.
    assert report["Age"].detections[0].evidence.valueRate == 1.0
    assert "Window" not in found.report()._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.target, r.action) for r in found.rules.rules][:1] == [("Remark", "redact")]


def test_full_scan_without_an_order(spark):
    found = detect(Sheet("s", spark.createDataFrame([("a@b.co", None)], "Mail string, never string")), None)
    assert [(r.header, r.sample_size, r.sample_values) for r in found.report(include_samples=True).orderBy("col_idx").collect()] == [
        ("Mail", 1, []), ("never", 0, []),
    ]


def test_value_tests_stay_compiled(spark):
    """No generated method beyond 8000 bytes, which the JVM would only interpret."""
    values = spark.createDataFrame([(0, 0, "text", "1990-01-05"), (0, 0, "text", "5 Jan 1990"), (0, 0, "text", "no date"), (0, 0, "text", None)],
                                   "sheet_idx int, col_idx int, kind string, value string")
    counted = measure(values).groupBy("sheet_idx", "col_idx").agg(*_hits())
    date = [p.type for p in PATTERNS].index("date")
    assert counted.first()[f"h{date}"] == 2
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows the code of the whole plan without running it
    try:
        parts = measure(values).groupBy("sheet_idx", "col_idx").agg(*_hits())._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert parts.size()
    assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000


def test_date_hits_say_what_the_date_test_says(spark):
    texts = ["", None, " 1990", "1990-02-30", "1890-01-01x", "2024-01-02T10:00:00Z", "1/2/90", "1/2/1899", "99-1-2000", "Jan 5, 1990",
             " 5 January 1990 ", "Foo 5 1990", "3000", "1990/1/5", "12345", "7/8/123", "x1990-01-01", "1/2-1990"]
    value, trimmed = F.col("v"), trim_ws(F.col("v"))
    hits = shape_hits(value, date_shape(value, trimmed), trimmed)
    found = spark.createDataFrame([(t,) for t in texts], "v string").select("v", looks_like_date(value).alias("a"), F.array(*hits).alias("b"))
    assert all([h for h in r["b"] if h] == [1] * r["a"] for r in found.collect())

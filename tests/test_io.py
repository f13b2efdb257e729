import csv
import datetime as dt
import glob
import io
import json
import zipfile

import pytest
from conftest import AS_OF, ordered, stats
from pyspark.sql import functions as F

from veilframe import DEFAULT_RULES, Rule, RuleSet, Sheet, Workbook, clean_sheet, clean_workbook
from veilframe.catalogue.xlsx import xlsx_bytes
from veilframe.operators.preview import preview, preview_meta
from veilframe.operators.stats import sheet_stats, workbook_summary
from veilframe.sinks.outputs import read_runs, sheets_of, write_csv, write_outputs
from veilframe.sinks.retention import expired, ttl_millis
from veilframe.sources.screening import list_inputs, screen
from veilframe.sources.sheets import read_csv, read_csv_sheet, read_parquet_sheet
from veilframe.sources.workbook_files import cells, read_workbook_rows, to_workbook


def parts(path):
    out = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name, newline="", encoding="utf-8") as handle:
            out.append(handle.read())
    return out


TRICKY = [("a, b", 'say "hi"', 1.0), (" lead ", "tail ", 2.5), ("", None, None), ("two\nlines", "\\back", -3.0)]


def test_csv_text_and_reading_back(spark, sheet, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(clean_sheet(sheet("p string, q string, n double", [*TRICKY[:2], ("", None, 0.0), TRICKY[3]]), RuleSet()), path)
    text = [row for part in parts(path) for row in list(csv.reader(io.StringIO(part)))[1:]]
    assert text == [["a, b", 'say "hi"', "1"], [" lead ", "tail ", "2.5"], ["", "", "0"], ["two\nlines", "\\back", "-3"]]
    back = read_csv(spark, path)
    assert {tuple(r) for r in back.collect()} == {
        ("a, b", 'say "hi"', "1"), (" lead ", "tail ", "2.5"), (None, None, "0"), ("two\nlines", "\\back", "-3"),
    }


def test_csv_of_zero_rows_has_its_header_and_no_columns_is_an_error(sheet, tmp_path):
    write_csv(clean_sheet(sheet("a string, b string", []), RuleSet()), str(tmp_path / "empty"))
    assert [p.strip() for p in parts(tmp_path / "empty")] == ["a,b"]
    with pytest.raises(ValueError, match="nothing to write"):
        write_csv(clean_sheet(sheet("Column1 string", [("x",)])), str(tmp_path / "none"))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a,b\n1,2\n", [("1", "2")]),
        ('h,i\n"x, y",z\n', [("x, y", "z")]),
        ('h\n"She said ""no"""\n', [('She said "no"',)]),
        ("h,i\r\n1,2\r\n", [("1", "2")]),
        ('h,i\n"one\ntwo",\n', [("one\ntwo", None)]),
    ],
)
def test_csv_reader(spark, tmp_path, text, expected):
    (tmp_path / "in.csv").write_bytes(text.encode())
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "in.csv")).collect()] == expected


def case_mix(sheet):
    pre = sheet(
        "Name string, NHI string, DOB string, Contact string, Weight int, `Column 4` string",
        [("An", "N-1", "1968-03-15", "0", 78, "x"), ("Bo", "N-2", "1992-07-22", "1", 85, "x"), ("An", "N-1", "1968-03-15", "0", 78, "x")],
        "Pre Op",
    )
    post = sheet("NHI string, DOB string, Pain int", [("N-2", "1992-07-22", 0), ("", "1975-09-08", 3), ("N-9", "unknown", 4)], "pre/op")
    return Workbook([pre, post])


def test_outputs_manifest_and_summary(spark, sheet, tmp_path):
    book = clean_workbook(case_mix(sheet), as_of=AS_OF)
    when = dt.datetime(2024, 6, 30, 1, 2, 3, tzinfo=dt.timezone.utc)
    done = write_outputs(book, str(tmp_path), "Case Mix (May).xlsx", generated_at=when)
    assert done.run_id.startswith("case_mix_may-")
    assert [s.rsplit("/", 1)[1] for s in done.sheets] == ["sheet=0-pre_op", "sheet=1-pre_op"]
    document = json.loads("".join(parts(done.manifest)))
    assert document["sourceFileName"] == "Case Mix (May).xlsx" and document["generatedAt"] == "2024-06-30T01:02:03.000Z"
    assert document["files"] == ["sheet=0-pre_op", "sheet=1-pre_op"]
    assert [document[c] for c in ("sheetsProcessed", "rowsProcessed", "duplicatesRemoved", "invalidDobCount", "missingNhiCount", "redactedCellCount")] == [2, 6, 1, 1, 1, 0]
    assert document["sheets"][1] == {
        "sheetName": "pre/op", "fileName": "sheet=1-pre_op", "rowsProcessed": 3, "duplicatesRemoved": 0, "invalidDobCount": 1,
        "missingNhiCount": 1, "redactedCellCount": 0,
    }
    assert [line for p in parts(done.sheets[1]) for line in p.splitlines()[1:]] == ["ID-002,31,0", ",48,3", "ID-003,,4"]
    write_outputs(book, str(tmp_path), "again.ods", run_id="second")
    runs = read_runs(spark, str(tmp_path))
    assert {r["run"] for r in runs.collect()} == {done.run_id, "second"} and sheets_of(runs).count() == 4
    old = expired(runs, F.lit(dt.datetime(2024, 7, 2, tzinfo=dt.timezone.utc)), modified="generatedAt").collect()
    assert [r["run"] for r in old] == [done.run_id]


def test_summary_rows_and_total(sheet):
    book = clean_workbook(case_mix(sheet), as_of=AS_OF)
    rows = {r["sheet"]: tuple(r)[2:] for r in workbook_summary(book).collect()}
    assert rows == {"Pre Op": (1, 3, 1, 0, 0, 0), "pre/op": (1, 3, 0, 1, 1, 0), None: (2, 6, 1, 1, 1, 0)}
    assert [tuple(r) for r in sheet_stats(book).orderBy("sheet_idx").collect()] == [
        (0, "Pre Op", 3, 1, 0, 0, 0), (1, "pre/op", 3, 0, 1, 1, 0),
    ]


def test_dry_run_preview(spark, sheet, tmp_path):
    rows = [(f"n{i // 2}", i // 2) for i in range(100)]
    clean = clean_sheet(sheet("NHI string, x int", rows))
    assert [tuple(r) for r in preview(clean, 4).collect()] == [("ID-001", 0), ("ID-002", 1), ("ID-003", 2)]
    assert preview(clean).count() == 24
    assert tuple(preview_meta(clean).first()) == (50, 24, True)
    assert tuple(preview_meta(clean, 51).first()) == (50, 50, False)
    assert preview(clean, 1).count() == 0


@pytest.mark.parametrize(("hours", "millis"), [(None, 86_400_000), ("", 86_400_000), ("2", 7_200_000), (0.5, 1_800_000), (0, 86_400_000), (-1, 86_400_000), ("x", 86_400_000), (float("inf"), 86_400_000)])
def test_time_to_live(hours, millis):
    assert ttl_millis(hours) == millis


def test_expiry_is_strict_and_files_are_listed(spark, tmp_path):
    now = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    listing = spark.createDataFrame([("kept", now - dt.timedelta(hours=24)), ("gone", now - dt.timedelta(hours=24, milliseconds=1))], "path string, modificationTime timestamp")
    assert [r["path"] for r in expired(listing, F.lit(now)).collect()] == ["gone"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.csv").write_text("x")
    assert [r["length"] for r in list_inputs(spark, str(tmp_path)).collect()] == [1]


def test_screening(spark, tmp_path):
    sizes = {"ok.xlsx": 10, "OK.ODS": 10, "old.Xls": 10, "big.xlsx": 5 * 1024 * 1024 + 1, "edge.xlsx": 5 * 1024 * 1024, "notes.csv": 1, "noext": 1, "x.xlsx.exe": 1}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(b"0" * size)
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in screen(list_inputs(spark, str(tmp_path))).collect()}
    bad, large = "unsupported file type", "file too large"
    assert got == {"ok.xlsx": None, "OK.ODS": None, "old.Xls": None, "big.xlsx": large, "edge.xlsx": None, "notes.csv": bad, "noext": bad, "x.xlsx.exe": bad}


def test_parquet_position_follows_files_and_rows(spark, tmp_path):
    for i, name in enumerate(["a", "b"]):
        spark.range(i * 10, i * 10 + 5).coalesce(1).write.parquet(str(tmp_path / "t" / f"part={name}"))
    single = read_parquet_sheet(spark, "s", str(tmp_path / "t" / "part=b"))
    assert [tuple(r) for r in single.frame.orderBy("_pos").collect()] == [(10 + i, i) for i in range(5)]
    both = read_parquet_sheet(spark, "s", str(tmp_path / "t"))
    assert [r["id"] for r in both.frame.orderBy("_pos").collect()] == [*range(5), *range(10, 15)]
    assert both.headers == ["id", "part"] and both.frame.where("_pos IS NULL").count() == 0
    named = read_parquet_sheet(spark, "s", str(tmp_path / "t"), pos="id")
    assert named.headers == ["part"]


ODS = """<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0"
 xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0">
<office:body><office:spreadsheet><table:table table:name="Plan">
<table:table-row><table:table-cell office:value-type="string"><text:p>NHI</text:p></table:table-cell>
<table:table-cell office:value-type="string"><text:p>Score</text:p></table:table-cell>
<table:table-cell office:value-type="string"><text:p>Ok</text:p></table:table-cell></table:table-row>
<table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="string"><text:p>Z<text:span>9</text:span></text:p></table:table-cell>
<table:table-cell office:value-type="float" office:value="4.5"/><table:table-cell office:value-type="boolean" office:boolean-value="true"/>
<table:table-cell table:number-columns-repeated="1000"/></table:table-row>
<table:table-row table:number-rows-repeated="5"><table:table-cell table:number-columns-repeated="1000"/></table:table-row>
<table:table-row><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="boolean" office:boolean-value="false"/></table:table-row>
<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row>
</table:table></office:spreadsheet></office:body></office:document-content>"""


def write_files(folder):
    pre = [["NHI", "Weight", None, "Mixed"], ["A1", 70, None, 1], ["A2", 71.5, "x", "t", "beyond"], [None, None], ["A1", 70]]
    (folder / "1.xlsx").write_bytes(xlsx_bytes([("Pre", pre), ("Empty", []), ("Flags", [["f"], [True], [False]])]))
    (folder / "2.xlsx").write_bytes(xlsx_bytes([("Pre", [["NHI", "Weight", None, "Mixed"], ["A3", 0]])]))
    with zipfile.ZipFile(folder / "3.ods", "w") as book:
        book.writestr("content.xml", ODS)
    (folder / "skip.csv").write_text("a,b")


def test_workbook_files(spark, tmp_path):
    write_files(tmp_path)
    rows = read_workbook_rows(spark, str(tmp_path))
    assert cells(rows).where("sheet = 'Pre' AND row_idx = 1 AND path LIKE '%1.xlsx'").orderBy("col_idx").select("kind", "value").collect() == [
        ("s", "A1"), ("n", "70"), (None, None), ("n", "1"),
    ]
    book = to_workbook(rows)
    assert [s.name for s in book] == ["Pre", "Flags", "Plan"]
    pre = book["Pre"]
    assert pre.headers == ["NHI", "Weight", "", "Mixed"]
    assert [t.simpleString() for t in pre.types] == ["string", "double", "string", "string"]
    assert [tuple(r)[1:] for r in pre.frame.orderBy("_pos").collect()] == [
        ("A1", 70.0, None, "1"), ("A2", 71.5, "x", "t"), (None, None, None, None), ("A1", 70.0, None, None), ("A3", 0.0, None, None),
    ]
    assert [r["f"] for r in book["Flags"].frame.orderBy("_pos").collect()] == [True, False]
    plan = [tuple(r)[1:] for r in book["Plan"].frame.orderBy("_pos").collect()]
    assert plan == [("Z9", 4.5, True)] * 2 + [(None, None, None)] * 5 + [(None, None, False)]
    clean = clean_workbook(book, RuleSet(DEFAULT_RULES.rules[:3]))
    assert ordered(clean["Pre"])[0] == ("ID-001", 70.0, "1") and stats(clean["Pre"])[0] == 4


def test_shared_strings_and_cell_references(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="x"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="/xl/worksheets/one.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>h</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        book.writestr(
            "xl/worksheets/one.xml",
            f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3" t="str"><f>1</f><v>g</v></c></row>'
            f'<row r="5"><c r="B5" t="s"><v>1</v></c><c r="C5" t="e"><v>#N/A</v></c><c r="D5"><v>2</v></c></row></sheetData></worksheet>',
        )
    book = to_workbook(read_workbook_rows(spark, str(tmp_path)))
    assert book["S"].headers == ["h", "", "g"]
    assert [tuple(r)[1:] for r in book["S"].frame.orderBy("_pos").collect()] == [(None, None, None), ("rich", None, 2.0)]


def test_one_sheet_name_needs_one_header(spark, tmp_path):
    for i, header in enumerate(["a", "b"]):
        (tmp_path / f"{i}.xlsx").write_bytes(xlsx_bytes([("S", [[header], ["v"]])]))
    with pytest.raises(ValueError, match="share its header"):
        to_workbook(read_workbook_rows(spark, str(tmp_path)))


def test_rule_order_in_outputs(sheet):
    rules = RuleSet((Rule("equals", "a", "rename", output_name="b"),))
    assert clean_sheet(Sheet("s", sheet("a int, b int", [(1, 2)]).frame, "_pos"), rules).rows.columns == ["b", "b"]


def test_csv_sheets_have_an_order(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("NHI,n\n" + "".join(f"k{i // 2},{i}\n" for i in range(40)))
    sheet = read_csv_sheet(spark, "s", str(folder))
    assert ordered(clean_sheet(sheet)) == [(f"ID-{i // 2 + 1:03d}", str(i)) for i in range(40)]
    (folder / "b.csv").write_text("NHI,n\nx,99\n")
    for pos in (None, "n"):
        assert ordered(clean_sheet(read_csv_sheet(spark, "s", str(folder), pos)))[-1][0] == "ID-021"

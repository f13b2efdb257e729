"""Registries that merge rows, regexes and thresholds of rule files, scratch scopes, ingest, and stream state that ends."""

import os
import threading

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from veilframe.catalogue.xlsx import xlsx_bytes
from veilframe.operators.clean import clean_sheet, clean_workbook
from veilframe.operators.detect import detect
from veilframe.operators.kanon import workbook_reports
from veilframe.operators.preview import preview, preview_meta
from veilframe.plans.rules import DEFAULT_RULES, Rule, RuleError, RuleSet
from veilframe.session import materialize, scratch, shared_folder
from veilframe.sinks.outputs import write_outputs
from veilframe.sources.sheets import Sheet, Workbook
from veilframe.sources.workbook_files import outcomes, read_workbook_rows, to_workbook, workbook_rows
from veilframe.streaming.throttle import throttle_stream

ID_AND_V = RuleSet((Rule("equals", "nhi", "anonymize", output_name="ID"),))


def files_below(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names)


def test_registry_merges_rows(spark, sheet):
    people = sheet("NHI string, v int", [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 2)])
    registry = spark.createDataFrame([("c", "P1"), ("d", "P1")], "key string, id string")
    clean = clean_sheet(people, ID_AND_V, registry, as_of=AS_OF)
    assert sorted(map(tuple, clean.rows.collect())) == [("", 1), ("P1", 1), ("P1", 2)]
    assert clean.stats.first().duplicatesRemoved == 2 and clean.stats.first().rowsProcessed == 5
    assert [tuple(r) for r in preview(clean).collect()] == [("", 1), ("P1", 1), ("P1", 2)]
    assert preview_meta(clean).first().totalDataRows == 3


def test_k_scores_need_no_ids(spark, sheet):
    before = files_below(shared_folder(spark))
    people = sheet("NHI string, Age int", [("a", 1), ("b", 1), (None, 2), (" ", 2)])
    book = clean_workbook(Workbook([people]), DEFAULT_RULES, as_of=AS_OF)
    report = workbook_reports(book, RuleSet(DEFAULT_RULES.rules, ("ID", "Age"), 1)).first()
    assert (report.k, report.totalRows, report.uniqueGroups) == (1, 3, 3)
    assert files_below(shared_folder(spark)) == before


def test_regexes_are_those_of_the_engine(spark):
    make = lambda pattern: RuleSet.from_dict({"rules": [{"match": {"regex": pattern}, "action": "drop"}]})
    assert make("(?<y>dob)").rules[0].target == "(?<y>dob)"
    for bad in ("(?P<y>dob)", "(", "[a"):
        with pytest.raises(RuleError):
            make(bad)


@pytest.mark.parametrize("k", [float("inf"), float("nan"), 0, 1.5, "2", True])
def test_bad_thresholds_are_rule_errors(k):
    with pytest.raises(RuleError):
        RuleSet.from_dict({"rules": [], "kAnonymity": {"minK": k}})


def test_scope_removes_its_tables_even_after_an_error(spark):
    with scratch(spark) as folder:
        assert materialize(spark.range(5), "x").count() == 5
        assert files_below(folder)
    assert not files_below(folder)
    with pytest.raises(ZeroDivisionError), scratch(spark) as folder:
        materialize(spark.range(5), "x")
        raise ZeroDivisionError
    assert not files_below(folder)


def test_outputs_leave_no_intermediate_tables(spark, sheet, tmp_path):
    people = sheet("NHI string, v int", [("a", 1), ("b", 1), ("a", 1)])
    before = files_below(shared_folder(spark))
    book = clean_workbook(Workbook([people]), DEFAULT_RULES, as_of=AS_OF)
    write_outputs(book, str(tmp_path), "in.xlsx")
    with pytest.raises(Exception):  # noqa: B017  the target is a file
        write_outputs(book, __file__, "in.xlsx")
    assert files_below(shared_folder(spark)) == before
    assert book["sheet"].rows.count() == 2  # the book still works


def test_scopes_of_threads_stay_apart(spark):
    """A table that one thread writes while another has a scope open isn't deleted with that scope."""
    opened, written = threading.Event(), threading.Event()
    tables = {}

    def other():
        opened.wait(60)
        tables["other"] = materialize(spark.range(7), "y")
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark) as folder:
        opened.set()
        assert written.wait(60)
        materialize(spark.range(5), "x")
        assert all("/y-" not in f for f in files_below(folder))
    thread.join()
    assert tables["other"].count() == 7


def test_a_failed_run_leaves_nothing_and_none_is_overwritten(spark, sheet, tmp_path):
    good, bad = sheet("NHI string, v int", [("a", 1)], "good"), sheet("v int", [(1,)], "bad")
    broken = Sheet("bad", bad.frame.withColumn("v", F.raise_error(F.lit("no such cell"))), "_pos")
    with pytest.raises(Exception, match="no such cell"):
        write_outputs(clean_workbook(Workbook([good, broken]), DEFAULT_RULES, as_of=AS_OF), str(tmp_path / "out"), "in.xlsx", "r1")
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
    book = clean_workbook(Workbook([good]), DEFAULT_RULES, as_of=AS_OF)
    run = write_outputs(book, str(tmp_path / "out"), "in.xlsx", "r1")
    assert os.listdir(tmp_path / "out") == ["run=r1"] and os.path.isdir(run.sheets[0])
    with pytest.raises(FileExistsError):
        write_outputs(book, str(tmp_path / "out"), "in.xlsx", "r1")
    assert os.listdir(tmp_path / "out") == ["run=r1"]


def test_every_listed_file_has_an_outcome(spark, tmp_path):
    good = xlsx_bytes([("s", [["h"], [1.0]])])
    large = xlsx_bytes([("s", [["h"], *[[f"{i}" * 40] for i in range(900)]])])
    for name, data in {"a.xlsx": good, "B.XLSX": large, "c.xls": good, "d.xlsx": good[:60], "e.txt": b"text"}.items():
        (tmp_path / name).write_bytes(data)
    listing = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    rows = read_workbook_rows(spark, str(tmp_path))
    got = {os.path.basename(r.path): (r.outcome, r.rows) for r in outcomes(listing, rows).collect()}
    assert got == {"a.xlsx": ("read", 2), "B.XLSX": ("read", 901), "c.xls": ("rejected", 0), "d.xlsx": ("failed", 0), "e.txt": ("rejected", 0)}
    capped = outcomes(listing, read_workbook_rows(spark, str(tmp_path), 2000), 2000)
    assert capped.where("path like '%B.XLSX'").first()[1:3] == ("rejected", "file too large")
    with pytest.raises(ValueError, match="d.xlsx"):
        to_workbook(rows)
    assert list(to_workbook(rows, skip_failed=True))[0].frame.count() == 901
    assert workbook_rows(spark.createDataFrame([("x", bytearray(b"no zip"))], "path string, content binary")).first().error


def test_full_scan_reports_sample_values(sheet):
    found = detect(sheet("Email string, n int", [("a@b.co", 1), (None, 2), ("c@d.co", 3), ("e@f.co", 4), ("g@h.co", 5)]), None)
    report = {r.header: r.sample_values for r in found.report(include_samples=True).collect()}
    assert report == {"Email": ["a@b.co", "c@d.co", "e@f.co"], "n": ["1", "2", "3"]}


def test_stream_state_ends_with_its_window(spark, tmp_path):
    source = tmp_path / "in"
    hits = [(k, 100_000 + s, i) for k, s, i in (("u", 0, 1), ("u", 10, 2), ("v", 500, 3), ("u", 1000, 4), ("v", 4000, 5))]
    for i, (key, second, hit) in enumerate(hits):
        row = spark.createDataFrame([(key, second, hit)], "k string, s long, id long").select("k", F.timestamp_seconds("s").alias("ts"), "id")
        row.coalesce(1).write.mode("append").parquet(str(source))
        os.utime(max((str(p) for p in source.glob("*.parquet")), key=os.path.getmtime), (1_000_000 + i * 100,) * 2)
    stream = spark.readStream.schema("k string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(source))
    counted = throttle_stream(stream, "k", "ts", "id", window_seconds=60, max_hits=1, watermark="1 minute")
    query = counted.writeStream.format("memory").queryName("ending").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    assert {(r.id, r.hit_count) for r in spark.table("ending").collect()} == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)}
    assert left <= 1

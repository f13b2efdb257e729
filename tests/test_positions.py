"""Positions that come from where rows lie in files: split CSV against a sequential parser, Parquet over many files."""

import csv
import gzip
import io
import random

import pytest

from veilframe.operators.clean import clean_sheet
from veilframe.plans.rules import Rule, RuleSet
from veilframe.sources.csv_records import read_records, read_split_csv
from veilframe.sources.sheets import OrderError, _positioned, read_csv, read_csv_sheet, read_parquet_sheet

CELLS = ["", "a", "Zoë", 'say "hi"', "two\nlines", "x,y", '"', '""', "\n", "a\r\nb", "  spaced ", "long " * 30, 'q"\n"\n"r', "é\n" * 40]


@pytest.fixture
def small_splits(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    own.conf.set("spark.sql.files.maxPartitionBytes", "50")
    return own


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',"\r\n') or cell.startswith(" ") else cell


def write(path, rows, end):
    path.write_bytes("".join(",".join(map(quoted, r)) + end for r in rows).encode())


def sequential(path):
    text = path.read_bytes().decode()
    return [tuple(c or None for c in r) for r in csv.reader(io.StringIO(text, newline="")) if r][1:]


@pytest.mark.parametrize("limit", ["10MB", "-1"])
@pytest.mark.parametrize("end, seed", [("\n", 1), ("\r\n", 2)])
def test_splits_against_a_sequential_parser(small_splits, tmp_path, end, seed, limit):
    small_splits.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rng, want = random.Random(seed), []
    for name, count in (("a", 60), ("b", 0), ("c", 25), ("d", 1)):
        path = tmp_path / f"{name}.csv"
        write(path, [("k", "v", "w")] + [(f"{name}{i}", rng.choice(CELLS), rng.choice(CELLS)) for i in range(count)], end)
        want += sequential(path)
    frame = read_split_csv(small_splits, str(tmp_path), "at")
    assert frame.columns == ["k", "v", "w", "at"]
    got = frame.orderBy("at").collect()
    assert [tuple(r)[:3] for r in got] == want
    assert len({r["at"] for r in got}) == len(got)
    assert frame.rdd.getNumPartitions() > 4 or limit == "-1"
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_positions_are_byte_offsets(small_splits, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'h\r\n"x\n\n' + b"y" * 300 + b'"\n\r\n\nz\n')
    (tmp_path / "b.csv").write_bytes("h\né\nlast".encode())
    rows = read_records(small_splits, str(tmp_path)).orderBy("at").collect()
    assert [(r["at"], r["first"]) for r in rows] == [(0, True), (3, False), (312, False), (314, True), (316, False), (319, False)]
    assert [r["record"] for r in rows][1:3] == ['"x\n\n' + "y" * 300 + '"', "z"]


def test_compressed_unclosed_and_wrong_files(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('h,i\n1,"a\nb"\n')
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write('h,i\n2,"c\n\nd"\n3,\n')
    rows = read_split_csv(small_splits, str(tmp_path), "at").orderBy("at").collect()
    assert [(r["h"], r["i"]) for r in rows] == [("1", "a\nb"), ("2", "c\n\nd"), ("3", None)]
    (tmp_path / "c.csv").write_text('h,i\n4,"open\n5,e\n')
    assert read_split_csv(small_splits, str(tmp_path), "at").count() == 4
    (tmp_path / "d.csv").write_text("h,j\n6,f\n")
    with pytest.raises(Exception, match="another header"):
        read_split_csv(small_splits, str(tmp_path), "at").collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv_sheet(small_splits, "s", str(tmp_path / "e"))


def test_agrees_with_the_whole_file_reader(spark, tmp_path):
    rows = [(i, random.Random(i).choice(CELLS), None if i % 5 else "") for i in range(200)]
    frame = spark.createDataFrame(rows, "n int, text string, `odd, name` string")
    frame.coalesce(1).write.csv(str(tmp_path / "t"), header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    split = read_csv_sheet(spark, "s", str(tmp_path / "t")).frame.drop("_pos")
    whole = read_csv(spark, str(tmp_path / "t"))
    assert split.columns == whole.columns
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_ids_follow_the_lines_of_several_files(small_splits, tmp_path):
    for name, ids in (("b", "zxz"), ("a", "yxw")):
        write(tmp_path / f"{name}.csv", [("NHI", "note")] + [(i, "two\nlines") for i in ids], "\n")
    rules = RuleSet((Rule("equals", "nhi", "anonymize", output_name="ID"),))
    clean = clean_sheet(read_csv_sheet(small_splits, "s", str(tmp_path)), rules)
    assert {r.key: r.id for r in clean.mapping.frame.collect()} == {"y": "ID-001", "x": "ID-002", "w": "ID-003", "z": "ID-004"}


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_parquet_positions_count_over_files(spark, tmp_path, limit):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    path = str(tmp_path / "t")
    own.range(1000).repartitionByRange(9, "id").sortWithinPartitions("id").write.parquet(path)
    sheet = read_parquet_sheet(own, "s", path)
    assert sheet.frame.where("_pos <> id").count() == 0 and sheet.frame.count() == 1000
    # A file without a start raises.
    with pytest.raises(Exception, match="were not there"):
        _positioned(own.read.parquet(path), own.createDataFrame([], "_file long, _start long"), path).collect()


def test_csv_without_a_position_column_needs_none(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,v\n2,b\n1,a\n")
    assert read_csv_sheet(spark, "s", str(tmp_path), pos="n").frame.dtypes == [("n", "bigint"), ("v", "string")]
    assert issubclass(OrderError, ValueError)

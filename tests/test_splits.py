"""Splits of CSV files, dealt to tasks."""

from veilframe.catalogue import queries
from veilframe.sources.csv_records import _lines


def test_many_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    text = 'several words, a "quote" and\n a line break ' * 500
    rows = [(i, f"{i} {text}", "en", "made") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    read = queries.read_csv_sheet
    monkeypatch.setattr(queries, "read_csv_sheet", lambda own, name, path: seen.append((own, path)) or read(own, name, path))
    found = queries.csv_positions(spark, str(tmp_path))
    assert [r["doc_id"] for r in found.orderBy("n").collect()] == [str(i) for i in range(300)]
    lines = _lines(*seen[0])
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert lines.select("path", "start").distinct().count() > 2 * tasks  # splits stay small
    assert lines.rdd.getNumPartitions() < 1.5 * tasks

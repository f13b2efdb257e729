import datetime as dt
from collections import defaultdict

import pytest
from conftest import AS_OF, SF
from pyspark.sql import functions as F

from veilframe import RuleSet, clean_sheet
from veilframe.catalogue import fixtures as fx
from veilframe.operators.throttle import throttle_audit
from veilframe.streaming.clean import clean_stream, dedup_stream
from veilframe.streaming.run import run_available
from veilframe.streaming.throttle import throttle_stream

RULES = RuleSet.from_dict(
    {
        "rules": [
            {"match": {"equals": "nhi"}, "action": "anonymize", "outputName": "ID"},
            {"match": {"equals": "dob"}, "action": "ageFromDate", "outputName": "Age"},
            {"match": {"equals": "phone"}, "action": "redact", "replaceWith": "-"},
            {"match": {"equals": "junk"}, "action": "drop"},
        ]
    }
)


@pytest.fixture
def feed(spark, tmp_path):
    """Two files of people rows as a stream, and the same rows as a batch."""
    schema = "_pos long, NHI string, DOB string, Phone string, Junk string, v int"
    rows = [(i, f" n{i % 4} " if i % 5 else "", "1990-01-01" if i % 3 else "?", "1", "j", i % 6) for i in range(24)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path), spark.read.schema(schema).parquet(path)


def test_stream_equals_batch_rows(spark, feed):
    stream, batch = feed
    mapping = clean_sheet(batch, RULES, as_of=AS_OF).mapping
    want = clean_stream(batch.drop("_pos"), RULES, mapping, as_of=AS_OF)
    got = run_available(clean_stream(stream.drop("_pos"), RULES, mapping, as_of=AS_OF), "t")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 24
    assert got.columns == ["ID", "Age", "Phone", "v"]
    # Distinct stream rows are the batch result.
    assert got.distinct().exceptAll(clean_sheet(batch, RULES, as_of=AS_OF).rows).count() == 0


def test_stream_ids_need_a_source(spark, feed):
    stream, _ = feed
    with pytest.raises(ValueError, match="mapping or an id_secret"):
        clean_stream(stream, RULES)
    got = run_available(clean_stream(stream, RULES, id_secret="pepper", as_of=AS_OF).select("ID"), "t")
    ids = {r["ID"] for r in got.collect()}
    assert len(ids) == 5 and "" in ids and all(len(i) == 67 for i in ids if i)


def test_stream_dedup_within_the_watermark(spark, feed):
    stream, _ = feed
    timed = stream.select((F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(mins="_pos")).cast("timestamp").alias("ts"), "v")
    assert sorted(r["v"] for r in run_available(dedup_stream(timed, "ts", "1 day").select("v"), "t").collect()) == [0, 1, 2, 3, 4, 5]


def sequential(hits, width, limit):
    """The rule itself, one hit at a time."""
    windows, out = {}, {}
    for key, at, i in sorted(hits):
        window = windows.get(key)
        if window is None or at >= window[0] + width:
            window = windows[key] = [at, 0]
        window[1] += 1
        left = (window[0] + width - at).total_seconds()
        out[i] = (window[0], window[1], window[1] > limit, max(1, -int(-left // 1)) if window[1] > limit else None)
    return out


def burst(spark):
    """One key holds a third of the hits, many at equal instants; windows end exactly at a later hit."""
    base = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(1200):
        key = 0 if i % 3 == 0 else i % 17
        rows.append((key, base + dt.timedelta(seconds=(i * 7) // (4 if key else 9) + (600 if i > 900 else 0)), i))
    return spark.createDataFrame(rows, "k int, ts timestamp, id long"), rows


@pytest.mark.parametrize("walk_limit", [10**6, 60, 1])
def test_audit_equals_the_sequential_rule(spark, walk_limit):
    frame, rows = burst(spark)
    got = throttle_audit(frame, "k", "ts", "id", 60, 5, walk_limit=walk_limit).collect()
    want = sequential(rows, dt.timedelta(seconds=60), 5)
    assert {r["id"]: (r["window_start"], r["hit_count"], r["over_limit"], r["retry_after"]) for r in got} == want


def test_hits_without_a_key_share_one(spark):
    at = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(None, at, 1), ("", at, 2), ("a", at, 3), (None, at, 4)], "k string, ts timestamp, id long")
    got = {r["id"]: (r["k"], r["hit_count"], r["over_limit"]) for r in throttle_audit(frame, "k", "ts", "id", 60, 2).collect()}
    assert got == {1: ("unknown", 1, False), 2: ("unknown", 2, False), 3: ("a", 1, False), 4: ("unknown", 3, True)}


def test_audit_stream_over_several_batches(spark, tmp_path):
    events = fx.table(spark, SF, "events").orderBy("ts")
    cut = events.approxQuantile("event_id", [0.5], 0)[0]
    events.where(F.col("event_id") <= cut).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    events.where(F.col("event_id") > cut).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    got = run_available(throttle_stream(stream, "user_id", "ts", "event_id", 86_400, 3), "t").collect()
    want = sequential([(r["user_id"], r["ts"], r["event_id"]) for r in events.collect()], dt.timedelta(days=1), 3)
    assert {r["event_id"]: (r["hit_count"], r["over_limit"]) for r in got} == {i: w[1:3] for i, w in want.items()}
    counts = defaultdict(int)
    for r in got:
        counts[r["user_id"], r["window_start_us"]] += 1
    assert all(r["hit_count"] <= counts[r["user_id"], r["window_start_us"]] for r in got)

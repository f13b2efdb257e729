"""Skew, partition counts and plan shapes: results must not depend on how the work is spread."""

from contextlib import contextmanager

import pytest
from conftest import AS_OF, SF, ordered
from pyspark.sql import functions as F

from veilframe import Sheet, Workbook, clean_sheet, clean_workbook, detect, k_report
from veilframe.catalogue import fixtures as fx
from veilframe.operators.lookup import Table, lookup
from veilframe.operators.ordered import asof_lookup, number_rows


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def skewed_sheet(spark, rows=20_000):
    """A third of the rows share one id, a third have none, the rest are spread."""
    frame = spark.range(rows).select(
        F.col("id").alias("_pos"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, " ").otherwise(F.concat(F.lit("k"), F.col("id") % 4001)).alias("NHI"),
        F.col("id").alias("x"),
    )
    return Sheet("skewed", frame, "_pos")


def expected_ids(rows):
    ids, out = {}, []
    for nhi, x in rows:
        key = nhi.strip()
        out.append((ids.setdefault(key, f"ID-{len(ids) + 1:03d}") if key else "", x))
    return out


@pytest.mark.parametrize("partitions", ["1", "200"])
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_skewed_ids_equal_the_sequential_rule(spark, partitions, broadcast):
    with settings(
        spark,
        spark__sql__shuffle__partitions=partitions,
        spark__sql__autoBroadcastJoinThreshold=broadcast,
        spark__sql__adaptive__coalescePartitions__enabled="false",
    ):
        sheet = skewed_sheet(spark)
        source = [(r["NHI"], r["x"]) for r in sheet.frame.orderBy("_pos").collect()]
        assert ordered(clean_sheet(sheet)) == expected_ids(source)


def test_large_mapping_broadcasts_hot_keys_only(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        clean = clean_sheet(skewed_sheet(spark))
        assert not clean.mapping.fits_broadcast()
        plan = plan_of(clean.rows)
        assert "BroadcastHashJoin" in plan and ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan)


def test_hot_keys_of_any_length_are_broadcast(spark):
    """A third of the rows share a key of 2 KiB, another third one that differs in its last letter."""
    long = "x" * 2048
    frame = spark.range(6000).select(
        F.col("id").alias("_pos"),
        F.when(F.col("id") % 3 == 0, long + "a").when(F.col("id") % 3 == 1, long + "b").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("NHI"),
        F.col("id").alias("x"),
    )
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        clean = clean_sheet(Sheet("s", frame, "_pos"))
        assert ordered(clean) == expected_ids([(r["NHI"], r["x"]) for r in frame.orderBy("_pos").collect()])
        plan = plan_of(clean.rows)
    assert "_rdigest" in plan and "BroadcastHashJoin" in plan
    uses = {r["key"]: r["uses"] for r in clean.mapping.frame.where("uses > 1").collect()}
    assert uses == {long + "a": 2000, long + "b": 2000}


def test_lookup_paths_agree(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 5 < 3, 7).otherwise(F.col("id") % 97)).cast("long").alias("k")
    )
    right = left.groupBy("k").count().where("k IS NOT NULL AND k <> 50").withColumn("v", F.col("k") * 10)
    want = {r["id"]: None if r["k"] is None or r["k"] == 50 else r["k"] * 10 for r in left.collect()}
    for table in (
        Table(right, ("k",), "v", rows=97, key_bytes=800, uses="count", total_uses=3000),
        Table(right, ("k",), "v", rows=10**9, key_bytes=10**12, uses="count", total_uses=3000),
        Table(right, ("k",), "v"),
    ):
        assert {r["id"]: r["v"] for r in lookup(left, [F.col("k")], table, F.col("id"), "v").collect()} == want


def test_numbering_has_no_single_partition_and_no_gap(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("place"), "id")
    numbered = number_rows(frame, ["place"], "test")
    assert [r[0] for r in numbered.orderBy("place").select("number").collect()] == list(range(1, 5001))


@pytest.mark.parametrize("forward", [False, True])
def test_asof_lookup_against_brute_force(spark, forward):
    queries = spark.range(900).select((F.col("id") % 4).alias("g"), (F.col("id") * 37 % 500).alias("at"), "id")
    sources = spark.range(40).select((F.col("id") % 3).alias("g"), (F.col("id") * 13).alias("at"), (F.col("id") * 100).alias("v"))
    with settings(spark, spark__sql__shuffle__partitions="23", spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = {r["id"]: r["v"] for r in asof_lookup(queries, sources, "g", "at", "id", ["v"], forward=forward).collect()}
    table = [tuple(r) for r in sources.collect()]
    for g, at, i in (tuple(r) for r in queries.collect()):
        near = [(t, v) for sg, t, v in table if sg == g and (t >= at if forward else t <= at)]
        assert got[i] == ((min(near) if forward else max(near))[1] if near else None)


def test_plans_stay_in_the_jvm_and_off_one_partition(spark):
    people = fx.people(spark, SF)
    rows = clean_sheet(people, as_of=AS_OF).rows
    for frame in (rows, k_report(rows, ["Age", "Gender"]), detect(people).report()):
        plan = plan_of(frame)
        assert "Python" not in plan and "ArrowEval" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "SinglePartition" not in plan_of(rows)


def test_mapping_scan_reads_the_id_column_only(spark):
    from veilframe.operators.clean import Options, _key_columns
    from veilframe.operators.ids import first_seen
    from veilframe.plans.columns import plan_tables
    from veilframe.plans.rules import DEFAULT_RULES

    sheet = Sheet("customer", fx.table(spark, SF, "customer").withColumnRenamed("c_name", "NHI"), "c_custkey")
    plan = plan_tables(spark, [sheet.headers], DEFAULT_RULES)[0]
    text = plan_of(first_seen(_key_columns(sheet, 0, plan, Options())))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_sample_bound_is_pushed_to_the_scan(spark):
    from veilframe.operators.detect import first_values

    orders = Sheet("orders", fx.table(spark, SF, "orders"), "o_orderkey")
    assert "LessThanOrEqual(o_orderkey" in plan_of(first_values([orders]))


def test_shuffled_input_gives_the_same_result(spark):
    sheet = fx.people(spark, SF)
    mixed = Sheet("people", sheet.frame.repartition(13).orderBy(F.rand(1)), "pos")
    assert ordered(clean_sheet(mixed, as_of=AS_OF)) == ordered(clean_sheet(sheet, as_of=AS_OF))


def test_statistics_do_not_number_ids(spark):
    book = clean_workbook(Workbook([fx.people(spark, SF)]), as_of=AS_OF)
    assert "ids-" not in plan_of(book["people"].stats)
    assert book.find_mapping.cache_info().currsize == 0


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_given_registry_with_a_hot_key(spark, broadcast):
    sheet = skewed_sheet(spark, 3000)
    registry = spark.createDataFrame([("hot", "A"), ("k5", "B"), ("unused", "C")], "key string, id string")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=broadcast):
        got = ordered(clean_sheet(sheet, mapping=registry))
    want = [({"hot": "A", "k5": "B"}.get(r["NHI"], ""), r["x"]) for r in sheet.frame.orderBy("_pos").collect()]
    assert got == want


def test_preview_reads_a_prefix_and_falls_back(spark):
    from veilframe.operators.preview import _leading, preview

    def build(distinct_from):
        value = F.when(F.col("id") < distinct_from, F.lit("same")).otherwise(F.concat(F.lit("p"), "id"))
        return Sheet("s", spark.range(4000).select(F.col("id").alias("_pos"), value.alias("NHI")), "_pos")

    for distinct_from, prefixed in ((5, True), (3990, False)):
        clean = clean_sheet(build(distinct_from))
        assert (_leading(clean, 9) is not clean) == prefixed
        assert [tuple(r) for r in preview(clean, 10).collect()] == ordered(clean)[:9]
    second = clean_workbook(Workbook([Sheet("first", spark.range(7).select(F.col("id").alias("_pos"), F.col("id").cast("string").alias("NHI")), "_pos"), build(0)]))["s"]
    assert [r["ID"] for r in preview(second, 3).collect()] == ["ID-008", "ID-009"]

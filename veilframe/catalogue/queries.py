"""The registered queries. Each reads whole tables of ``sf_dir`` and returns a flat DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.catalogue import fixtures as fx
from veilframe.catalogue.xlsx import as_workbook_files
from veilframe.functions.dates import age_years, looks_like_date, parse_date
from veilframe.functions.text import sanitize_name
from veilframe.operators.clean import CleanWorkbook, clean_sheet, clean_workbook, drop_blank_rows
from veilframe.operators.detect import PATTERNS, Detection, detect, first_values
from veilframe.operators.kanon import equivalence_classes, k_histogram, k_report, workbook_k, workbook_reports
from veilframe.operators.ordered import number_rows
from veilframe.operators.preview import preview, preview_meta
from veilframe.operators.registry import Registry
from veilframe.operators.stats import workbook_summary
from veilframe.operators.throttle import throttle_audit
from veilframe.plans.columns import plan_catalog
from veilframe.plans.rules import DEFAULT_RULES, Rule, RuleSet
from veilframe.session import scratch_path, stored_bytes
from veilframe.sinks.outputs import read_runs, sheets_of, write_csv, write_outputs
from veilframe.sinks.retention import expired
from veilframe.sources.screening import screen
from veilframe.sources.sheets import POSITION, Sheet, Workbook, read_csv, read_csv_sheet, read_parquet_sheet
from veilframe.sources.workbook_files import outcomes, to_workbook, workbook_rows
from veilframe.streaming.clean import clean_stream, dedup_stream
from veilframe.streaming.run import run_available
from veilframe.streaming.throttle import throttle_stream

Query = Callable[[SparkSession, str], DataFrame]

KEEP_ALL = RuleSet()
#: Bytes of files that a task reads or writes, where a query deals them out itself.
TASK_BYTES = 1 << 25
CUSTOM_RULES = RuleSet.from_dict(
    {
        "version": "1",
        "rules": [
            {"match": {"equals": " name "}, "action": "rename", "outputName": "Person"},
            {"match": {"regex": "^(contact|addr.*)$"}, "action": "redact", "replaceWith": "***", "outputName": "Hidden"},
            {"match": {"startsWith": "COL"}, "action": "drop"},
            {"match": {"contains": "end"}, "action": "keep", "outputName": "Sex"},
            {"match": {"regex": "^dob$|^nhi$"}, "action": "drop"},
            {"match": {"empty": True}, "action": "drop"},
        ],
    }
)
REDACT_RULES = RuleSet(
    (Rule("equals", "contact", "redact", replace_with="<phone>"), Rule("equals", "name", "redact", replace_with="<name>"))
    + DEFAULT_RULES.rules
)
HEADER_RULES = RuleSet(
    (
        Rule("empty", True, "drop"),
        Rule("empty", False, "drop"),
        Rule("equals", " Small RING ", "rename", output_name="Ring"),
        Rule("startsWith", "RED", "redact", replace_with="<red>"),
        Rule("contains", "bolt", "anonymize", output_name="ID"),
        Rule("regex", "^(blue|green) .*t$", "ageFromDate", output_name="Age"),
        Rule("regex", "WID", "keep", output_name="Wide"),
        Rule("contains", "blue", "drop"),
    )
)


def _people_clean(spark: SparkSession, sf: str, rules: RuleSet = DEFAULT_RULES):
    return clean_sheet(fx.people(spark, sf), rules, as_of=fx.AS_OF)


def _book(spark: SparkSession, sf: str, rules: RuleSet = DEFAULT_RULES, measures: bool = False) -> CleanWorkbook:
    sheets = [fx.people(spark, sf), fx.visits_undated(spark, sf)]
    if measures:
        sheets.append(fx.measures(spark, sf))
    return clean_workbook(Workbook(sheets), rules, as_of=fx.AS_OF)


def _detection(spark: SparkSession, sf: str, sample_size: int | None = 25) -> Detection:
    return detect(detection_workbook(spark, sf), sample_size)


def detection_workbook(spark: SparkSession, sf: str) -> Workbook:
    return Workbook([fx.people(spark, sf), fx.visits(spark, sf), fx.measures(spark, sf), fx.contacts(spark, sf)])


def clean_default(spark: SparkSession, sf: str) -> DataFrame:
    """Default rules on people: drop, anonymize, date to age, dedup."""
    return _people_clean(spark, sf).rows


def clean_default_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _people_clean(spark, sf, REDACT_RULES).stats


def blank_rows(spark: SparkSession, sf: str) -> DataFrame:
    return drop_blank_rows(fx.measures(spark, sf))


def redact(spark: SparkSession, sf: str) -> DataFrame:
    """Contact and name become constants, blanks included."""
    return clean_sheet(fx.people(spark, sf), REDACT_RULES, as_of=fx.AS_OF).positioned.withColumnRenamed(POSITION, "pos")


def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rename, keep under a new name, redact twice under one name (the second renamed apart), drop."""
    rows = _people_clean(spark, sf, CUSTOM_RULES).rows
    return rows.toDF(*[f"{c}{i}" if rows.columns.count(c) > 1 else c for i, c in enumerate(rows.columns)])


def header_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every part name taken as a header of a catalog, planned by eight ordered rules."""
    header = F.when(F.col("p_partkey") % 31 == 0, " \t ").otherwise(F.col("p_name"))
    return plan_catalog(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("place"), header.alias("header")), HEADER_RULES)


def id_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen numbers of the people behind all visits."""
    book = clean_workbook(Workbook([fx.visits(spark, sf)]), as_of=fx.AS_OF)
    return book.mapping.frame.select("key", "id", "uses")


def ages(spark: SparkSession, sf: str) -> DataFrame:
    frame = fx.people(spark, sf).frame
    age = age_years(parse_date(F.col("DOB")), fx.AS_OF)
    return frame.select("pos", age.alias("Age"), (age.isNull() & (F.col("DOB") != "")).alias("invalid"))


def date_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written in eight forms, read back as ages and tested for date shape."""
    frame = fx.derived(spark, sf, fx.DATE_FORMS)
    age = age_years(parse_date(F.col("written")), fx.AS_OF)
    return frame.select("pos", "written", age.alias("Age"), looks_like_date(F.col("written")).alias("date_shape"))


def dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names and brands with first position and size."""
    frame = fx.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    counted = clean_sheet(Sheet("part", frame, "p_partkey"), KEEP_ALL).counted
    return counted.withColumnRenamed(POSITION, "first_pos").withColumnRenamed("_rows", "n")


def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    """One mapping over two sheets: the id of every cleaned row."""
    book = _book(spark, sf)
    parts = [s.positioned.select(F.lit(s.name).alias("sheet"), F.col(POSITION).alias("pos"), "ID") for s in book]
    return parts[0].unionByName(parts[1])


def join_on_id(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned sheets still join: visits per gender. Missing ids take no part."""
    book = _book(spark, sf)
    people, visits = (book[n].rows.where("ID <> ''") for n in ("people", "visits"))
    return people.select("ID", "Gender").join(visits.select("ID"), "ID").groupBy("Gender").agg(F.count(F.lit(1)).alias("visits"))


def _flat(report: DataFrame) -> DataFrame:
    return report.withColumn("quasiIdentifiers", F.array_join("quasiIdentifiers", ","))


def k_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(k_report(fx.table(spark, sf, "customer"), ["c_nationkey", " C_MKTSEGMENT ", "absent"], 5))


def k_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Scored where it belongs: on cleaned, deduplicated rows."""
    return _flat(k_report(_people_clean(spark, sf).scoring_rows, ["Age", "Gender"], 2))


def k_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Equivalence classes of measures, where null and '' are one value."""
    rows = clean_sheet(fx.measures(spark, sf), KEEP_ALL).rows
    return equivalence_classes(rows, ["Kind"])


def k_histogram_orders(spark: SparkSession, sf: str) -> DataFrame:
    return k_histogram(fx.table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority"])


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counters per sheet and their grand total."""
    return workbook_summary(_book(spark, sf, REDACT_RULES, measures=True))


def manifest_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Write a whole run, read its manifest back, one row per sheet."""
    out = scratch_path(spark, "out")
    write_outputs(_book(spark, sf, REDACT_RULES, measures=True), out, "Case Mix.xlsx", run_id="r1")
    return sheets_of(read_runs(spark, out)).drop("generatedAt")


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, write CSV, read it back as text."""
    path = scratch_path(spark, "csv")
    write_csv(_people_clean(spark, sf), path)
    return read_csv(spark, path)


def preview_visits(spark: SparkSession, sf: str) -> DataFrame:
    return preview(clean_sheet(fx.visits(spark, sf), as_of=fx.AS_OF), keep_position=True).withColumnRenamed(POSITION, "pos")


def preview_visits_meta(spark: SparkSession, sf: str) -> DataFrame:
    return preview_meta(clean_sheet(fx.visits(spark, sf), as_of=fx.AS_OF))


def sanitized_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages").select(F.col("url").alias("name"))
    docs = fx.table(spark, sf, "documents").select(F.col("text").alias("name"))
    parts = fx.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 31 == 0, " -- ").otherwise(F.col("p_name")).alias("name"))
    names = pages.unionByName(docs).unionByName(parts)
    return names.groupBy(sanitize_name(F.col("name"), "sheet").alias("safe_name")).agg(F.count(F.lit(1)).alias("n"))


def workbook_k_min(spark: SparkSession, sf: str) -> DataFrame:
    rules = RuleSet(DEFAULT_RULES.rules, ("Gender", "Priority", "nowhere"), 3)
    return _flat(workbook_k(workbook_reports(_book(spark, sf, rules, measures=True), rules), rules.quasi_identifiers, rules.min_k))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """First 25 non-blank values of every column, a sparse one included."""
    sheets = list(detection_workbook(spark, sf))
    names = F.get(F.lit([s.name for s in sheets]), "sheet_idx")
    return first_values(sheets).select(names.alias("sheet"), "col_idx", "rank", "value")


def _rates(detection: Detection) -> DataFrame:
    types = F.array(*[F.lit(p.type) for p in PATTERNS])
    pairs = F.explode(F.arrays_zip(types.alias("type"), F.col("rates").alias("rate"))).alias("pair")
    flat = detection.rates.select("sheet", "header", "sample_size", pairs).select("sheet", "header", "sample_size", "pair.*")
    return flat.where("rate IS NOT NULL").withColumn("rate", F.round("rate", 6))


def match_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rates(_detection(spark, sf))


def match_rates_full(spark: SparkSession, sf: str) -> DataFrame:
    """Value tests over every value instead of the sample."""
    return _rates(_detection(spark, sf, None))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = _detection(spark, sf).candidates
    return found.select("sheet", "header", "rank", "type", "severity", "confidence", "header_hit", F.round("value_rate", 6).alias("value_rate"))


def best_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _detection(spark, sf).report().drop("detections")


def full_report(spark: SparkSession, sf: str) -> DataFrame:
    """The complete report of a scan of all values: a row per column and leading detection, with sample values and suggestion."""
    report = _detection(spark, sf, None).report(include_samples=True)
    flat = report.select("*", F.posexplode_outer("detections").alias("at", "d")).drop("detections")
    return flat.select(
        "sheet_idx", "sheet", "col_idx", "header", "sample_size", F.array_join("sample_values", "|").alias("sample_values"),
        (F.col("at") + 1).alias("rank"), "d.type", "d.severity", "d.confidence", F.col("d.evidence.headerHit").alias("header_hit"),
        F.round("d.evidence.valueRate", 6).alias("value_rate"),
        "best_type", "best_severity", "best_confidence", "action", "output_name", "replace_with",
    )


def _rule_rows(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """A rule set as a table: its rules in order, then the quasi-identifiers and the threshold of its k block."""
    rows = [("rule", r.kind, str(r.target), r.action, r.output_name, r.replace_with) for r in rules.rules]
    rows += [("quasi", None, q, None, None, None) for q in rules.quasi_identifiers]
    rows += [("minK", None, str(rules.min_k), None, None, None)] if rules.min_k is not None else []
    columns = "idx int, part string, match string, target string, action string, output_name string, replace_with string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], columns)


def full_rule_set(spark: SparkSession, sf: str) -> DataFrame:
    """The whole rule set suggested by all values: suggestions, the two closing rules, and the k block."""
    return _rule_rows(spark, _detection(spark, sf, None).rules)


def detect_then_clean_workbook(spark: SparkSession, sf: str) -> DataFrame:
    """Four sheets cleaned by the rules that all their values suggest, one mapping for all: every row as text."""
    book = detection_workbook(spark, sf)
    parts = []
    for sheet in clean_workbook(book, detect(book, None).rules, as_of=fx.AS_OF):
        rows = sheet.positioned.toDF(POSITION, *[f"o{i}" for i in range(len(sheet.columns))])
        cells = [F.col(c).cast("decimal(18,4)") if t == "double" else F.col(c) for c, t in rows.dtypes[1:]]
        text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
        parts.append(rows.select(F.lit(sheet.name).alias("sheet"), F.col(POSITION).alias("pos"), F.lit("|".join(sheet.columns)).alias("headers"), text.alias("row")))
    return reduce(DataFrame.unionByName, parts)


def suggested_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The suggested rules and the quasi-identifiers, each with the place that decides its order."""
    rules = _detection(spark, sf)
    found = rules.suggested.select("place", F.lit("equals").alias("match"), F.col("header").alias("target"), "action", "output_name", "replace_with")
    quasi = rules.quasi_headers.select("place", F.lit("quasi").alias("match"), F.col("header").alias("target"))
    return found.unionByName(quasi, allowMissingColumns=True)


def detection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _detection(spark, sf).summary


def expired_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a listing of outputs: which are older than 72 hours?"""
    listing = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("modificationTime"))
    return expired(listing, F.lit("1998-10-06").cast("timestamp_ntz"), 72)


def screened_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a listing of uploads, with the page size as file size."""
    suffix = F.get(F.array(*[F.lit(s) for s in (".xlsx", ".XLS", ".ods", ".csv", "")]), (F.col("page_id") % 5).cast("int"))
    listing = fx.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("in/"), "page_id", suffix).alias("path"), F.length("html").cast("long").alias("length")
    )
    return screen(listing, max_bytes=6000)


def workbook_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers packed into .xlsx files, parsed, put together again and cleaned."""
    people = fx.people(spark, sf)
    files = as_workbook_files(people.frame, "people", "pos")
    book = clean_workbook(to_workbook(workbook_rows(files)), as_of=fx.AS_OF)
    return book["people"].rows


def detect_then_clean(spark: SparkSession, sf: str) -> DataFrame:
    sheet = fx.people(spark, sf)
    return clean_sheet(sheet, detect(sheet).rules, as_of=fx.AS_OF).rows


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


STREAM_RULES = RuleSet(
    (
        Rule("equals", "props", "redact", replace_with="<props>"),
        Rule("equals", "user", "anonymize", output_name="ID"),
        Rule("equals", "value", "drop"),
        Rule("contains", "born", "ageFromDate", output_name="Age"),
    )
)


def _stream_columns(events: DataFrame) -> DataFrame:
    user = F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string")))
    born = F.concat((F.lit(1940) + F.col("user_id") % 60).cast("string"), F.lit("-07-01"))
    return events.select("event_id", user.alias("User"), born.alias("Born"), "event_type", "value", "props")


def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Events cleaned as a stream, ids from a mapping that batch built beforehand."""
    batch = _stream_columns(fx.table(spark, sf, "events"))
    mapping = clean_sheet(Sheet("events", batch, "event_id"), STREAM_RULES, as_of=fx.AS_OF).mapping
    return run_available(clean_stream(_stream_columns(_event_stream(spark, sf)), STREAM_RULES, mapping, as_of=fx.AS_OF), "clean-stream")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (type, user) pairs; the delay exceeds the span of the data, so none can pass twice."""
    stream = _event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    return run_available(dedup_stream(stream, "ts", "60 days").select("event_type", "user_id"), "dedup-stream")


AUDIT = {"key": "user_id", "ts": "ts", "hit_id": "event_id", "window_seconds": 86_400, "max_hits": 3}


def throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Three events per user and day, days anchored at the first event."""
    return throttle_audit(fx.table(spark, sf, "events"), **AUDIT)


def stream_throttle(spark: SparkSession, sf: str) -> DataFrame:
    hits = throttle_stream(_event_stream(spark, sf), **AUDIT)
    return run_available(hits, "throttle-stream").select("user_id", "event_id", "hit_count", "over_limit")


REGISTRY_RULES = RuleSet(
    (Rule("equals", "nhi", "anonymize", output_name="ID"), Rule("equals", "gender", "keep"), Rule("regex", ".*", "drop"))
)


def _registry_clean(spark: SparkSession, sf: str):
    """People under a caller's registry that lacks a third of the keys and gives pairs of others one id."""
    registry = fx.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_name").alias("key"), F.concat(F.lit("R"), F.expr("c_custkey DIV 2").cast("string")).alias("id")
    )
    return clean_sheet(fx.people(spark, sf), REGISTRY_RULES, registry, as_of=fx.AS_OF)


def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that only their ids make equal are one row."""
    return _registry_clean(spark, sf).counted.withColumnsRenamed({POSITION: "pos", "_rows": "n_rows"})


def registry_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _registry_clean(spark, sf).stats


def _grown(spark: SparkSession, sf: str) -> tuple[Registry, CleanWorkbook]:
    """Two runs over one registry: all visits, then all people, most of whom the first run has met."""
    registry = Registry(spark, scratch_path(spark, "registry"))
    clean_workbook(Workbook([fx.visits_undated(spark, sf)]), mapping=registry, as_of=fx.AS_OF).commit_ids()
    second = clean_workbook(Workbook([fx.people(spark, sf)]), mapping=registry, as_of=fx.AS_OF)
    second.commit_ids()
    return registry, second


def registry_growth(spark: SparkSession, sf: str) -> DataFrame:
    """The registry after both runs: old numbers stay, new people follow them."""
    return _grown(spark, sf)[0].read()


def registry_growth_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The second run's rows."""
    return _grown(spark, sf)[1]["people"].positioned.withColumnRenamed(POSITION, "pos")


def parquet_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Visits in several files without a column that orders them: the derived position of every row."""
    path = scratch_path(spark, "files")
    fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return read_parquet_sheet(spark, "orders", path).frame.withColumnRenamed(POSITION, "pos")


def csv_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as several CSV files full of quoted line breaks, read in splits of 64 KiB: the rows in order of their position."""
    path = scratch_path(spark, "csv")
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    files = max(3, stored_bytes(spark, f"{sf}/documents.parquet") // TASK_BYTES)
    docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    # A session of its own, as the size of splits is a session's setting.
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    # A task for every few splits: their number grows with the input, a task's start costs more than a split.
    tasks = max(4 * spark.sparkContext.defaultParallelism, stored_bytes(spark, path) // TASK_BYTES)
    own.conf.set("spark.sql.files.maxPartitionNum", str(tasks))
    sheet = read_csv_sheet(own, "documents", path)
    return number_rows(sheet.frame, [POSITION], "numbered", "n").drop(POSITION)


def _keyless(events: DataFrame) -> DataFrame:
    return events.withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))


def throttle_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Hits without a key share one."""
    return throttle_audit(_keyless(fx.table(spark, sf, "events")), **AUDIT)


def throttle_large_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The same audit with every key taken as too large for one group."""
    return throttle_audit(_keyless(fx.table(spark, sf, "events")), **AUDIT, walk_limit=0)


def stream_throttle_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    hits = throttle_stream(_keyless(_event_stream(spark, sf)), **AUDIT)
    return run_available(hits, "throttle-stream").select("user_id", "event_id", "hit_count", "over_limit")


def ingest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers packed into files, some upper-case, of another type, oversized or cut short: how each ends."""
    people = fx.people(spark, sf)
    files = as_workbook_files(people.frame, "people", "pos", rows_per_file=10)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 5
    suffix = F.get(F.array(*[F.lit(x) for x in (".xlsx", ".XLSX", ".xls", ".xlsx", ".Xlsx")]), number.cast("int"))
    named = files.withColumns({"path": F.concat(F.regexp_extract("path", "^([^.]*)", 1), suffix), "cut": number == 3, "padded": number == 4})
    content = F.when(F.col("cut"), F.expr("substring(content, 1, 100)")).otherwise(F.col("content"))
    files = named.withColumn("content", content).withColumn("length", F.when(F.col("padded"), 10**9).otherwise(F.octet_length("content")))
    cap = 10**8
    rows = workbook_rows(files.where(F.lower("path").endswith(".xlsx") & (F.col("length") <= cap)))
    found = outcomes(files, rows, max_bytes=cap)
    return found.withColumn("reason", F.when(F.col("outcome") != "failed", F.col("reason")))


QUERIES: dict[str, Query] = {
    "q01_clean_default": clean_default,
    "q02_blank_rows": blank_rows,
    "q03_redact": redact,
    "q04_custom_rules": custom_rules,
    "q05_header_rules": header_rules,
    "q06_id_mapping": id_mapping,
    "q07_ages": ages,
    "q07_date_forms": date_forms,
    "q08_dedup": dedup,
    "q09_shared_ids": shared_ids,
    "q10_join_on_id": join_on_id,
    "q11_stats": clean_default_stats,
    "q12_k_report": k_customer,
    "q12_k_cleaned": k_cleaned,
    "q12_k_classes": k_classes,
    "q12_k_histogram": k_histogram_orders,
    "q13_summary": summary,
    "q13_manifest": manifest_sheets,
    "q13_csv_round_trip": csv_round_trip,
    "q14_preview": preview_visits,
    "q14_preview_meta": preview_visits_meta,
    "q15_sanitized_names": sanitized_names,
    "q16_workbook_k": workbook_k_min,
    "q17_samples": samples,
    "q18_match_rates": match_rates,
    "q18_match_rates_full": match_rates_full,
    "q19_candidates": candidates,
    "q20_best_candidates": best_candidates,
    "q20_full_report": full_report,
    "q21_suggested_rules": suggested_rules,
    "q21_full_rule_set": full_rule_set,
    "q21_detection_summary": detection_summary,
    "q22_expired_runs": expired_runs,
    "q22_screened_inputs": screened_inputs,
    "q23_detect_then_clean": detect_then_clean,
    "q23_detect_then_clean_workbook": detect_then_clean_workbook,
    "q23_workbook_files": workbook_files,
    "q24_stream_clean": stream_clean,
    "q25_stream_dedup": stream_dedup,
    "q26_throttle": throttle,
    "q26_stream_throttle": stream_throttle,
    "q26_throttle_null_keys": throttle_null_keys,
    "q26_throttle_large_keys": throttle_large_keys,
    "q26_stream_null_keys": stream_throttle_null_keys,
    "q27_registry_rows": registry_rows,
    "q27_registry_stats": registry_stats,
    "q28_ingest_outcomes": ingest_outcomes,
    "q29_registry_growth": registry_growth,
    "q29_registry_growth_rows": registry_growth_rows,
    "q30_parquet_positions": parquet_positions,
    "q30_csv_positions": csv_positions,
}

__all__ = ["QUERIES"]

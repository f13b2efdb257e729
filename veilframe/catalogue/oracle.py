"""The same queries in SQL for DuckDB, written independently of the DataFrame code."""

from __future__ import annotations

from veilframe.catalogue import fixtures as fx

AS_OF = "DATE '2024-06-30'"
SHEETS = f"people AS ({fx.PEOPLE}), visits AS ({fx.VISITS}), measures AS ({fx.MEASURES})"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def _age(date: str) -> str:
    years = f"(2024 - year({date}) - CASE WHEN month({date}) * 100 + day({date}) > 630 THEN 1 ELSE 0 END)"
    return f"CASE WHEN {years} BETWEEN 0 AND 129 THEN CAST({years} AS INTEGER) END"


def _key(column: str) -> str:
    return f"nullif(trim({column}, ' ' || chr(9)), '')"


BORN = 'try_cast("DOB" AS DATE)'

# Cleaned people and visits under the default rules, ids still as keys, with first positions.
PEOPLE_KEYED = f"""
people_keyed AS (
  SELECT min(pos) AS pos, count(*) AS n, "Name", {_key('"NHI"')} AS k, {_age(BORN)} AS "Age", "Postcode", "Gender", "Balance"
  FROM people GROUP BY ALL)
"""
VISITS_KEYED = f"""
visits_keyed AS (
  SELECT min(pos) AS pos, count(*) AS n, {_key('"NHI"')} AS k, "Status", "Priority" FROM visits GROUP BY ALL)
"""


def _mapping(name: str, *sheets: str) -> str:
    """First-seen ids over sheets in the given order."""
    rows = " UNION ALL ".join(f'SELECT {i} AS s, pos, {_key(chr(34) + "NHI" + chr(34))} AS k FROM {sheet}' for i, sheet in enumerate(sheets))
    return f"""
{name} AS (
  SELECT k, printf('ID-%03d', row_number() OVER (ORDER BY min((s, pos)))) AS id, count(*) AS uses
  FROM ({rows}) WHERE k IS NOT NULL GROUP BY k)
"""


PEOPLE_ALONE = _mapping("ids", "people")
BOTH = _mapping("ids", "people", "visits")

Q: dict[str, str] = {}

Q["q01_clean_default"] = (
    with_(SHEETS, PEOPLE_KEYED, PEOPLE_ALONE)
    + """
SELECT "Name", coalesce(id, '') AS "ID", "Age", "Postcode", "Gender", "Balance" FROM people_keyed LEFT JOIN ids USING (k)
"""
)

Q["q02_blank_rows"] = with_(SHEETS) + """
SELECT pos, "Kind", "Score", "Notes" FROM measures
WHERE NOT (("Kind" IS NULL OR "Kind" = '') AND "Score" IS NULL AND ("Notes" IS NULL OR "Notes" = ''))
"""

Q["q03_redact"] = with_(SHEETS, PEOPLE_ALONE, f"""
r AS (SELECT min(pos) AS pos, {_key('"NHI"')} AS k, {_age(BORN)} AS "Age", "Postcode", "Gender", "Balance" FROM people GROUP BY ALL)""") + """
SELECT pos, '<name>' AS "Name", coalesce(id, '') AS "ID", "Age", '<phone>' AS "Contact", "Postcode", "Gender", "Balance"
FROM r LEFT JOIN ids USING (k)
"""

Q["q04_custom_rules"] = with_(SHEETS) + """
SELECT DISTINCT "Name" AS "Person", '***' AS "Hidden1", '***' AS "Hidden2", "Postcode", "Gender" AS "Sex", "Balance" FROM people
"""

Q["q05_header_rules"] = """
WITH c AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 31 = 0 THEN concat(' ', chr(9), ' ') ELSE p_name END AS header FROM part),
h AS (SELECT *, lower(trim(header, ' ' || chr(9))) AS n FROM c),
r AS (SELECT place, header, CAST(CASE
        WHEN n = '' THEN 0 WHEN n = 'small ring' THEN 2 WHEN n LIKE 'red%' THEN 3 WHEN n LIKE '%bolt%' THEN 4
        WHEN regexp_matches(n, '^(blue|green) .*t$') THEN 5 WHEN n LIKE '%wid%' THEN 6 WHEN n LIKE '%blue%' THEN 7 END AS INTEGER) AS rule_idx FROM h)
SELECT place, header, rule_idx,
  CASE rule_idx WHEN 0 THEN 'drop' WHEN 2 THEN 'rename' WHEN 3 THEN 'redact' WHEN 4 THEN 'anonymize' WHEN 5 THEN 'ageFromDate'
                WHEN 6 THEN 'keep' WHEN 7 THEN 'drop' ELSE 'keep' END AS action,
  CASE WHEN rule_idx IN (0, 7) THEN NULL WHEN rule_idx = 2 THEN 'Ring' WHEN rule_idx = 4 THEN 'ID' WHEN rule_idx = 5 THEN 'Age'
       WHEN rule_idx = 6 THEN 'Wide' ELSE header END AS output_name,
  CASE WHEN rule_idx = 3 THEN '<red>' END AS replace_with
FROM r
"""

Q["q06_id_mapping"] = with_(SHEETS, _mapping("ids", "visits")) + "SELECT k AS key, id, uses FROM ids"

Q["q07_ages"] = with_(SHEETS) + f"""
SELECT pos, {_age(BORN)} AS "Age", ({_age(BORN)}) IS NULL AND "DOB" <> '' AS invalid FROM people
"""

Q["q07_date_forms"] = with_(f"f AS ({fx.DATE_FORMS})") + f"""
SELECT pos, "written", CASE WHEN pos % 10 < 8 THEN {_age('"original"')} END AS "Age", pos % 10 <> 7 AS date_shape FROM f
"""

Q["q08_dedup"] = "SELECT min(p_partkey) AS first_pos, count(*) AS n, p_name, p_brand FROM part GROUP BY p_name, p_brand"

Q["q09_shared_ids"] = with_(SHEETS, PEOPLE_KEYED, VISITS_KEYED, BOTH) + """
SELECT 'people' AS sheet, pos, coalesce(id, '') AS "ID" FROM people_keyed LEFT JOIN ids USING (k)
UNION ALL SELECT 'visits', pos, coalesce(id, '') FROM visits_keyed LEFT JOIN ids USING (k)
"""

Q["q10_join_on_id"] = with_(SHEETS, PEOPLE_KEYED, VISITS_KEYED) + """
SELECT "Gender", count(*) AS visits FROM people_keyed JOIN visits_keyed USING (k) GROUP BY "Gender"
"""

# Counters per sheet under the redacting rules: (processed, distinct, invalid, missing, redacted).
COUNTS = f"""
counts AS (
  SELECT 0 AS sheet_idx, 'people' AS sheet, count(*) AS p,
         (SELECT count(*) FROM (SELECT DISTINCT {_key('"NHI"')}, {_age(BORN)}, "Postcode", "Gender", "Balance" FROM people)) AS d,
         count(*) FILTER (({_age(BORN)}) IS NULL AND "DOB" <> '') AS i,
         count(*) FILTER ({_key('"NHI"')} IS NULL) AS m,
         count(*) FILTER ("Contact" <> '') + count(*) FILTER ("Name" <> '') AS r FROM people
  UNION ALL
  SELECT 1, 'visits', count(*), (SELECT count(*) FROM (SELECT DISTINCT "NHI", "Status", "Priority" FROM visits)), 0, 0,
         count(*) FILTER ("Contact" <> '') FROM visits
  UNION ALL
  SELECT 2, 'measures', count(*), (SELECT count(*) FROM (SELECT DISTINCT "Kind", "Score", "Notes" FROM measures
         WHERE NOT (coalesce("Kind", '') = '' AND "Score" IS NULL AND coalesce("Notes", '') = ''))), 0, 0, 0
  FROM measures WHERE NOT (coalesce("Kind", '') = '' AND "Score" IS NULL AND coalesce("Notes", '') = ''))
"""
COUNTERS = """CAST({0}p) AS BIGINT) AS "rowsProcessed", CAST({0}p) - {0}d) AS BIGINT) AS "duplicatesRemoved",
 CAST({0}i) AS BIGINT) AS "invalidDobCount", CAST({0}m) AS BIGINT) AS "missingNhiCount", CAST({0}r) AS BIGINT) AS "redactedCellCount" """

Q["q11_stats"] = with_(SHEETS, COUNTS) + f"SELECT {COUNTERS.format('(')} FROM counts WHERE sheet = 'people'"

Q["q13_summary"] = with_(SHEETS, COUNTS) + f"""
SELECT CAST(sheet_idx AS INTEGER) AS sheet_idx, sheet, CAST(1 AS BIGINT) AS "sheetsProcessed", {COUNTERS.format('(')} FROM counts
UNION ALL SELECT NULL, NULL, count(*), {COUNTERS.format('sum(')} FROM counts
"""

Q["q13_manifest"] = with_(SHEETS, COUNTS) + f"""
SELECT 'r1' AS run, sheet AS "sheetName", concat('sheet=', sheet_idx, '-', sheet) AS "fileName", {COUNTERS.format('(')} FROM counts
"""

Q["q13_csv_round_trip"] = with_(SHEETS, PEOPLE_KEYED, PEOPLE_ALONE) + """
SELECT "Name", id AS "ID", CAST("Age" AS VARCHAR) AS "Age", "Postcode", "Gender",
  CASE WHEN "Balance" = floor("Balance") THEN CAST(CAST("Balance" AS BIGINT) AS VARCHAR) ELSE CAST("Balance" AS VARCHAR) END AS "Balance"
FROM people_keyed LEFT JOIN ids USING (k)
"""


def _k(rows: str, tuple_: str, names: str, min_k: int) -> str:
    return f"""
SELECT true AS applicable, CAST(NULL AS VARCHAR) AS reason, min(n) AS k, CAST(sum(n) AS BIGINT) AS "totalRows", count(*) AS "uniqueGroups",
       count(*) FILTER (n = 1) AS "singletonRows", '{names}' AS "quasiIdentifiers", CAST({min_k} AS BIGINT) AS "minK",
       min(n) >= {min_k} AS "satisfiesMinK"
FROM (SELECT count(*) AS n FROM {rows} GROUP BY {tuple_})
"""


Q["q12_k_report"] = _k("customer", "c_nationkey, c_mktsegment", "c_nationkey,c_mktsegment", 5)
Q["q12_k_cleaned"] = with_(SHEETS, PEOPLE_KEYED) + _k("people_keyed", '"Age", "Gender"', "Age,Gender", 2)
Q["q12_k_classes"] = with_(SHEETS) + """
SELECT "Kind", count(*) AS n FROM (SELECT DISTINCT coalesce("Kind", '') AS "Kind", "Kind" IS NULL, "Score", "Notes" FROM measures
 WHERE NOT (coalesce("Kind", '') = '' AND "Score" IS NULL AND coalesce("Notes", '') = '')) GROUP BY "Kind"
"""
Q["q12_k_histogram"] = """
SELECT k, count(*) AS "groupCount" FROM (SELECT count(*) AS k FROM orders GROUP BY o_orderdate, o_orderpriority) GROUP BY k
"""

Q["q14_preview"] = with_(SHEETS, _mapping("ids", "visits"), f"""
v AS (SELECT min(pos) AS pos, {_key('"NHI"')} AS k, "AdmissionDate", "Status", "Priority" FROM visits GROUP BY ALL)""") + """
SELECT pos, coalesce(id, '') AS "ID", "AdmissionDate", "Status", "Priority" FROM v LEFT JOIN ids USING (k) ORDER BY pos LIMIT 24
"""
Q["q14_preview_meta"] = with_(SHEETS) + """
SELECT count(*) AS "totalDataRows", least(count(*), 24) AS "previewedDataRows", least(count(*), 24) < count(*) AS truncated
FROM (SELECT DISTINCT "NHI", "AdmissionDate", "Status", "Priority" FROM visits)
"""

Q["q15_sanitized_names"] = """
WITH names AS (SELECT url AS name FROM pages UNION ALL SELECT text FROM documents
               UNION ALL SELECT CASE WHEN p_partkey % 31 = 0 THEN ' -- ' ELSE p_name END FROM part),
s AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '_', 'g') AS x FROM names),
t AS (SELECT regexp_replace(regexp_replace(x, '^_+|_+$', '', 'g'), '_+', '_', 'g') AS x FROM s)
SELECT CASE WHEN x = '' THEN 'sheet' ELSE x END AS safe_name, count(*) AS n FROM t GROUP BY 1
"""

Q["q16_workbook_k"] = with_(SHEETS, PEOPLE_KEYED, VISITS_KEYED) + """
SELECT true AS applicable, min(n) AS k, CAST(3 AS BIGINT) AS "minK", min(n) >= 3 AS "satisfiesMinK", 'Gender,Priority,nowhere' AS "quasiIdentifiers"
FROM (SELECT count(*) AS n FROM people_keyed GROUP BY "Gender" UNION ALL SELECT count(*) FROM visits_keyed GROUP BY "Priority")
"""

# Detection. Columns of the four sheets with the kind of their values.
T, N = "text", "number"
COLUMNS = {
    "people": [("Name", T), ("NHI", T), ("DOB", T), ("Contact", T), ("Address", T), ("Postcode", T), ("Gender", T), ("Column 4", T), ("Balance", N)],
    "visits": [("NHI", T), ("AdmissionDate", T), ("Status", T), ("Priority", T), ("Contact", T)],
    "measures": [("Kind", T), ("Score", N), ("Notes", T)],
    "contacts": [
        ("Email", T), ("Member", T), ("card_number", T), ("Mobile", T), ("Ref", T), ("Patient_ID", T), ("Host", T), ("Birth Date", T),
        ("Street", T), ("Zip", N), ("Age", T), ("Sex", T), ("Due", T), ("rating", N), ("Shipment", T), ("Rare", T),
    ],
}

_CELLS = " UNION ALL ".join(
    f"""SELECT {s} AS sheet_idx, '{sheet}' AS sheet, {i} AS col_idx, '{name}' AS header, '{kind}' AS kind, pos, """
    + (
        f'''CASE WHEN "{name}" = floor("{name}") THEN CAST(CAST("{name}" AS BIGINT) AS VARCHAR) ELSE CAST("{name}" AS VARCHAR) END'''
        if kind == N
        else f'"{name}"'
    )
    + f" AS value FROM {sheet}"
    for s, (sheet, columns) in enumerate(COLUMNS.items())
    for i, (name, kind) in enumerate(columns)
)
_CATALOG = ", ".join(
    f"({s}, '{sheet}', {i}, '{name}')" for s, (sheet, columns) in enumerate(COLUMNS.items()) for i, (name, _) in enumerate(columns)
)
DETECT = f"""contacts AS ({fx.CONTACTS}),
cells AS ({_CELLS}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet_idx, col_idx ORDER BY pos) AS INTEGER) AS rank FROM cells WHERE value <> ''),
catalog AS (SELECT * FROM (VALUES {_CATALOG}) AS t(sheet_idx, sheet, col_idx, header))"""

_GENERAL = "regexp_matches(value, '^(19|20)\\d\\d\\z') AND value NOT IN ('1900')"
_DATE = f"""CASE WHEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(left(value, 4) AS INTEGER) BETWEEN 1901 AND 2099
 WHEN regexp_matches(value, '^(?:\\d{{1,2}}[/-]){{2}}\\d{{2,4}}\\z')
   THEN length(regexp_extract(value, '\\d+\\z')) <> 4 OR CAST(regexp_extract(value, '\\d+\\z') AS INTEGER) BETWEEN 1901 AND 2099
 ELSE {_GENERAL} END"""
_TEXT = "kind = 'text' AND regexp_matches(value, '{}')"
_NUMBER = "try_cast(CASE WHEN trim(value) = '' THEN '0' ELSE trim(value) END AS DOUBLE)"

# idx, type, severity, hints, value test, gate, suggestion
PATTERNS = [
    ("email", "direct", ["email", "e-mail", "mail"], _TEXT.format(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"), "", ("redact", None, "<email>")),
    ("ssn", "direct", ["ssn", "social security", "social_security", "tin"], _TEXT.format(r"^\d{3}-?\d{2}-?\d{4}\z"), "", ("redact", None, "<ssn>")),
    ("creditcard", "direct", ["credit_card", "creditcard", "card_number", "cardnumber", "cc_number"], _TEXT.format(r"^(?:\d[ -]?){13,19}\z"), "header", ("redact", None, "<cc>")),
    ("phone", "direct", ["phone", "mobile", "cell", "tel", "telephone", "contact"], _TEXT.format(r"^[+]?[\d][\d\s\-().]{6,}\z"), "header", ("redact", None, "<phone>")),
    ("nhi", "direct", ["nhi", "national health"], _TEXT.format(r"^[A-Za-z]{3}\d{4}\z"), "", ("anonymize", "ID", None)),
    ("mrn", "direct", ["mrn", "medical record", "patient_id", "patientid", "patient id", "patient code", "patient_code"], _TEXT.format(r"(?i)^[A-Z0-9-]{4,20}\z") + r" AND regexp_matches(value, '\d')", "header", ("anonymize", "PatientID", None)),
    ("ip", "direct", ["ip", "ip_address", "ipaddress", "client_ip"], _TEXT.format(r"^(?:\d{1,3}\.){3}\d{1,3}\z"), "", ("redact", None, "<ip>")),
    ("dob", "direct", ["dob", "date of birth", "birth_date", "birthdate", "birth date"], _DATE, "header", ("ageFromDate", "Age", None)),
    ("name", "direct", ["name", "full name", "first name", "firstname", "last name", "lastname", "surname", "given name", "family name", "middle name"], None, "only", ("redact", None, "<name>")),
    ("address", "direct", ["address", "street", "addr", "home_address", "mailing_address"], None, "only", ("drop", None, None)),
    ("postcode", "quasi", ["postcode", "postal_code", "postal code", "zip", "zipcode", "zip_code"], _TEXT.format(r"(?i)^[A-Z0-9][A-Z0-9 -]{2,9}\z"), "header", None),
    ("age", "quasi", ["age"], f"coalesce({_NUMBER} BETWEEN 0 AND 130 AND {_NUMBER} = floor({_NUMBER}), false)", "header", None),
    ("gender", "quasi", ["gender", "sex"], "kind = 'text' AND lower(trim(value)) IN ('m', 'f', 'male', 'female', 'x', 'other', 'nonbinary', 'non-binary', 'nb', 'unknown', 'prefer not to say')", "header", None),
    ("date", "quasi", [], _DATE, "", None),
]


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _rates(source: str) -> str:
    hits = ", ".join(f"avg(CASE WHEN {p[3]} THEN 1e0 ELSE 0e0 END) AS r{i}" for i, p in enumerate(PATTERNS) if p[3])
    return f"""counted AS (SELECT sheet_idx, col_idx, count(*) AS n, {hits} FROM {source} GROUP BY ALL),
wide AS (SELECT c.sheet_idx, c.sheet, c.col_idx, c.header, coalesce(n, 0) AS sample_size, counted.* EXCLUDE (sheet_idx, col_idx, n)
         FROM catalog c LEFT JOIN counted USING (sheet_idx, col_idx)),
rates AS (""" + " UNION ALL ".join(
        f"""SELECT sheet_idx, sheet, col_idx, header, sample_size, {i} AS idx, '{p[0]}' AS type, '{p[1]}' AS severity, '{p[4]}' AS gate,
 ({' OR '.join(f"contains(lower(header), '{h}')" for h in p[2]) or 'false'}) AS hit, {f'coalesce(r{i}, 0e0)' if p[3] else 'CAST(NULL AS DOUBLE)'} AS rate,
 {_text(p[5] and p[5][0])} AS action, {_text(p[5] and p[5][1])} AS output_name, {_text(p[5] and p[5][2])} AS replace_with FROM wide"""
        for i, p in enumerate(PATTERNS)
    ) + ")"


SAMPLED = "sampled AS (SELECT * FROM ranked WHERE rank <= 25)"
SCORED = """
raw AS (SELECT *, CASE WHEN gate = 'only' THEN CASE WHEN hit THEN 92e-2 END WHEN gate = 'header' AND NOT hit THEN NULL
   WHEN hit AND rate >= 5e-1 THEN 95e-2 + least(4e-2, rate - 5e-1) WHEN rate >= 9e-1 THEN 9e-1
   WHEN hit THEN 6e-1 + CASE WHEN rate >= 25e-2 THEN 1e-1 ELSE 0e0 END
   WHEN rate >= 5e-1 THEN 65e-2 + least(1e-1, rate - 5e-1) END AS c FROM rates),
scored AS (SELECT * REPLACE (least(99e-2, c * CASE WHEN type = 'date' THEN 85e-2 ELSE 1e0 END) AS c) FROM raw WHERE c IS NOT NULL),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet_idx, col_idx ORDER BY c DESC, idx) AS INTEGER) AS rank,
   round(CAST(c AS DECIMAL(38, 20)), 2)::DOUBLE AS confidence FROM scored)
"""
SAMPLE_PARTS = (SHEETS, DETECT, SAMPLED, _rates("sampled"))

Q["q17_samples"] = with_(SHEETS, DETECT, SAMPLED) + "SELECT sheet, CAST(col_idx AS INTEGER) AS col_idx, rank, value FROM sampled"
_RATE_ROWS = "SELECT sheet, header, sample_size, type, round(rate, 6) AS rate FROM rates WHERE rate IS NOT NULL"
Q["q18_match_rates"] = with_(*SAMPLE_PARTS) + _RATE_ROWS
Q["q18_match_rates_full"] = with_(SHEETS, DETECT, _rates("ranked")) + _RATE_ROWS
Q["q19_candidates"] = with_(*SAMPLE_PARTS, SCORED) + """
SELECT sheet, header, rank, type, severity, confidence, hit AS header_hit, round(rate, 6) AS value_rate FROM ordered
"""
Q["q20_best_candidates"] = with_(*SAMPLE_PARTS, SCORED) + """
SELECT CAST(c.sheet_idx AS INTEGER) AS sheet_idx, c.sheet, CAST(c.col_idx AS INTEGER) AS col_idx, c.header, w.sample_size,
  o.type AS best_type, o.severity AS best_severity, o.confidence AS best_confidence, o.action, o.output_name, o.replace_with
FROM catalog c JOIN wide w USING (sheet_idx, col_idx) LEFT JOIN (SELECT * FROM ordered WHERE rank = 1) o USING (sheet_idx, col_idx)
"""
FIRST = """
best AS (SELECT *, CAST(sheet_idx AS BIGINT) * 4294967296 + col_idx AS place FROM ordered WHERE rank = 1),
rules AS (SELECT * FROM best WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(header) ORDER BY place) = 1),
quasi AS (SELECT * FROM best WHERE severity = 'quasi' QUALIFY row_number() OVER (PARTITION BY lower(header) ORDER BY place) = 1)
"""
Q["q21_suggested_rules"] = with_(*SAMPLE_PARTS, SCORED, FIRST) + """
SELECT place, 'equals' AS match, header AS target, action, output_name, replace_with FROM rules
UNION ALL SELECT place, 'quasi', header, NULL, NULL, NULL FROM quasi
"""
Q["q21_detection_summary"] = with_(*SAMPLE_PARTS, SCORED) + """
SELECT count(*) FILTER (severity = 'direct') AS "directIdentifiers", count(*) FILTER (severity = 'quasi') AS "quasiIdentifiers"
FROM ordered WHERE rank = 1
"""

Q["q22_expired_runs"] = """
SELECT o_orderkey, o_orderdate AS "modificationTime" FROM orders
WHERE epoch_ms(TIMESTAMP '1998-10-06') - epoch_ms(o_orderdate) > 72 * 3600000
"""
Q["q22_screened_inputs"] = """
WITH l AS (SELECT page_id, concat('in/', page_id, CASE page_id % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLS' WHEN 2 THEN '.ods' WHEN 3 THEN '.csv' ELSE '' END) AS path,
                  length(html) AS length FROM pages),
r AS (SELECT *, CASE WHEN page_id % 5 > 2 THEN 'unsupported file type' WHEN length > 6000 THEN 'file too large' END AS reason FROM l)
SELECT *, reason IS NULL AS accepted FROM r
"""

FULL_PARTS = (SHEETS, DETECT, _rates("ranked"), SCORED)
Q["q20_full_report"] = with_(*FULL_PARTS) + """
SELECT CAST(c.sheet_idx AS INTEGER) AS sheet_idx, c.sheet, CAST(c.col_idx AS INTEGER) AS col_idx, c.header, w.sample_size,
  coalesce(s.sample_values, '') AS sample_values, o.rank, o.type, o.severity, o.confidence, o.hit AS header_hit, round(o.rate, 6) AS value_rate,
  b.type AS best_type, b.severity AS best_severity, b.confidence AS best_confidence, b.action, b.output_name, b.replace_with
FROM catalog c JOIN wide w USING (sheet_idx, col_idx) LEFT JOIN (SELECT * FROM ordered WHERE rank <= 3) o USING (sheet_idx, col_idx)
LEFT JOIN (SELECT * FROM ordered WHERE rank = 1) b USING (sheet_idx, col_idx)
LEFT JOIN (SELECT sheet_idx, col_idx, string_agg(value, '|' ORDER BY rank) AS sample_values FROM ranked WHERE rank <= 3 GROUP BY ALL) s USING (sheet_idx, col_idx)
"""
Q["q21_full_rule_set"] = with_(*FULL_PARTS, FIRST) + """
, listed AS (SELECT 0 AS block, place, 'rule' AS part, 'equals' AS match, header AS target, action, output_name, replace_with FROM rules
  UNION ALL SELECT 1, 0, 'rule', 'empty', 'True', 'drop', NULL, NULL UNION ALL SELECT 2, 0, 'rule', 'startsWith', 'column', 'drop', NULL, NULL
  UNION ALL SELECT 3, place, 'quasi', NULL, header, NULL, NULL, NULL FROM quasi
  UNION ALL SELECT 4, 0, 'minK', NULL, '5', NULL, NULL, NULL WHERE EXISTS (FROM quasi))
SELECT CAST(row_number() OVER (ORDER BY block, place) - 1 AS INTEGER) AS idx, part, match, target, action, output_name, replace_with FROM listed
"""


def _cell(value: str) -> str:
    return f"coalesce(CAST({value} AS VARCHAR), '')"


def _row(*cells: str) -> str:
    return "concat_ws('|', " + ", ".join(map(_cell, cells)) + ")"


# What the suggested rules make of each sheet. NHI, Ref and Patient_ID share one mapping.
_MONEY = 'CAST({} AS DECIMAL(18, 4))'
Q["q23_detect_then_clean_workbook"] = with_(SHEETS, f"contacts AS ({fx.CONTACTS})", f"""
keys AS (SELECT 0 AS s, pos, 1 AS c, {_key('"NHI"')} AS k FROM people UNION ALL SELECT 1, pos, 0, {_key('"NHI"')} FROM visits
         UNION ALL SELECT 3, pos, 4, {_key('"Ref"')} FROM contacts UNION ALL SELECT 3, pos, 5, {_key('"Patient_ID"')} FROM contacts),
ids AS (SELECT k, printf('ID-%03d', row_number() OVER (ORDER BY min((s, pos, c)))) AS id FROM keys WHERE k IS NOT NULL GROUP BY k),
out AS (
  SELECT 'people' AS sheet, 'Name|ID|Age|Contact|Postcode|Gender|Balance' AS headers, pos,
    {_row("'<name>'", "id", _age(BORN), "'<phone>'", '"Postcode"', '"Gender"', _MONEY.format('"Balance"'))} AS row
  FROM people LEFT JOIN ids ON k = {_key('"NHI"')}
  UNION ALL SELECT 'visits', 'ID|AdmissionDate|Status|Priority|Contact', pos,
    {_row("id", '"AdmissionDate"', '"Status"', '"Priority"', "'<phone>'")} FROM visits LEFT JOIN ids ON k = {_key('"NHI"')}
  UNION ALL SELECT 'measures', 'Kind|Score|Notes', pos, {_row('"Kind"', _MONEY.format('"Score"'), '"Notes"')} FROM measures
    WHERE NOT (coalesce("Kind", '') = '' AND "Score" IS NULL AND coalesce("Notes", '') = '')
  UNION ALL SELECT 'contacts', 'Email|Member|card_number|Mobile|ID|PatientID|Host|Age|Zip|Age|Sex|Due|rating|Shipment|Rare', pos,
    {_row("'<email>'", "'<ssn>'", "'<cc>'", "'<phone>'", "r.id", "p.id", "'<ip>'", _age('"Birth Date"'), "'<ip>'", '"Age"', '"Sex"', '"Due"', "'<ssn>'", "'<ip>'", "'<email>'")}
  FROM (SELECT * REPLACE (CASE WHEN "Birth Date" LIKE '12/%' THEN DATE '1980-12-05' END AS "Birth Date") FROM contacts)
  LEFT JOIN ids r ON r.k = {_key('"Ref"')} LEFT JOIN ids p ON p.k = {_key('"Patient_ID"')})
""") + "SELECT sheet, min(pos) AS pos, headers, row FROM out GROUP BY sheet, headers, row"

# Expected suggestion for people: name, dob and contact redacted or aged, address dropped, NHI anonymized.
Q["q23_detect_then_clean"] = with_(SHEETS, PEOPLE_ALONE, f"""
r AS (SELECT DISTINCT {_key('"NHI"')} AS k, {_age(BORN)} AS "Age", "Postcode", "Gender", "Balance" FROM people)""") + """
SELECT '<name>' AS "Name", coalesce(id, '') AS "ID", "Age", '<phone>' AS "Contact", "Postcode", "Gender", "Balance" FROM r LEFT JOIN ids USING (k)
"""
Q["q23_workbook_files"] = Q["q01_clean_default"]

Q["q24_stream_clean"] = f"""
WITH m AS (SELECT user_id, printf('ID-%03d', row_number() OVER (ORDER BY min(event_id))) AS id FROM events WHERE user_id % 10 <> 0 GROUP BY user_id)
SELECT event_id, coalesce(id, '') AS "ID", {_age('make_date(CAST(1940 + user_id % 60 AS INTEGER), 7, 1)')} AS "Age", event_type, '<props>' AS props
FROM events LEFT JOIN m USING (user_id)
"""
Q["q25_stream_dedup"] = "SELECT DISTINCT event_type, user_id FROM events"

_AUDIT = """
WITH RECURSIVE nxt AS (
  SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts
  FROM events),
w AS (SELECT user_id, min(ts) AS ws FROM events GROUP BY user_id
      UNION ALL SELECT w.user_id, n.next_ts FROM w JOIN nxt n ON n.user_id = w.user_id AND n.ts = w.ws WHERE n.next_ts IS NOT NULL),
hits AS (SELECT e.user_id, e.event_id, e.ts, w.ws FROM events e ASOF JOIN w ON e.user_id = w.user_id AND e.ts >= w.ws),
counted AS (SELECT *, row_number() OVER (PARTITION BY user_id, ws ORDER BY ts, event_id) AS hit_count FROM hits)
"""
Q["q26_throttle"] = _AUDIT + """
SELECT user_id, event_id, ts, ws AS window_start, hit_count, hit_count > 3 AS over_limit,
  CASE WHEN hit_count > 3 THEN greatest(1, CAST(ceil((epoch_us(ws + INTERVAL 24 HOUR) - epoch_us(ts)) / 1e6) AS BIGINT)) END AS retry_after FROM counted
"""
Q["q26_stream_throttle"] = _AUDIT + "SELECT user_id, event_id, hit_count, hit_count > 3 AS over_limit FROM counted"

_KEYLESS = _AUDIT.replace("WITH RECURSIVE nxt", "WITH RECURSIVE keyless AS (SELECT * REPLACE (CASE WHEN user_id % 7 = 0 THEN -1 ELSE user_id END AS user_id) FROM events), nxt").replace(
    "FROM events", "FROM keyless").replace("AS user_id) FROM keyless)", "AS user_id) FROM events)")
Q["q26_throttle_null_keys"] = _KEYLESS + """
SELECT nullif(user_id, -1) AS user_id, event_id, ts, ws AS window_start, hit_count, hit_count > 3 AS over_limit,
  CASE WHEN hit_count > 3 THEN greatest(1, CAST(ceil((epoch_us(ws + INTERVAL 24 HOUR) - epoch_us(ts)) / 1e6) AS BIGINT)) END AS retry_after FROM counted
"""
Q["q26_throttle_large_keys"] = Q["q26_throttle_null_keys"]
Q["q26_stream_null_keys"] = _KEYLESS + "SELECT nullif(user_id, -1) AS user_id, event_id, hit_count, hit_count > 3 AS over_limit FROM counted"

_REGISTRY = """,
keyed AS (SELECT pos, trim("NHI") AS k, "Gender" FROM people),
registry AS (SELECT c_name AS k, 'R' || CAST(c_custkey // 2 AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 <> 0),
merged AS (SELECT min(pos) AS pos, count(*) AS n_rows, sum(CASE WHEN k = '' THEN 1 ELSE 0 END) AS missing, coalesce(id, '') AS "ID", "Gender"
           FROM keyed LEFT JOIN registry USING (k) GROUP BY coalesce(id, ''), "Gender")
"""
Q["q27_registry_rows"] = with_(SHEETS) + _REGISTRY + 'SELECT pos, n_rows, "ID", "Gender" FROM merged'
Q["q27_registry_stats"] = with_(SHEETS) + _REGISTRY + """
SELECT CAST(sum(n_rows) AS BIGINT) AS "rowsProcessed", CAST(sum(n_rows) - count(*) AS BIGINT) AS "duplicatesRemoved", 0 AS "invalidDobCount",
       CAST(sum(missing) AS BIGINT) AS "missingNhiCount", 0 AS "redactedCellCount" FROM merged
"""
_GROWN = """
old AS (SELECT k, row_number() OVER (ORDER BY min(pos)) AS number, 1 AS version FROM (SELECT pos, trim("NHI") AS k FROM visits) GROUP BY k HAVING k <> ''),
new AS (SELECT k, (SELECT max(number) FROM old) + row_number() OVER (ORDER BY min(pos)) AS number, 2 AS version
        FROM (SELECT pos, trim("NHI") AS k FROM people) WHERE k <> '' AND k NOT IN (SELECT k FROM old) GROUP BY k),
ids AS (SELECT k, printf('ID-%03d', number) AS id, number, version FROM (SELECT * FROM old UNION ALL SELECT * FROM new))
"""
Q["q29_registry_growth"] = with_(SHEETS, _GROWN) + "SELECT k AS key, id, number, CAST(version AS BIGINT) AS version FROM ids"
Q["q29_registry_growth_rows"] = with_(SHEETS, PEOPLE_KEYED, _GROWN) + """
SELECT pos, "Name", coalesce(id, '') AS "ID", "Age", "Postcode", "Gender", "Balance" FROM people_keyed LEFT JOIN ids USING (k)
"""

Q["q28_ingest_outcomes"] = """
WITH f AS (SELECT c_custkey // 10 AS n, count(*) AS c FROM customer GROUP BY ALL)
SELECT 'file-' || lpad(CAST(n AS VARCHAR), 12, '0') || CASE n % 5 WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xls' WHEN 4 THEN '.Xlsx' ELSE '.xlsx' END AS path,
       CASE n % 5 WHEN 2 THEN 'rejected' WHEN 4 THEN 'rejected' WHEN 3 THEN 'failed' ELSE 'read' END AS outcome,
       CASE n % 5 WHEN 2 THEN 'unsupported file type' WHEN 4 THEN 'file too large' END AS reason,
       CASE WHEN n % 5 < 2 THEN c + 1 ELSE 0 END AS rows FROM f
"""

Q["q30_parquet_positions"] = "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders"
Q["q30_csv_positions"] = """
SELECT row_number() OVER (ORDER BY doc_id) AS n, CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents
"""

ORACLE = Q

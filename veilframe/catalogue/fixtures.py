"""Sheets derived from the test tables by portable SQL: the same text runs in Spark and DuckDB."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from veilframe.sources.sheets import Sheet

AS_OF = dt.date(2024, 6, 30)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

PEOPLE = """
SELECT c_custkey AS pos,
       concat('Person ', cast(c_custkey % 50 AS string)) AS "Name",
       CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN '  '
            WHEN c_custkey % 5 = 0 THEN concat(' ', c_name, ' ') ELSE c_name END AS "NHI",
       CASE WHEN c_custkey % 23 = 0 THEN 'not-a-date' WHEN c_custkey % 29 = 0 THEN ''
            ELSE cast(date '1940-01-01' + cast((c_custkey * 37) % 25000 AS int) AS string) END AS "DOB",
       concat('021-', cast(c_custkey AS string)) AS "Contact",
       concat(cast(c_custkey AS string), ' Main St') AS "Address",
       lpad(cast(c_nationkey AS string), 4, '0') AS "Postcode",
       CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'X' END AS "Gender",
       'x' AS "Column 4",
       c_acctbal AS "Balance"
FROM customer
"""

VISITS = """
SELECT o_orderkey AS pos,
       concat('Customer#', lpad(cast(o_custkey AS string), 9, '0')) AS "NHI",
       cast(cast(o_orderdate AS date) AS string) AS "AdmissionDate",
       o_orderstatus AS "Status", o_orderpriority AS "Priority",
       cast(o_orderkey AS string) AS "Contact"
FROM orders
"""

MEASURES = """
SELECT event_id AS pos,
       CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN '' ELSE event_type END AS "Kind",
       CASE WHEN event_id % 50 IN (0, 1) THEN NULL WHEN event_id % 7 = 0 THEN 0 ELSE value END AS "Score",
       CASE WHEN event_id % 50 IN (0, 1) THEN NULL WHEN event_id % 50 = 2 THEN '  ' ELSE props END AS "Notes"
FROM events
"""

# One column per detection pattern, plus headers that hit a hint by accident.
CONTACTS = """
SELECT c_custkey AS pos,
       concat('user', cast(c_custkey AS string), '@example.org') AS "Email",
       concat(cast(100 + c_custkey % 900 AS string), '-', cast(10 + c_custkey % 90 AS string), '-',
              cast(1000 + c_custkey % 9000 AS string)) AS "Member",
       concat('4242 4242 4242 ', cast(1000 + c_custkey % 9000 AS string)) AS "card_number",
       concat('+64 21 ', cast(100000 + c_custkey % 900000 AS string)) AS "Mobile",
       CASE WHEN c_custkey % 5 < 3 THEN concat('ABC', cast(1000 + c_custkey % 9000 AS string)) ELSE 'n/a' END AS "Ref",
       concat('MRN-', cast(c_custkey AS string)) AS "Patient_ID",
       concat('10.0.', cast(c_custkey % 256 AS string), '.7') AS "Host",
       CASE WHEN c_custkey % 2 = 0 THEN '12/5/1980' ELSE 'unknown' END AS "Birth Date",
       'Somewhere 1' AS "Street",
       1000 + c_nationkey AS "Zip",
       cast(c_custkey % 140 AS string) AS "Age",
       CASE WHEN c_custkey % 4 = 0 THEN ' Female ' WHEN c_custkey % 4 = 1 THEN 'male' ELSE 'q' END AS "Sex",
       CASE WHEN c_custkey % 20 < 11 THEN '2024-02-01' ELSE 'later' END AS "Due",
       c_acctbal AS "rating",
       CASE WHEN c_custkey % 3 = 0 THEN '1.2.3.4' ELSE '' END AS "Shipment",
       CASE WHEN c_custkey % 100 = 99 THEN 'a@b.co' END AS "Rare"
FROM customer
"""

# Order dates, moved into a plausible range of birth dates, in eight written forms.
DATE_FORMS = """
SELECT o_orderkey AS pos,
       CASE o_orderkey % 10
            WHEN 0 THEN cast(d AS string)
            WHEN 1 THEN concat(cast(month(d) AS string), '/', cast(day(d) AS string), '/', cast(year(d) AS string))
            WHEN 2 THEN concat(cast(month(d) AS string), '-', cast(day(d) AS string), '-', cast(year(d) AS string))
            WHEN 3 THEN concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(d) - 2, 3), ' ', cast(day(d) AS string), ', ',
                               cast(year(d) AS string))
            WHEN 4 THEN concat(cast(day(d) AS string), ' ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(d) - 2, 3), ' ',
                               cast(year(d) AS string))
            WHEN 5 THEN concat(cast(year(d) AS string), '/', lpad(cast(month(d) AS string), 2, '0'), '/', lpad(cast(day(d) AS string), 2, '0'))
            WHEN 6 THEN concat(cast(d AS string), 'T12:00:00Z')
            WHEN 7 THEN concat(' ', cast(month(d) AS string), '/', cast(day(d) AS string), '/', right(cast(year(d) AS string), 2))
            WHEN 8 THEN concat(cast(year(d) AS string), '-02-30')
            ELSE concat(cast(13 + o_orderkey % 10 AS string), '/', cast(day(d) AS string), '/', cast(year(d) AS string)) END AS "written",
       d AS "original"
FROM (SELECT o_orderkey, cast(o_orderdate AS date) - cast(9000 + o_orderkey % 5000 AS int) AS d FROM orders)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the texts above on the tables of ``sf_dir``; only the identifier quotes differ."""
    source = sql.rsplit("FROM", 1)[1].strip(" \n)")
    return spark.sql(sql.replace(f"FROM {source}", "FROM {t}").replace('"', "`"), t=table(spark, sf_dir, source))


def people(spark: SparkSession, sf_dir: str) -> Sheet:
    return Sheet("people", derived(spark, sf_dir, PEOPLE), "pos")


def visits(spark: SparkSession, sf_dir: str) -> Sheet:
    return Sheet("visits", derived(spark, sf_dir, VISITS), "pos")


def visits_undated(spark: SparkSession, sf_dir: str) -> Sheet:
    """Visits without their date, so that whole rows can repeat."""
    return Sheet("visits", derived(spark, sf_dir, VISITS).drop("AdmissionDate"), "pos")


def contacts(spark: SparkSession, sf_dir: str) -> Sheet:
    return Sheet("contacts", derived(spark, sf_dir, CONTACTS), "pos")


def measures(spark: SparkSession, sf_dir: str) -> Sheet:
    return Sheet("measures", derived(spark, sf_dir, MEASURES), "pos")

"""Test tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyloom.sources.tables import spread


SURVEY = """
SELECT o.o_orderkey AS row_id,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'test' WHEN o.o_orderkey % 101 = 0 THEN ' N/A '
       WHEN o.o_orderkey % 103 = 0 THEN NULL ELSE concat('UK', lpad(CAST(o.o_custkey AS VARCHAR(20)), 8, '0')) END AS unique_key,
  CASE WHEN o.o_orderkey % 89 = 0 THEN 'not a date' WHEN o.o_orderkey % 83 = 0 THEN NULL
       ELSE substr(CAST(o.o_orderdate AS VARCHAR(40)), 1, 10) END AS submission_date,
  concat(
    CASE o.o_custkey % 10 WHEN 0 THEN 'RAMESH' WHEN 1 THEN 'sunita' WHEN 2 THEN 'AniTa' WHEN 3 THEN 'vijay' WHEN 4 THEN 'Jijabai'
      WHEN 5 THEN 'mary-anne' WHEN 6 THEN 'o''connor' WHEN 7 THEN 'mcdonald' WHEN 8 THEN 'Xyzq' ELSE 'sundarbai' END,
    CASE WHEN o.o_orderkey % 7 = 0 THEN '   ' ELSE ' ' END,
    CASE o.o_orderkey % 4 WHEN 0 THEN 'KUMAR' WHEN 1 THEN 'van' WHEN 2 THEN 'madavi' ELSE 'Ganpat' END, ' ',
    CASE o.o_custkey % 6 WHEN 0 THEN 'meshram' WHEN 1 THEN 'PATIL' WHEN 2 THEN 'mesharam' WHEN 3 THEN 'Kamble' WHEN 4 THEN 'Zzgrp' ELSE 'uike' END) AS person_name,
  CASE o.o_custkey % 3 WHEN 0 THEN 'Sita Devi' WHEN 1 THEN 'ramesh patil' ELSE NULL END AS guardian_name,
  CASE o.o_orderkey % 9 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN 'Male' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'Other' WHEN 6 THEN 'F' WHEN 7 THEN 'others' ELSE 'x' END AS gender,
  CASE WHEN o.o_orderkey % 45 = 0 THEN '' WHEN o.o_orderkey % 5 = 0 THEN 'Female' ELSE 'male' END AS vote_gender,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'OBC' WHEN 1 THEN 'st' WHEN 2 THEN 'General' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'gENERAL' WHEN 6 THEN 'Sc' ELSE 'zz' END AS category,
  CASE o.o_custkey % 5 WHEN 0 THEN 'Gadchiroli' WHEN 1 THEN 'pune' WHEN 2 THEN ' nandurbar ' WHEN 3 THEN NULL ELSE 'Nagpur' END AS district,
  concat('Village ', CAST(c.c_nationkey AS VARCHAR(10))) AS village,
  CASE o.o_orderkey % 8 WHEN 0 THEN concat('9', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 9, '0')) WHEN 1 THEN concat('+91 8', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 9, '0'))
    WHEN 2 THEN concat('91-7', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 9, '0')) WHEN 3 THEN concat('06', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 9, '0'))
    WHEN 4 THEN '98765' WHEN 5 THEN concat('5', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 9, '0')) WHEN 6 THEN NULL ELSE concat('98765 4', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 9, '0'), '1') END AS contact_number,
  CASE o.o_orderkey % 8 WHEN 0 THEN concat('MH-31-114-062-009/', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 6, '0')) WHEN 1 THEN concat('mh-31-114-062-009/', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 6, '0'))
    WHEN 2 THEN concat('MH-31-114-062-009-', CAST(o.o_orderkey AS VARCHAR(20))) WHEN 3 THEN concat('31114062009', lpad(CAST(o.o_orderkey AS VARCHAR(20)), 6, '0'))
    WHEN 4 THEN 'GJ-31-114-062-009/000387' WHEN 5 THEN 'MH - 31 - 114 - 062 - 009/000387' WHEN 6 THEN NULL ELSE 'MH-3-114-062-009/000387' END AS job_card,
  CASE o.o_orderkey % 6 WHEN 0 THEN '2024-01-15' WHEN 1 THEN '15/01/2024' WHEN 2 THEN '2030-01-15' WHEN 3 THEN 'invalid' WHEN 4 THEN '' ELSE NULL END AS survey_date,
  CASE o.o_orderkey % 6 WHEN 0 THEN '25' WHEN 1 THEN '15' WHEN 2 THEN '105' WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE '18' END AS age,
  CASE o.o_orderkey % 7 WHEN 0 THEN '5.5' WHEN 1 THEN '-2' WHEN 2 THEN '0' WHEN 3 THEN '1500' WHEN 4 THEN 'abc' WHEN 5 THEN NULL ELSE '0.005' END AS land_area,
  lpad(CAST(100000000000 + o.o_custkey * 7 AS VARCHAR(20)), CASE WHEN o.o_orderkey % 50 = 0 THEN 11 ELSE 12 END, '0') AS national_id,
  concat('file_', CAST(o.o_orderkey % 4 AS VARCHAR(5)), '.csv') AS source_file
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

HOUSEHOLD = """
SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 20 = 0 THEN '' WHEN c_custkey % 20 = 1 THEN concat('hh', CAST(c_custkey AS VARCHAR(10))) ELSE concat('HHMH', lpad(CAST(c_custkey AS VARCHAR(10)), 8, '0')) END AS household_id,
  CASE WHEN c_custkey % 50 = 0 THEN repeat('Long Name ', 11) WHEN c_custkey % 51 = 0 THEN NULL ELSE c_name END AS family_head_name,
  CASE c_custkey % 6 WHEN 0 THEN 'SC' WHEN 1 THEN 'ST' WHEN 2 THEN 'OBC' WHEN 3 THEN 'GENERAL' WHEN 4 THEN 'Genral' ELSE '' END AS social_category,
  CASE WHEN c_custkey % 30 = 0 THEN 'MH' WHEN c_custkey % 30 = 1 THEN '0' WHEN c_custkey % 30 = 2 THEN '-5' ELSE '27' END AS state_code,
  CAST(500 + c_nationkey AS VARCHAR(10)) AS district_code,
  CASE WHEN c_custkey % 40 = 0 THEN 'north' ELSE CAST(c_custkey % 90 AS VARCHAR(10)) END AS latitude,
  CASE c_custkey % 4 WHEN 0 THEN '2.5' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE '1' END AS land_holding_acres,
  CASE c_custkey % 3 WHEN 0 THEN 'CANAL' WHEN 1 THEN NULL ELSE 'RIVER' END AS irrigation_source,
  CASE c_custkey % 5 WHEN 0 THEN 'ABCD0123456' WHEN 1 THEN 'abcd0123456' ELSE NULL END AS ifsc_code,
  CASE c_custkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'Yes' END AS shg_member,
  CASE c_custkey % 2 WHEN 0 THEN ' ' ELSE concat('Group ', CAST(c_nationkey AS VARCHAR(10))) END AS shg_name,
  CASE c_custkey % 7 WHEN 0 THEN '5123456789' WHEN 1 THEN NULL ELSE concat('9', lpad(CAST(c_custkey AS VARCHAR(10)), 9, '0')) END AS mobile_number,
  CAST(100000000000 + c_custkey % 1400 AS VARCHAR(20)) AS aadhaar_number,
  CASE WHEN c_custkey % 60 = 0 THEN concat(CAST(200000000000 + c_custkey AS VARCHAR(20)), ' id') ELSE c_mktsegment END AS remarks
FROM {customer}
"""

EVIDENCE = """
SELECT CASE WHEN user_id % 5 = 0 THEN 'asha' WHEN user_id % 5 = 1 THEN 'ravi' WHEN user_id % 5 = 2 THEN 'kiran' WHEN user_id % 5 = 3 THEN concat('n', substr('abcdefghij', CAST(user_id % 10 AS INT) + 1, 1), 'x') ELSE 'a1' END AS first_raw,
  CASE WHEN user_id % 5 = 0 THEN 'Female' WHEN user_id % 5 = 1 THEN ' male '
    WHEN user_id % 10 = 3 THEN CASE WHEN event_id % 3 = 0 THEN 'female' ELSE 'male' END
    WHEN user_id % 5 = 2 AND event_id % 12 = 0 THEN 'female' WHEN event_id % 30 = 0 THEN 'female' ELSE 'male' END AS gender_raw,
  concat('f', CAST(event_id % 3 AS VARCHAR(5)), '.csv') AS source_file
FROM {events}
"""

FILE_EVENTS = """
SELECT concat('file_', CAST(user_id AS VARCHAR(10)), '.csv') AS file_name, event_id AS seq, ts AS at,
  CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'upload' WHEN 'purchase' THEN 'reject' WHEN 'error' THEN 'revoke' ELSE 'hold' END AS action,
  concat('admin', CAST(event_id % 3 AS VARCHAR(3))) AS actor
FROM {events}
"""

EDITS = """
SELECT o_orderkey AS row_id, CASE o_orderkey % 3 WHEN 0 THEN 'gender' WHEN 1 THEN 'category' ELSE 'no_such_field' END AS field,
  CASE o_orderkey % 3 WHEN 0 THEN 'female' ELSE 'obc' END AS value, o_orderkey AS seq
FROM {orders} WHERE o_orderkey % 11 = 0
"""

FIXTURES = {
    "survey": (SURVEY, ('orders', 'customer')),
    "household": (HOUSEHOLD, ('customer',)),
    "evidence": (EVIDENCE, ('events',)),
    "file_events": (FILE_EVENTS, ('events',)),
    "edits": (EDITS, ('orders',)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Leading column of each source table, used to spread an input of few splits over the cores.
_SPREAD_BY = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "documents": "doc_id"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables as a DataFrame."""
    sql, sources = FIXTURES[name]
    frames = {t: table(spark, sf_dir, t) for t in sources}
    frames[sources[0]] = spread(frames[sources[0]], _SPREAD_BY[sources[0]])
    return spark.sql(sql, **frames)


def derived(*names: str) -> str:
    """The derived tables as a list of common table expressions over the original tables."""
    parts = []
    for name in names:
        sql, sources = FIXTURES[name]
        parts.append(f"{name} AS ({sql.format(**{t: t for t in sources})})")
    return ", ".join(parts)

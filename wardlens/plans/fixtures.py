"""Notes, atoms and semantic types made from the star-schema tables, by SQL that reads the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()

#: One note an order. a and b are the first and last part name of its lines, c the noun of a; missing lines give empty names.
NOTES = """
SELECT CAST(o.o_orderkey AS BIGINT) AS doc_id, 'order-' || CAST(o.o_orderkey AS STRING) AS source,
  CASE o.o_orderkey % 14
    WHEN 0 THEN 'Past Medical History: ' || a || ', ' || c || '. Patient denies ' || b || ' but reports ' || c || '.'
    WHEN 1 THEN 'Review of Systems: Negative for ' || a || ', one, two, three, four, five, ' || b || '. Assessment: Possible ' || c || '.'
    WHEN 2 THEN 'Mother with ' || a || '. Patient has ' || b || ' today. No ' || c || ' or ' || b || '.'
    WHEN 3 THEN 'Call if you develop ' || a || '. ' || b || ', resolved. ' || c || ' is possible.'
    WHEN 4 THEN 'Family History: ' || a || ' and ' || b || '. Plan: evaluate for ' || c || '.'
    WHEN 5 THEN 'History of ' || a || ' but now ' || b || ' is new. ' || c || ' was ruled out.'
    WHEN 6 THEN a || ' has not been ruled out. Not only ' || b || '. Gram negative ' || c || '.'
    WHEN 7 THEN 'No evidence of ' || a || ' with ' || b || ' and also the other ' || c || ' of ' || a || '.'
    WHEN 8 THEN '1. Allergies: ' || a || '. Wound Care: ' || b || '. Still ' || c || ' without ' || a || '.'
    WHEN 9 THEN 'Family planning for ' || a || '. Father had ' || b || ' years ago! Does she have ' || c || '?'
    WHEN 10 THEN 'Cannot exclude ' || a || ', cannot rule out ' || b || '. Tylenol PRN ' || c || ' . ' || a || '.'
    WHEN 11 THEN ''
    WHEN 12 THEN 'Status post ' || a || '; consistent with prior ' || b || '. Should symptoms of ' || c || ' recur, return.'
    ELSE 'PMH ' || upper(a) || ', sister''s ' || b || ' and x-ray of ' || c || '. Denies ' || a || ', ' || b || ', and ' || c || '.'
  END AS text
FROM orders o LEFT JOIN (
  SELECT l_orderkey, min(p_name) AS a, max(p_name) AS b, min(split_part(p_name, ' ', 2)) AS c
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) n ON n.l_orderkey = o.o_orderkey
"""
#: Orders without lines have no names: their notes are empty.
NOTES = f"SELECT doc_id, source, coalesce(text, '') AS text FROM ({NOTES}) t"

_NAMES = "SELECT s, CAST(dense_rank() OVER (ORDER BY s) AS INT) AS r FROM (SELECT p_name AS s FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part) x"
CONSO = f"""
SELECT 'C' || lpad(CAST(r AS STRING), 7, '0') AS cui, CASE WHEN r % 11 = 10 THEN 'FRE' ELSE 'ENG' END AS lat,
  CASE WHEN r % 4 = 0 THEN 'Y' ELSE 'N' END AS ispref, CASE r % 3 WHEN 0 THEN 'SNOMEDCT_US' WHEN 1 THEN 'RXNORM' ELSE 'MSH' END AS sab,
  CASE WHEN r % 4 = 1 THEN 'FN' ELSE 'PT' END AS tty, CASE WHEN r % 4 = 1 THEN s || ' (finding)' ELSE s END AS str, CASE WHEN r % 13 = 12 THEN 'O' ELSE 'N' END AS suppress
FROM ({_NAMES}) a
UNION ALL SELECT 'C' || lpad(CAST(r AS STRING), 7, '0'), 'ENG', 'N', 'SNOMEDCT_US', 'SY', '  ' || upper(s) || ' ', 'N' FROM ({_NAMES}) b WHERE r % 2 = 0
UNION ALL SELECT 'C9' || lpad(CAST(r AS STRING), 6, '0'), 'ENG', 'Y', 'RXNORM', 'PT', s, 'N' FROM ({_NAMES}) c WHERE r % 5 = 0
UNION ALL SELECT 'C' || lpad(CAST(r AS STRING), 7, '0'), 'ENG', 'N', 'RXNORM', 'SY', 'the ' || s || '-like state', 'N' FROM ({_NAMES}) d WHERE r % 3 = 0
UNION ALL SELECT 'C0000001', 'ENG', 'N', 'RXNORM', 'SY', t, 'N' FROM (SELECT 'today' AS t UNION ALL SELECT 'Never' UNION ALL SELECT 'four') e
"""
STY = f"""
SELECT 'C' || lpad(CAST(r AS STRING), 7, '0') AS cui, CASE r % 6 WHEN 0 THEN 'T047' WHEN 1 THEN 't184 ' WHEN 2 THEN 'T121' WHEN 3 THEN 'T061' WHEN 4 THEN 'T023' ELSE 'T047' END AS tui FROM ({_NAMES}) a
UNION ALL SELECT 'C9' || lpad(CAST(r AS STRING), 6, '0'), CASE WHEN r % 2 = 0 THEN 'T047' ELSE 'T002' END FROM ({_NAMES}) b
UNION ALL SELECT 'C' || lpad(CAST(r AS STRING), 7, '0'), 'T033' FROM ({_NAMES}) c WHERE r % 7 = 0
"""


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in ("part", "orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(NOTES)


def conso(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(CONSO)


def sty(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(STY)

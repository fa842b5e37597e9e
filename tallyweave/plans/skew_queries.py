"""Queries of the skew operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.tokens import squash, ten_digits
from tallyweave.operators.skew import balanced_key_counts, heavy_keys


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/records.parquet")
    return heavy_keys(records, {"phone": ten_digits("phone"), "name": F.nullif(squash("name"), F.lit(""))}, "record_id")


def p5_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct records of every dialable line."""
    records = spark.read.parquet(f"{sf_dir}/records.parquet")
    keyed = records.select(ten_digits("phone").alias("line"), "record_id")
    return balanced_key_counts(keyed, ["line"], "record_id").select("line", "n_rows", "n_distinct", F.col("low").alias("first_id"), F.col("high").alias("last_id"))


QUERIES = {"p5_found": p5_found, "p5_key_counts": p5_key_counts}

TEN_DIGITS_SQL = r"""(CASE WHEN regexp_matches(regexp_replace(regexp_replace(regexp_replace(lower(phone), '\s*(x|ext\.?|extension|#)\s*\d+\s*$', ''), '[^0-9]', '', 'g'), '^1(\d{10})$', '\1'), '^[2-9]\d{9}$')
 THEN regexp_replace(regexp_replace(regexp_replace(lower(phone), '\s*(x|ext\.?|extension|#)\s*\d+\s*$', ''), '[^0-9]', '', 'g'), '^1(\d{10})$', '\1') END)"""

ORACLE = {
    "p5_found": f"""
WITH k AS (
  SELECT 'phone' AS key_kind, {TEN_DIGITS_SQL} AS key_value, record_id FROM records
  UNION ALL
  SELECT 'name', nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ''), record_id FROM records)
SELECT key_kind, key_value FROM k WHERE key_value IS NOT NULL
GROUP BY key_kind, key_value
HAVING count(DISTINCT record_id) >= 0.02 * (SELECT count(DISTINCT record_id) FROM records)""",
    "p5_key_counts": f"""
SELECT {TEN_DIGITS_SQL} AS line, count(*) AS n_rows, count(DISTINCT record_id) AS n_distinct, min(record_id) AS first_id, max(record_id) AS last_id
FROM records WHERE {TEN_DIGITS_SQL} IS NOT NULL AND record_id IS NOT NULL GROUP BY 1""",
}

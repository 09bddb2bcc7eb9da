"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.session import share_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB: current records of repo_graph with compared ids.
CURRENT_SQL = r"""cur AS (
  SELECT * FROM (
    SELECT *, regexp_replace(replace(unique_id, '\', '/'), '^(\./)+', '') AS uid,
      regexp_replace(replace(file, '\', '/'), '^(\./)+', '') AS fpath,
      split_part(regexp_replace(replace(coalesce(file, unique_id), '\', '/'), '^(\./)+', ''), '/', 1) AS repo,
      row_number() OVER (PARTITION BY regexp_replace(replace(unique_id, '\', '/'), '^(\./)+', '') ORDER BY scanned_at DESC NULLS LAST, ordinal DESC) AS rn
    FROM repo_graph WHERE unique_id IS NOT NULL)
  WHERE rn = 1)"""

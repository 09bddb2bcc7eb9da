"""Entities rolled up to files and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import risk
from codestrata.functions.paths import directory_key
from codestrata.operators.graph import degrees


def rollup_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per entity with a file: its directory, degree, complexity, risk level and line."""
    nodes = entities.select(F.col("uid").alias("node"))
    d = degrees(nodes, edges).select(F.col("node").alias("uid"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    placed = entities.where(F.col("file_path").isNotNull() & (F.col("file_path") != ""))
    return placed.join(d, "uid", "left").select(
        F.col("uid").alias("id"), "name", F.regexp_replace("file_path", r"^[./]+", "").alias("file"), directory_key("file_path").alias("directory"), F.col("entity_type").alias("type"),
        risk.degree_level(F.coalesce("degree", F.lit(0))).alias("risk_level"), F.coalesce(F.col("complexity.cyclomatic"), F.lit(0)).alias("complexity"), F.coalesce("degree", F.lit(0)).alias("degree"), F.try_element_at("line_range", F.lit(1)).alias("line"),
    )


def rollup_files(entities: DataFrame) -> DataFrame:
    """Per file: entities, highest risk, total complexity."""
    return entities.groupBy("file", "directory").agg(
        F.count("*").alias("entity_count"), F.max_by("risk_level", risk.level_rank(F.col("risk_level"))).alias("risk_level"), F.sum("complexity").cast("bigint").alias("total_complexity")
    )


def rollup_directories(files: DataFrame) -> DataFrame:
    """Per directory over the files' roll-up."""
    return files.groupBy("directory").agg(
        F.count("*").alias("file_count"), F.sum("entity_count").cast("bigint").alias("entity_count"), F.max_by("risk_level", risk.level_rank(F.col("risk_level"))).alias("risk_level"), F.sum("total_complexity").cast("bigint").alias("total_complexity")
    )


def rollup_edges(entities: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """(source, target, weight) between files or directories, without pairs of the same one."""
    at = entities.select("id", F.col(level).alias("_at"))
    return (
        edges.join(at.select(F.col("id").alias("source"), F.col("_at").alias("_s")), "source").join(at.select(F.col("id").alias("target"), F.col("_at").alias("_t")), "target")
        .where(F.col("_s") != F.col("_t")).groupBy(F.col("_s").alias("from_" + level), F.col("_t").alias("to_" + level)).agg(F.count("*").alias("weight"))
    )

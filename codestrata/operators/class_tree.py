"""Parent links of classes (bases) and methods (parent_class) within a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.records import current_records
from codestrata.session import cut


def base_name(c: Column) -> Column:
    """A base without type arguments (from '[' on), surrounding blanks and what precedes its last dot."""
    plain = F.trim(F.substring_index(c, "[", 1))
    return F.trim(F.substring_index(plain, ".", -1))


def parent_links(repo_graph: DataFrame) -> DataFrame:
    """(node, parent, name) of current classes and of current functions with a parent_class.

    A class's parent is the class named by the first entry of its bases that names one of its repository; where a
    repository has several classes of a name, the least id stands for it. Null and empty bases name nothing.
    """
    r = current_records(repo_graph, ["entity_type", "name", "bases", "parent_class"])
    r = r.where((F.col("entity_type") == "class") | ((F.col("entity_type") == "function") & F.col("parent_class").isNotNull()))
    is_class = F.col("entity_type") == "class"
    refs = F.when(is_class, F.transform(F.coalesce("bases", F.array().cast("array<string>")), base_name)).otherwise(F.array("parent_class"))
    # Written once; then the classes' names meet the names that refer to them in one join on (repository, name).
    r = cut(r.select("repo", "uid", "name", is_class.alias("is_class"), refs.alias("refs")))
    named = r.where(F.col("is_class") & F.col("name").isNotNull()).groupBy("repo", F.col("name").alias("ref")).agg(F.min("uid").alias("parent"))
    wanted = r.select("repo", "uid", F.posexplode("refs").alias("pos", "ref")).where(F.col("ref").isNotNull() & (F.col("ref") != ""))
    found = wanted.join(named, ["repo", "ref"]).groupBy("uid").agg(F.min(F.struct("pos", "parent")).alias("_p"))
    return r.select("uid", "name").join(found, "uid", "left").select(F.col("uid").alias("node"), F.col("_p.parent").alias("parent"), "name")

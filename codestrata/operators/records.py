"""Current records of an append-only entity table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import compared_path, repository

#: Names of added columns; an input column of the same name is left out of the result.
UID, REPO, FILE = "uid", "repo", "file_path"


def current_records(df: DataFrame, columns: list[str], key: str = "unique_id", at: str = "scanned_at", order: str = "ordinal") -> DataFrame:
    """One row per compared `key`: the one with the latest `at`, then the highest `order`.

    Only `columns` are read and kept, next to `uid` (the compared key), `repo` and `file_path` (compared; repo of the
    key where the file is null). The latest row is found by a maximum that is taken map-side first, so a key that
    repeats in a third of all rows costs one row a partition in the shuffle. Rows without key have no identity to be
    current for and are left out; a null `at` is older than any time. Equal rows count once. Empty in, empty out.
    """
    columns = [c for c in dict.fromkeys(columns) if c not in (UID, REPO, FILE)]
    packed = F.struct(F.col(at).alias("_at"), F.col(order).alias("_order"), F.col("file").alias("_file"), *[F.col(c) for c in columns])
    latest = df.where(F.col(key).isNotNull()).groupBy(compared_path(key).alias(UID)).agg(F.max(packed).alias("_r"))
    path = compared_path("_r._file")
    return latest.select(
        UID,
        F.coalesce(repository("_r._file"), repository(UID)).alias(REPO),
        path.alias(FILE),
        *[F.col(f"_r.{c}").alias(c) for c in columns],
    )

"""Path and id columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compared_path(c: Column | str) -> Column:
    """The compared form of a path or id: backslashes read as slashes, without leading './'. Null stays null."""
    return F.regexp_replace(F.translate(_col(c), "\\", "/"), r"^(\./)+", "")


def repository(c: Column | str) -> Column:
    """First segment of a compared path."""
    return F.split_part(compared_path(c), F.lit("/"), F.lit(1))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(_col(c), "/"), -1)


def dirname(c: Column | str) -> Column:
    """All but the last segment; '' for a bare file name."""
    return F.regexp_replace(_col(c), r"/?[^/]*$", "")


def directory_key(c: Column | str) -> Column:
    """'' for no segment, 'root' for one, the first for two, else the first two joined."""
    path = F.regexp_replace(F.translate(_col(c), "\\", "/"), r"^[./]+", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    return (
        F.when(n <= 0, F.lit(""))
        .when(n == 1, F.lit("root"))
        .when(n == 2, F.element_at(parts, 1))
        .otherwise(F.concat_ws("/", F.slice(parts, 1, 2)))
    )

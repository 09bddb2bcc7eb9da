"""Top N items within every group, by lower bounds of the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.session import cut

def _first_of_runs(n: int):
    """Of rows sorted by (group, key): the first n rows of every group's run within the partition, with `__topn_local` from 1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("__topn_group")
            change = np.ones(len(g), bool)
            if len(g) > 1:
                change[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
            same = g[0].as_py() == last
            change[0] = not same
            starts = np.maximum.accumulate(np.where(change, np.arange(len(g)), 0))
            local = np.arange(len(g)) - starts + 1
            if same:
                first = int(np.argmax(change)) if change.any() else len(g)
                local[:first] += seen
            last, seen = g[len(g) - 1].as_py(), int(local[-1])
            yield batch.append_column("__topn_local", pa.array(local, pa.int64())).filter(pa.array(local <= n))

    return scan


def top_n_per_group(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, place: str = "place") -> DataFrame:
    """The n rows of every group with the highest `score`, equal ones by `ties` ascending, with their `place` from 1.

    Each partition's own n-th best row of a group is a lower bound of the group's n-th best. A partition passes on its n
    best rows of a group and nothing else; they are compared with the highest of the bounds, and the survivors are ranked.
    So at most n rows a partition and group are ever moved, however many groups there are and however large they get.
    Bounds hold the ties too: equal scores don't pile up. Rows with a null score are left out; a null
    group is a group of its own, null ties come first; rows equal in score and ties are told apart by all columns,
    repeated rows keep a place each. Columns other than `place` are kept. Groups with fewer rows give all they have.
    """
    keep = [c for c in df.columns if c != place]
    kind = df.schema[score].dataType
    negative = -F.col(score).cast("double") if isinstance(kind, (T.FloatType, T.DoubleType)) else -F.col(score).cast("decimal(38,10)" if isinstance(kind, T.DecimalType) else "decimal(20,0)")
    g = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    key = F.struct(negative.alias("s"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], F.xxhash64(*keep).alias("h"))
    keyed = df.where(F.col(score).isNotNull()).select(*keep, g.alias("__topn_group"), key.alias("__topn_key"))
    schema = T.StructType([*keyed.schema, T.StructField("__topn_local", T.LongType())])
    local = cut(keyed.sortWithinPartitions("__topn_group", "__topn_key").mapInArrow(_first_of_runs(n), schema))
    bounds = local.where(F.col("__topn_local") == n).groupBy("__topn_group").agg(F.min("__topn_key").alias("__topn_bound"))
    survivors = local.join(bounds, "__topn_group", "left").where(F.col("__topn_bound").isNull() | (F.col("__topn_key") <= F.col("__topn_bound")))
    w = Window.partitionBy("__topn_group").orderBy("__topn_key")
    return survivors.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).select(*keep, place)

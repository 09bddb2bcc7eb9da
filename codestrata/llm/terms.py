"""Frequency of every distinct term, by range-partitioned external sort and run-length scanning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, record) in order -> (term, occurrences, records) of every run of a term within the partition."""
    term = record = None
    occurrences = records = 0
    names = ["term", "occurrences", "records"]

    def out(terms: list, occ: list, rec: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        t, r = batch.column(0), batch.column(1)
        new_term, new_pair = np.ones(n, bool), np.ones(n, bool)
        if n > 1:
            new_term[1:] = pc.not_equal(t[1:], t[:-1]).to_numpy(zero_copy_only=False)
            new_pair[1:] = new_term[1:] | pc.not_equal(r[1:], r[:-1]).to_numpy(zero_copy_only=False)
        if term is not None and t[0].as_py() == term:
            new_term[0], new_pair[0] = False, r[0].as_py() != record
        starts = np.flatnonzero(new_term)
        pairs = np.concatenate([[0], np.cumsum(new_pair)])
        head = int(starts[0]) if len(starts) else n
        occurrences, records = occurrences + head, records + int(pairs[head])
        if len(starts):
            done_t, done_o, done_r = ([term], [occurrences], [records]) if term is not None else ([], [], [])
            ends = np.append(starts[1:], n)
            done_t += t.take(pa.array(starts[:-1])).to_pylist()
            done_o += (ends - starts)[:-1].tolist()
            done_r += (pairs[ends] - pairs[starts])[:-1].tolist()
            occurrences, records = int(n - starts[-1]), int(pairs[n] - pairs[starts[-1]])
            term = t[int(starts[-1])].as_py()
            if done_t:
                yield out(done_t, done_o, done_r)
        record = r[n - 1].as_py()
    if term is not None:
        yield out([term], [occurrences], [records])


def term_frequencies(df: DataFrame, record: str, term: str, rare_records: int = 2, common_share: float = 0.05) -> DataFrame:
    """df(record, term), one row per occurrence -> (term, occurrences, records, mark).

    The pairs are range-partitioned by (term, record) and sorted there, so that a term with a third of all rows is
    spread over many partitions while a pair is in one; the partial runs of a term are then added up. `mark` is rare
    for at most `rare_records` records, else common above `common_share` of the records that have a term, else useful.
    Null terms and rows without record are left out, the empty term counts as a term, case matters. Columns other than
    the two named are left out. Empty in, empty out.
    """
    pairs = df.where(F.col(term).isNotNull() & F.col(record).isNotNull()).select(F.col(term).cast("string").alias("term"), F.col(record).alias("record"))
    ordered = pairs.repartitionByRange("term", "record").sortWithinPartitions("term", "record")
    runs = ordered.mapInArrow(_runs, "term string, occurrences bigint, records bigint")
    totals = runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    n = pairs.select("record").distinct().agg(F.count("*").alias("_n"))  # one row
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.col("_n") * common_share, "common").otherwise("useful")
    return totals.join(F.broadcast(n)).select("term", "occurrences", "records", mark.alias("mark"))

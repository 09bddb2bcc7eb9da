"""Batch jobs: a source tree to written tables, and reports as text."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.parsing import load_order, parse_files
from codestrata.session import get_session
from codestrata.sources.files import read_archives, read_sources
from codestrata.sources.git import git_contents

#: Steps of an index job and how far it is after each.
STEPS = (("read", 10), ("parse", 35), ("entities", 65), ("imports", 85), ("done", 100))


def sources_of(spark: SparkSession, kind: str, where: str) -> DataFrame:
    """(path, content) of a folder, archives or a git repository; ValueError for another kind."""
    readers = {"folder": lambda: read_sources(spark, where), "archive": lambda: read_archives(spark, where), "git": lambda: git_contents(spark, [where]).withColumnRenamed("file", "path")}
    if kind not in readers:
        raise ValueError(f"unknown source {kind!r}: one of {sorted(readers)}")
    return readers[kind]().select("path", "content")


def index_job(spark: SparkSession, kind: str, where: str, out: str, tell=None) -> dict[str, int]:
    """Parse a source tree and write its entities, imports and modules anew under `out`; the numbers of rows.

    `tell(step, percent)` is called after every step.
    """
    tell = tell or (lambda step, percent: None)
    files = sources_of(spark, kind, where)
    tell(*STEPS[0])
    parsed = f"{out}/parsed"
    parse_files(files).write.mode("overwrite").parquet(parsed)
    rows = spark.read.parquet(parsed)
    tell(*STEPS[1])
    load_order(rows).write.mode("overwrite").parquet(f"{out}/entities")
    tell(*STEPS[2])
    rows.where(F.col("kind") == "import").select("file", "module", "line", "imported_names", "alias", "is_relative", "is_star", "relative_level", "import_type").write.mode("overwrite").parquet(f"{out}/imports")
    tell(*STEPS[3])
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    tell(*STEPS[4])
    return counts


def text_report(title: str, rows: DataFrame, limit: int = 20) -> str:
    """Up to `limit` rows as aligned text under a title; numbers are rounded to four places."""
    got = [[("" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)) for v in r] for r in rows.limit(limit).collect()]
    table = [list(rows.columns), *got]
    widths = [max(len(r[i]) for r in table) for i in range(len(rows.columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in table]
    return "\n".join([title, "=" * len(title), lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def markdown_report(title: str, rows: DataFrame, limit: int = 100) -> str:
    """The same as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = [f"| {' | '.join(cell(v) for v in r)} |" for r in rows.limit(limit).collect()]
    return "\n".join([f"# {title}", "", f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns), *body, ""])


def write_run(rows: DataFrame, path: str) -> None:
    """A run's aggregates (few rows) as JSON and Markdown files, which later runs are compared with."""
    with open(f"{path}.json", "w") as f:
        json.dump([r.asDict() for r in rows.collect()], f, indent=1, default=str)
    with open(f"{path}.md", "w") as f:
        f.write(markdown_report(path.rsplit("/", 1)[-1], rows))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Index a source tree.")
    p.add_argument("kind", choices=["folder", "archive", "git"])
    p.add_argument("where")
    p.add_argument("out")
    a = p.parse_args(argv)
    counts = index_job(get_session("index"), a.kind, a.where, a.out, lambda step, percent: print(f"{percent:3d} % {step}"))
    print(json.dumps(counts))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

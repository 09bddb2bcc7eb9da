"""Git repositories as tables: history, files, contents and line blame, one repository a task."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

COMMIT_SCHEMA = "repo string, commit_hash string, author_name string, author_email string, ts timestamp, message string, file string, added int, deleted int"
BATCH = 5_000


def _lines(repo: str, *arguments: str) -> Iterator[str]:
    """Lines of git's output as they come; an error of git is raised at the end."""
    with subprocess.Popen(["git", "-C", repo, *arguments], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", encoding="utf-8") as p:
        yield from (line.rstrip("\n") for line in p.stdout)
        error = p.stderr.read()
    if p.returncode:
        raise RuntimeError(f"git in {repo}: {error.strip()}")


def new_path(text: str) -> str:
    """The path after a rename as numstat writes it: 'a/{b => c}/d' and 'b => c'."""
    if m := re.match(r"^(.*)\{(.*) => (.*)\}(.*)$", text):
        return (m[1] + m[3] + m[4]).replace("//", "/")
    return text.split(" => ")[-1]


def clone(url: str, into: str, allowed: tuple[str, ...] = ("https://",), seconds: float = 120, depth: int | None = None) -> str:
    """Clone a repository, on the driver, within a time; ValueError for an address that begins with none of `allowed`."""
    if not url.startswith(allowed) or url.startswith("-"):
        raise ValueError(f"the address must begin with one of {allowed}")
    subprocess.run(["git", "clone", "--quiet", *([f"--depth={depth}"] if depth else []), "--", url, into], check=True, capture_output=True, timeout=seconds)
    return into


def _tables(spark: SparkSession, repositories: list[str], schema: str, rows_of) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for repo in pdf["repo"]:
                held = []
                for row in rows_of(repo):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    repos = spark.createDataFrame([(r,) for r in repositories], "repo string").repartition(max(1, len(repositories)), "repo")
    return repos.mapInPandas(run, schema)


def read_git_log(spark: SparkSession, repositories: list[str], max_commits: int | None = None, path: str | None = None, since: str | None = None, until: str | None = None, author: str | None = None, suffix: str | None = None) -> DataFrame:
    """One row per commit and file, read as git writes it: limits on path, time and author go to git itself.

    A merge's files are those it changes against its first parent, the first commit's those it adds; renamed files have their
    new path; commits without files have one row with a null file. `suffix` keeps files of one kind (and commits without any).
    """
    options = [x for x in (f"-n{max_commits}" if max_commits else "", f"--since={since}" if since else "", f"--until={until}" if until else "", f"--author={author}" if author else "") if x]

    def rows_of(repo: str) -> Iterator[tuple]:
        head, files = None, 0
        for line in _lines(repo, "log", "--numstat", "-M", "--diff-merges=first-parent", "--format=%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%s", *options, *(["--", path] if path else [])):
            if line.startswith("\x1e"):
                if head and not files:
                    yield (repo, *head, None, 0, 0)
                h, name, email, at, message = line[1:].split("\x1f", 4)
                head, files = (h, name, email, pd.Timestamp(int(at), unit="s"), message), 0
            elif line.count("\t") == 2:
                added, deleted, file = line.split("\t")
                files += 1
                file = new_path(file)
                if suffix is None or file.endswith(suffix):
                    yield (repo, *head, file, int(added) if added.isdigit() else 0, int(deleted) if deleted.isdigit() else 0)
        if head and not files:
            yield (repo, *head, None, 0, 0)

    return _tables(spark, repositories, COMMIT_SCHEMA, rows_of)


def git_files(spark: SparkSession, repositories: list[str], commit: str = "HEAD") -> DataFrame:
    """(repo, file) of the files tracked at a commit."""
    return _tables(spark, repositories, "repo string, file string", lambda repo: ((repo, f) for f in _lines(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "--name-only", commit)))


def git_contents(spark: SparkSession, repositories: list[str], commit: str = "HEAD", suffix: str = "") -> DataFrame:
    """(repo, file, content) at a commit, of the files with the suffix; what isn't UTF-8 is replaced."""

    def rows_of(repo: str) -> Iterator[tuple]:
        for f in _lines(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "--name-only", commit):
            if f.endswith(suffix):
                yield repo, f, subprocess.run(["git", "-C", repo, "show", f"{commit}:{f}"], capture_output=True, check=True).stdout.decode("utf-8", "replace")

    return _tables(spark, repositories, "repo string, file string, content string", rows_of)


def git_blame(spark: SparkSession, repositories: list[str], suffix: str = "", commit: str = "HEAD") -> DataFrame:
    """(repo, file, line, commit_hash, name, email) of every line of the files with the suffix: who wrote it last."""

    def rows_of(repo: str) -> Iterator[tuple]:
        for f in _lines(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "--name-only", commit):
            if not f.endswith(suffix):
                continue
            people: dict[str, list[str]] = {}
            at = number = None
            for line in _lines(repo, "blame", "--porcelain", commit, "--", f):
                if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line):
                    at, number = m[1], int(m[2])
                    people.setdefault(at, ["", ""])
                elif line.startswith("author "):
                    people[at][0] = line[7:]
                elif line.startswith("author-mail "):
                    people[at][1] = line[12:].strip("<>")
                elif line.startswith("\t"):
                    yield (repo, f, number, at, *people[at])

    return _tables(spark, repositories, "repo string, file string, line int, commit_hash string, name string, email string", rows_of)

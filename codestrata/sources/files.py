"""Source trees, archives, entity lists, rule files and git histories as DataFrames."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote_plus
from uuid import uuid4

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.parsing import LANGUAGES

#: Folders that hold no source of the repository.
SKIPPED = [".venv", "venv", ".git", "__pycache__", "node_modules", "site-packages", "chroma_db", "tests"]

ENTITY_JSON = (
    "type string, name string, unique_id string, file string, range array<int>, signature string, parameters array<struct<name:string,type_hint:string,default_value:string,is_args:boolean,is_kwargs:boolean>>, return_type string, "
    "decorators array<string>, docstring string, visibility string, throws array<string>, is_async boolean, is_generator boolean, is_method boolean, is_static boolean, is_classmethod boolean, is_property boolean, parent_class string, "
    "complexity struct<cyclomatic:int,lines_of_code:int,cognitive:int>, calls array<string>, reads_globals array<string>, writes_globals array<string>, bases array<string>, metaclass string, is_abstract boolean, is_dataclass boolean, "
    "is_protocol boolean, is_interface boolean, methods array<string>, class_variables array<string>, instance_variables array<string>, nested_classes array<string>, inheritance_depth int"
)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, language, content) of the source files under a folder; skipped folders are left out."""
    glob = "*.{" + ",".join(x[1:] for x in LANGUAGES) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.lit(Path(root).resolve().as_posix().rstrip("/") + "/")
    path = F.regexp_replace("path", r"^file:/+", "/")
    relative = F.when(path.startswith(base), F.substr(path, F.length(base) + 1)).otherwise(path)
    skipped = F.exists(F.split(relative, "/"), lambda s: s.isin(*SKIPPED))
    extension = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension]
    return raw.select(relative.alias("path"), language.alias("language"), F.decode("content", "UTF-8").alias("content")).where(~skipped)


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in z.namelist():
                if not n.endswith("/"):
                    yield n, z.read(n)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and (f := t.extractfile(m)):
                    yield m.name, f.read()


def read_archives(spark: SparkSession, glob: str) -> DataFrame:
    """(archive, path, content) of the source files in zip and tar archives, without a single top folder; unreadable archives give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for archive, data in zip(pdf["path"], pdf["content"]):
                try:
                    members = list(_members(data))
                except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError):
                    continue
                tops = {n.split("/", 1)[0] for n, _ in members}
                strip = len(tops) == 1 and all("/" in n for n, _ in members)
                for n, content in members:
                    n = n.split("/", 1)[1] if strip else n
                    if "." + n.rsplit(".", 1)[-1].lower() in LANGUAGES and not set(n.split("/")) & set(SKIPPED):
                        rows.append((archive, n, content.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "archive string, path string, content string")


def read_entities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An entity list in JSON with a fixed schema; fields of older writers are null.

    Files hold one array each, or with `lines` (as write_entities writes them) an object a line, which can be split.
    """
    return spark.read.schema(ENTITY_JSON).option("multiLine", "false" if lines else "true").json(path)


def write_entities(entities: DataFrame, path: str, form: str = "parquet") -> None:
    writer = entities.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.parquet(path)


def upsert(store: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """store with the rows of `new` in place of those of the same keys; rows without a key are left out.

    Of repeated keys in `new` the last by `order` counts (then by all columns, so that the choice never depends on the run).
    """
    known = new.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rest = [c for c in known.columns if c not in keys]
    if rest:
        packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])], *[F.col(c) for c in rest])
        last = known.groupBy(*keys).agg(F.max(packed).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    else:
        last = known.distinct()
    return store.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def read_spec(path: str) -> dict:
    """A rule file as a dict: JSON, or YAML where a reader for it is at hand."""
    text = Path(path).read_text()
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML rules needs the yaml package; JSON needs none") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def read_rules(path: str) -> tuple[dict, list, bool]:
    """(layers, rules, strict) of a rule file {layers: {name: {patterns, allowed_dependencies}}, rules: [{from, to, action}], strict_mode}, as validate_imports takes them, in the file's order."""
    spec = read_spec(path)
    layers = {n: (d.get("patterns") or [], d.get("allowed_dependencies") or []) for n, d in (spec.get("layers") or {}).items()}
    actions = {"allow": "ALLOW", "warn": "WARNING", "warning": "WARNING", "block": "BLOCK"}
    rules = []
    for r in spec.get("rules") or []:
        action = str(r.get("action", "warn")).lower()
        if action not in actions:
            raise ValueError(f"unknown action {action!r}")
        rules.append((r.get("from", ""), r.get("to", ""), actions[action]))
    return layers, rules, bool(spec.get("strict_mode", False))


def object_event(event: dict) -> list[tuple[str, str]]:
    """(bucket, key) of the objects that an upload event names: a list of records, a single detail, or the two plainly."""
    if "Records" in event:
        found = [r.get("s3", {}) for r in event["Records"]]
        pairs = [(x.get("bucket", {}).get("name"), x.get("object", {}).get("key")) for x in found]
    elif "detail" in event:
        pairs = [(event["detail"].get("bucket", {}).get("name"), event["detail"].get("object", {}).get("key"))]
    else:
        pairs = [(event.get("bucket"), event.get("key"))]
    out = [(b, unquote_plus(k)) for b, k in pairs if b and k]
    if not out:
        raise ValueError("the event names no object")
    return out


def drop_table(spark: SparkSession, path: str) -> bool:
    """Delete a written table; whether there was one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(hadoop, True)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def write_atomically(df: DataFrame, path: str) -> None:
    """Write a table beside `path` and put it there when it is whole: readers see the old one or the new one."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    fresh, old = f"{path}.new-{uuid4().hex}", f"{path}.old-{uuid4().hex}"
    df.write.parquet(fresh)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"{fresh} couldn't be renamed to {path}")
    fs.delete(at(old), True)


def read_or_set_aside(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under `path`, which is moved aside (path.broken-...) if it can't be read; an empty one where there is none."""
    fs, at = _fs(spark, path)
    if fs.exists(at(path)):
        try:
            df = spark.read.parquet(path)
            df.limit(1).collect()
            return df
        except (PySparkException, Py4JJavaError):
            fs.rename(at(path), at(f"{path}.broken-{uuid4().hex}"))
    return spark.createDataFrame([], schema)

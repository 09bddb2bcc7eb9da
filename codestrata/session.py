"""Session factory and the one place that cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "codestrata", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution, for tests and benches; a cluster passes its own session instead."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CODESTRATA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, however the driver was started.

    A worker's matrix products keep to one thread: the tasks of an executor already use all its cores.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        environment.setdefault(name, "1")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only on one machine, where it is unset (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codestrata-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, a folder for each value of `by` if given: lineage ends, and a reader of one value reads only its rows.

    It takes less room than a checkpoint, as columns are compressed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df with a reliable checkpoint in the shared folder: lineage ends, lost executors cost nothing.

    A checkpoint also keeps the constraints the optimiser inferred for its columns; in a loop they multiply until planning
    takes longer than running. The rows are therefore taken up again as a plain relation.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    try:
        plain = spark._jsparkSession.internalCreateDataFrame
        return DataFrame(plain(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
    except (AttributeError, Py4JError):  # no such method in this version: the checkpoint itself will do
        return done


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a few large files would leave most of them idle.

    Inputs with enough splits, which large ones have, are left as they are and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

"""Session defaults, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "marginalia", **conf: str) -> SparkSession:
    """A session with this library's defaults; keys of ``conf`` use ``__`` for dots and win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str, spread: bool = False) -> DataFrame:
    """One table of a data directory, with the schema its files carry.

    With ``spread`` rows of a table in fewer files than there are cores are dealt out to all of them (a small file is one task, however
    long its work); a table of many files is read as it lies.
    """
    path = f"{directory}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if spread:
        fs, p = files_of(spark, path)
        if fs.getContentSummary(p).getFileCount() < cores:
            return df.repartition(cores)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session, or a temporary one where it is unset and all runs in one process.

    On a cluster a folder of one machine would hold what its own executors wrote only, so an unset setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, hint: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = own_path(spark, hint)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for these very frames; nothing derived from them may be read any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            drop_folder(df.sparkSession, path)


def own_path(spark: SparkSession, hint: str) -> str:
    """A path of its own in the application's part of the shared folder."""
    return os.path.join(_own_folder(spark), f"{hint}-{uuid.uuid4().hex}")


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"marginalia-{spark.sparkContext.applicationId}")


def forget(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote for this application, once no frame that reads it is needed."""
    drop_folder(spark, _own_folder(spark))


def files_of(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = files_of(spark, path)
    fs.delete(p, True)

"""python -m marginalia.cli COMMAND ...: index, sync, audit, ghost, search, report, backup, warm. Each is a function of parsed arguments in COMMANDS."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import RunConfig, SearchConfig, from_environment
from marginalia.operators import pipeline, reports, search
from marginalia.operators.incremental import Manifest
from marginalia.plans import upkeep as upkeep_plans
from marginalia.session import forget, session, table
from marginalia.sources import files


def _search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs, cfg = table(spark, a.directory, "documents"), from_environment(SearchConfig)
    leg = search.LikeProvider(docs, "doc_id", F.col("file_path"), F.col("text")) if a.like else search.Bm25Provider(docs, "doc_id", F.col("text"))
    return search.hybrid(a.query, docs, "doc_id", None, leg, cfg, limit=a.limit)


def _sync(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Sections and vectors are tables of the directory; modes that change the vectors write them to ``--to``."""
    vectors = spark.read.parquet(f"{a.directory}/vectors.parquet")
    out = pipeline.sync(spark.read.parquet(f"{a.directory}/sections.parquet"), vectors, pipeline.offline_model(a.dimension), a.dimension, a.mode, a.file)
    if a.mode in ("stats", "dry-run"):
        return out
    files.write_table(out, a.to or f"{a.directory}/vectors-synced.parquet")
    return spark.read.parquet(a.to or f"{a.directory}/vectors-synced.parquet").groupBy("failed").agg(F.count("*").alias("vectors"))


def _index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    cfg = from_environment(RunConfig, sink=a.to) if a.to else from_environment(RunConfig)
    done = pipeline.index_folders(spark, [a.directory], f"{cfg.sink}/sections", Manifest(spark, f"{cfg.sink}/manifest"), cfg.glob)
    return spark.createDataFrame([(done["files"], done["sections"], "; ".join(done["errors"]))], "files int, sections int, errors string")


def _ghost(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    listed = files.read_listing(spark, a.scan) if a.scan else table(spark, a.directory, "files").select(F.col("file_path").alias("path"), F.col("file_size").alias("size"))
    known = table(spark, a.directory, "files" if a.scan else "watched_files").select(F.col("file_path" if a.scan else "path").alias("path"))
    return files.ghost_scan(listed, known, a.endings.split(",") if a.endings else None, tuple(a.excluded.split(",")) if a.excluded else ())


def _report(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return reports.prompts(table(spark, a.directory, "documents"), a.kind, "created_at", "file_path", "text")


def _backup(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return files.backup(spark, {n: table(spark, a.directory, n) for n in a.tables.split(",")}, a.to)


def _warm(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.createDataFrame([(pipeline.warm(*[table(spark, a.directory, n) for n in a.tables.split(",")]),)], "rows bigint")


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame]] = {
    "search": _search, "sync": _sync, "index": _index, "ghost": _ghost, "report": _report, "backup": _backup, "warm": _warm,
    "audit": lambda spark, a: upkeep_plans.QUERIES["audit_counts"](spark, a.directory),
    "coverage": lambda spark, a: upkeep_plans.QUERIES["sync_coverage"](spark, a.directory),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marginalia")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("directory", help="tables, or for index a folder of notes")
    parser.add_argument("query", nargs="?", default="")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--like", action="store_true", help="search substrings")
    parser.add_argument("--mode", default="stats", choices=["stats", "dry-run", "delta", "file", "full", "delete-orphans"])
    parser.add_argument("--kind", default="monthly", choices=sorted(reports.PERIODS))
    for name in ("file", "to", "scan", "endings", "excluded"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--tables", default="documents")
    parser.add_argument("--dimension", type=int, default=64)
    a = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or session()
    COMMANDS[a.command](spark, a).show(a.limit, truncate=False)
    forget(spark)


if __name__ == "__main__":
    main()

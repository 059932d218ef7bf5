"""Following files: a file stream, a keyed state per path, and batches that are processed once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators.incremental import Manifest, list_files, with_checksums
from marginalia.session import drop_folder, files_of

#: Attempts at a failing file before it is left alone until it changes.
ATTEMPTS = 5
HIDDEN = r"(^|/)\.[^/]"
#: Larger files are left alone.
MOST_BYTES = 50 * 1024 * 1024


def visible(files: DataFrame, size_col: str, most_bytes: int = MOST_BYTES, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files that are no larger than ``most_bytes`` and in no hidden or excluded folder."""
    keep = (F.col(size_col) <= most_bytes) & ~F.regexp_replace("path", "^.*?:/+", "/").rlike(HIDDEN)
    for name in excluded:
        keep = keep & ~F.col("path").contains(f"/{name}/")
    return files.where(keep)


def file_stream(spark: SparkSession, folder: str, glob: str = "*.md", most_bytes: int = MOST_BYTES, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, hash, size, modified, text) of new files below ``folder``, each path once (``observe`` sees changes too); see ``visible`` for what is left out."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    rows = visible(files, "length", most_bytes, excluded)
    return rows.select("path", F.md5("content").alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def path_states(observed: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(path, hash, status, scan_count, todo) per path and micro-batch of (path, hash, at, failed).

    ``todo`` is new, changed, retry or none. The stored hash is replaced only after it was compared, and a failure is
    tried again ``attempts`` times at most until the content changes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, count, failures = state.get if state.exists else (None, 0, 0)
        todo, status = "none", "processed"
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            count += 1
            if known is None:
                todo, failures = "new", 0
            elif row.hash != known:
                todo, failures = "changed", 0
            elif 0 < failures < attempts:
                todo = "retry"
            known = row.hash
            failures = failures + 1 if row.failed else 0
            status = "error" if row.failed else "processed"
        state.update((known, count, failures))
        yield pd.DataFrame({"path": [key[0]], "hash": [known], "status": [status], "scan_count": [count], "todo": [todo]})

    return observed.groupBy("path").applyInPandasWithState(
        run, "path string, hash string, status string, scan_count int, todo string", "hash string, scan_count int, failures int", "update", GroupStateTimeout.NoTimeout
    )


def follow(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], on_error: Callable[[int, Exception], None] | None = None, parked: str | None = None, every: str | None = None):
    """Run ``handle`` on each micro-batch of everything available, or ``every`` so often (``"30 seconds"``) for good.

    The checkpoint remembers which batches were committed; ``handle`` should write under the batch number, so that a
    repeated batch replaces its own output. If it fails, ``on_error`` is told and the batch is not committed: the query ends with the
    error and the next run gets the same batch again. With ``parked`` the failed batch's rows are written below that folder first and
    the query goes on; ``parked_rows`` gives them back, and ``retry`` runs them again. So a failing hook never loses a record.
    """

    def batch(df: DataFrame, number: int) -> None:
        try:
            handle(df, number)
        except Exception as e:  # noqa: BLE001
            if on_error is not None:
                on_error(number, e)
            if parked is None:
                raise
            # the batch number names the folder, so a repeated batch replaces its own rows
            df.withColumn("error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{parked}/failed={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def parked_batches(spark: SparkSession, parked: str) -> list[int]:
    """Numbers of the batches whose rows wait below ``parked``."""
    fs, p = files_of(spark, parked)
    return sorted(int(s.getPath().getName()[7:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("failed=")) if fs.exists(p) else []


def retry(spark: SparkSession, parked: str, handle: Callable[[DataFrame, int], None], on_error: Callable[[int, Exception], None] | None = None) -> int:
    """Run ``handle`` on every parked batch; those that succeed are removed, the others stay. The number that succeeded."""
    done = 0
    for number in parked_batches(spark, parked):
        path = f"{parked}/failed={number}"
        try:
            handle(spark.read.parquet(path).drop("error"), number)
        except Exception as e:  # noqa: BLE001
            if on_error is not None:
                on_error(number, e)
            continue
        drop_folder(spark, path)
        done += 1
    return done


def observe(spark: SparkSession, folder: str, manifest: Manifest, handle: Callable[[DataFrame, int], None], glob: str = "*.md", most_bytes: int = MOST_BYTES, excluded: tuple[str, ...] = ()) -> int | None:
    """One round of watching: hand what is new or changed below ``folder`` to ``handle`` as (path, hash, size, modified, todo) and commit it; its number, or None.

    A file stream reads a path once, so changed content under the same name never reaches it. Here each round lists the
    folder and compares it with the manifest by size, time and checksum, so changes come through; a round whose handler
    fails is not committed and comes again. ``todo`` is new or changed. Hidden and excluded folders and files beyond ``most_bytes`` are left out.
    """
    batch = manifest.log.last() + 1
    listing = visible(list_files(spark, folder, glob), "size", most_bytes, excluded)
    own = manifest.attempt()
    old = manifest.entries()
    fresh = with_checksums(manifest.unlike(listing)).where(F.col("checksum").isNotNull())
    todo = manifest.plan(fresh).join(old.select("path", F.lit("changed").alias("todo")), "path", "left")
    todo.withColumn("batch", F.lit(batch).cast("bigint")).select("path", "size", "modified", "checksum", "batch", F.coalesce("todo", F.lit("new")).alias("todo")).write.parquet(own)
    found = spark.read.parquet(own)
    if found.isEmpty():
        drop_folder(spark, own)
        return None
    handle(found.select("path", F.col("checksum").alias("hash"), "size", F.timestamp_micros("modified").alias("modified"), "todo"), batch)
    manifest.commit(batch, own)
    return batch


def watch(spark: SparkSession, folder: str, manifest: Manifest, handle: Callable[[DataFrame, int], None], seconds: float = 5.0, rounds: int | None = None, on_error: Callable[[Exception], None] | None = None, **options) -> int:
    """``observe`` every so many seconds, ``rounds`` times or for good; the number of rounds that had something. Errors are told and the round is repeated."""
    had, n = 0, 0
    while rounds is None or n < rounds:
        try:
            had += observe(spark, folder, manifest, handle, **options) is not None
        except Exception as e:  # noqa: BLE001
            if on_error is None:
                raise
            on_error(e)
        n += 1
        if rounds is None or n < rounds:
            time.sleep(seconds)
    return had

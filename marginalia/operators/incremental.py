"""Processing only new or changed records.

Two uses of one idea, an anti-join of a listing against what was committed as processed:

* ``pending_observations`` works on a log of observations and finds, for every one of them, whether the newest
  earlier commit of its key covers it. All versions are decided in one pass.
* ``Manifest`` and ``run_batch`` drive real runs over a folder: list files with size and checksum, anti-join
  against the manifest, write the output in a folder of the attempt, then commit both under the batch identifier.
* ``replay`` runs such batches over a log of observations, one after another.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from marginalia.operators.commits import CommitLog, Overtaken
from marginalia.session import drop_folder, files_of, own_path

#: An entry of a manifest; ``modified`` in microseconds since 1970.
ENTRIES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.LongType()), T.StructField("checksum", T.StringType()), T.StructField("batch", T.LongType()),
])


def hash_key(c: Column) -> Column:
    """A checksum without case, outer blanks and a leading algorithm name with colon; blank counts as null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^[a-z][a-z0-9_/.\-]*\s*:\s*", "")
    return F.when(bare != "", bare)


def instant(c: Column) -> Column:
    """Microseconds since 1970 of a time written as ISO date-time or bare seconds; null if unreadable.

    A time without offset is UTC. ``T`` or blank between date and time, comma or point before the fraction,
    ``Z``, ``UTC`` or ``GMT``, offsets with and without colon are understood.
    """
    s = F.regexp_replace(F.upper(c), r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(\d),(\d)", "$1.$2"), r"\s*(?:UTC|GMT|Z)$", "Z")
    s = F.regexp_replace(s, r"(:\d\d(?:\.\d+)?)\s*([+-]\d\d):?(\d\d)?$", "$1$2:$3")
    s = F.regexp_replace(s, r"([+-]\d\d):$", "$1:00")
    s = F.regexp_replace(s, r"(\.\d{6})\d+", "$1")
    number = s.rlike(r"^[+-]?\d+(\.\d*)?$")
    offset = s.rlike(r"(Z|:\d\d(\.\d+)?[+-]\d\d:\d\d)$")
    date = s.rlike(r"^\d{4}-\d\d-\d\d$")
    iso = F.when(offset, s).when(date, F.concat(s, F.lit("T00:00:00Z"))).otherwise(F.concat(s, F.lit("Z")))
    seconds = F.when(number, s).try_cast("decimal(28,6)")
    return F.when(number, (seconds * 1_000_000).cast("bigint")).otherwise(F.unix_micros(F.when(~number, iso).try_cast("timestamp")))


def last_before(df: DataFrame, key: str, version: str, value: Column, out: str, span: int = 64) -> DataFrame:
    """For each row, the last non-null ``value`` of the same key at a smaller version, or null.

    Versions are cut into blocks of ``span``. Windows run within (key, block); the last value of each block, one
    row per key and block, is carried to the later blocks. So a key with a third of all rows is spread over as
    many tasks as it has blocks. ``value`` must be the same for all rows of a key and version that have one, or
    the greatest is taken.
    """
    blocked = df.withColumn("__block", F.floor(F.col(version) / F.lit(span))).withColumn("__value", value)
    inner = W.partitionBy(key, "__block").orderBy(version).rangeBetween(W.unboundedPreceding, -1)
    local = blocked.withColumn(
        "__local", F.max(F.when(F.col("__value").isNotNull(), F.struct(F.col(version).alias("v"), F.col("__value").alias("x")))).over(inner)
    )
    ends = (
        blocked.where(F.col("__value").isNotNull())
        .groupBy(key, "__block")
        .agg(F.max(F.struct(F.col(version).alias("v"), F.col("__value").alias("x"))).alias("__end"))
    )
    # blocks of the key that have rows, each with the end of the nearest earlier block that has a value
    blocks = blocked.select(key, "__block").distinct().join(ends, [key, "__block"], "left")
    carried = blocks.withColumn(
        "__carry", F.max("__end").over(W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    ).select(key, "__block", "__carry")
    return (
        local.join(carried, [key, "__block"], "left")
        .withColumn(out, F.coalesce(F.col("__local"), F.col("__carry"))["x"])
        .drop("__block", "__value", "__local", "__carry")
    )


def pending_observations(
    seen: DataFrame,
    key: str = "path",
    version: str = "scan_id",
    checksum: str = "file_hash",
    modified: str = "modified_at",
    committed: Column | None = None,
) -> DataFrame:
    """The observations that an incremental run at their version must process, with the reason.

    The manifest of a version holds, per key, the newest earlier observation that was committed. An observation is
    ``new`` without a manifest entry, ``changed`` if both checksums are present and differ, or if one is missing and
    its modification instant is later than the entry's. Statuses other than committed neither enter the manifest
    nor hide a change, so failures, crashes and wrong skips lose nothing and a commit repeats nothing.

    Result: key, version, reason; one row for each key and version. Nulls: rows without key or version are dropped;
    a missing or unreadable instant on either side is no change; blank checksums are missing. Repeated rows count
    once. If a version has several differing rows of one key, it is pending when any of them is, and its manifest
    entry is the one with the latest instant. An empty input gives an empty result.
    """
    committed = F.lower(F.trim(F.col("status"))) == "processed" if committed is None else committed
    rows = seen.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(
        F.col(key).alias("__key"),
        F.col(version).cast("bigint").alias("__version"),
        hash_key(F.col(checksum)).alias("__hash"),
        instant(F.col(modified)).alias("__at"),
        F.coalesce(committed, F.lit(False)).alias("__done"),
    ).distinct()
    entry = F.when(F.col("__done"), F.struct(F.col("__at"), F.col("__hash")))
    manifest = last_before(rows, "__key", "__version", entry, "__entry")
    old = F.col("__entry")
    both = F.col("__hash").isNotNull() & old["__hash"].isNotNull()
    reason = (
        F.when(old.isNull(), "new")
        .when(both & (F.col("__hash") != old["__hash"]), "changed")
        .when(~both & (F.col("__at") > old["__at"]), "changed")
    )
    return (
        manifest.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .groupBy(F.col("__version").alias(version), F.col("__key").alias(key))
        .agg(F.max("reason").alias("reason"))
    )


# ---- runs


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) of every file below ``folder``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def with_checksums(files: DataFrame) -> DataFrame:
    """Add the MD5 of each file's content, read in pieces where the row is; null for a file that is gone."""
    names = files.columns

    def run(batches):
        import hashlib
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            sums = []
            for path in b.column(names.index("path")).to_pylist():
                try:
                    place = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith("file:") else fs.FileSystem.from_uri(quote(path, safe=":/@"))
                    sum_ = hashlib.md5()
                    with place[0].open_input_stream(place[1]) as f:
                        while piece := f.read(1 << 20):
                            sum_.update(piece)
                    sums.append(sum_.hexdigest())
                except FileNotFoundError:
                    sums.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], [*names, "checksum"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("checksum", T.StringType())]))


class Manifest:
    """Committed inputs of a pipeline.

    Each run writes the entries it has processed into a folder of its own; the commit (see ``CommitLog``), made after the run's
    output is complete, names that folder. So a reader sees a batch wholly or not at all, a run that dies leaves
    nothing that counts, and of two overlapping runs the later one's commit fails without touching the first one's files.
    Every ``every`` commits the newest entries of all paths are written as a snapshot, so that reading needs so many folders at most.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 8):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every
        self.log = CommitLog(spark, f"{self.folder}/log")

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        return self.log.numbers()

    def entries(self) -> DataFrame:
        """The newest committed entry of each path."""
        folders = []
        for n in reversed(self.log.numbers()):
            found = self.log.get(n)
            folders += [found["entries"]] if found["entries"] else []
            if "snapshot" in found:
                folders.append(found["snapshot"])
                break
        if not folders:
            return self.spark.createDataFrame([], ENTRIES)
        rows = self.spark.read.schema(ENTRIES).parquet(*folders)
        fields = [f for f in ENTRIES.names if f not in ("path", "batch")]
        # of differing entries of one path and batch the one with the latest time counts, then the greatest checksum
        order = F.struct("batch", "modified", "checksum")
        return rows.groupBy("path").agg(F.max_by(F.struct("batch", *fields), order).alias("e")).select("path", *[f"e.{f}" for f in [*fields, "batch"]])

    def unlike(self, listing: DataFrame) -> DataFrame:
        """Files of the listing whose path, size and time no committed entry has."""
        return listing.dropDuplicates(["path"]).join(self.entries(), ["path", "size", "modified"], "left_anti")

    def plan(self, listing: DataFrame) -> DataFrame:
        """Files of the listing (with checksum) that no committed entry covers: new paths, and paths with another size or checksum."""
        return listing.dropDuplicates(["path"]).join(self.entries(), ["path", "size", "checksum"], "left_anti")

    def attempt(self) -> str:
        """A folder for one run's entries."""
        return f"{self.folder}/attempts/{uuid.uuid4().hex}"

    def commit(self, batch: int, entries: str | None, **more: str) -> None:
        """Commit the entries written to a folder as batch ``batch``; ``Overtaken`` if another run has."""
        what = {"entries": entries, **more}
        if batch % self.every == 0:
            what["snapshot"] = f"{self.attempt()}/snapshot"
            self.entries().write.parquet(what["snapshot"])
        self.log.commit(batch, what)


def run_batch(
    spark: SparkSession, source: str, sink: str, manifest: Manifest, transform: Callable[[DataFrame], DataFrame], glob: str = "*", trust_times: bool = True, tries: int = 5
) -> int | None:
    """Process what is new or changed below ``source``; the committed batch number, or None if nothing was.

    The listing has names, sizes and times; only files that differ from their entry in one of these are read for their checksum
    (all of them with ``trust_times=False``), and files whose size and checksum are known are left out. ``transform`` gets the rest (path, size, modified, checksum) and
    returns the rows to write, into a folder of this attempt. Then the manifest is committed under the number after the last one seen at
    the start. A run that dies before leaves no commit and is repeated. If another run commits in between, this run's output
    is dropped and it plans again, so no record is processed twice or lost. Readers take ``committed_output``.
    """
    sink = sink.rstrip("/")
    for _ in range(tries):
        batch = manifest.log.last() + 1
        own = manifest.attempt()
        listing = list_files(spark, source, glob)
        read = with_checksums(manifest.unlike(listing) if trust_times else listing).where(F.col("checksum").isNotNull())
        manifest.plan(read).withColumn("batch", F.lit(batch).cast("bigint")).select(*ENTRIES.names).write.parquet(f"{own}/plan")
        files = spark.read.schema(ENTRIES).parquet(f"{own}/plan").drop("batch")
        if files.isEmpty():
            drop_folder(spark, own)
            return None
        output = f"{sink}/attempt={own.rsplit('/', 1)[1]}"
        try:
            transform(files).write.parquet(output)
            manifest.commit(batch, f"{own}/plan", output=output)
            return batch
        except Overtaken:
            drop_folder(spark, output)
            drop_folder(spark, own)
    raise Overtaken(f"other runs committed {tries} times in between")


def committed_output(spark: SparkSession, sink: str, manifest: Manifest) -> DataFrame | None:
    """Rows of the committed batches, with their number in column ``batch``; None before the first commit."""
    done = [(manifest.log.get(n)["output"], n) for n in manifest.batches()]
    if not done:
        return None
    rows = spark.read.option("basePath", sink.rstrip("/")).parquet(*[p for p, _ in done])
    numbers = spark.createDataFrame([(p.rsplit("=", 1)[1], n) for p, n in done], "attempt string, batch bigint")
    return rows.join(F.broadcast(numbers), "attempt").drop("attempt")  # one row for each batch


def replay(
    seen: DataFrame, key: str = "path", version: str = "scan_id", checksum: str = "file_hash", size: str = "size", modified: str = "modified_at", committed: Column | None = None, span: int = 8
) -> DataFrame:
    """(key, version, reason): what an incremental pipeline had to process at each version, by running it over the log of its observations.

    The observations of a version are one listing; a run takes ``span`` listings in their order, as if that many had come since the last run. It
    joins them with the manifest as committed by the runs before (and, for a listing, what the log says was processed in the run's earlier
    ones), writes what no entry covers and the new entries into a folder of its own, and commits both. An observation is ``new`` without an entry,
    ``changed`` if both checksums are present and differ, or if one is missing and its time is later than the entry's. Statuses
    other than processed enter no manifest, so failures, crashes and wrong skips lose nothing. Rules for nulls, repeated and differing rows
    are those of ``pending_observations``, which decides all versions in one pass and gives the same rows. The driver loops over version
    numbers only.
    """
    spark = seen.sparkSession
    committed = F.lower(F.trim(F.col("status"))) == "processed" if committed is None else committed
    folder = own_path(spark, "runs")
    seen.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(
        F.col(version).cast("bigint").alias("batch"), F.col(key).alias("path"), F.col(size).cast("bigint").alias("size"), instant(F.col(modified)).alias("modified"),
        hash_key(F.col(checksum)).alias("checksum"), F.coalesce(committed, F.lit(False)).alias("done"),
    ).write.partitionBy("batch").parquet(f"{folder}/listings")
    fs, p = files_of(spark, f"{folder}/listings")
    versions = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch="))
    shape = T.StructType([*ENTRIES.fields, T.StructField("done", T.BooleanType())])
    manifest = Manifest(spark, f"{folder}/manifest")
    outputs = []
    for at in range(0, len(versions), span):
        own = manifest.attempt()
        listings = spark.read.schema(shape).option("basePath", f"{folder}/listings").parquet(*[f"{folder}/listings/batch={v}" for v in versions[at : at + span]])
        entry = F.struct("batch", "modified", "checksum")
        old = manifest.entries().select("path", entry.alias("committed"))
        earlier = W.partitionBy("path").orderBy("batch").rangeBetween(W.unboundedPreceding, -1)
        run = listings.withColumn("inside", F.max(F.when(F.col("done"), entry)).over(earlier)).join(old, "path", "left")
        known = F.coalesce("inside", "committed")
        both = F.col("checksum").isNotNull() & known["checksum"].isNotNull()
        reason = F.when(known.isNull(), "new").when(both & (F.col("checksum") != known["checksum"]), "changed").when(~both & (F.col("modified") > known["modified"]), "changed")
        kinds = F.array_compact(F.array(F.when(F.col("reason").isNotNull(), "pending"), F.when(F.col("done"), "entry")))
        run.withColumn("reason", reason).select(*ENTRIES.names, "reason", F.explode(kinds).alias("kind")).write.partitionBy("kind").parquet(own)
        there = {s.getPath().getName() for s in fs.listStatus(files_of(spark, own)[1])}
        manifest.commit(manifest.log.last() + 1, f"{own}/kind=entry" if "kind=entry" in there else None, output=f"{own}/kind=pending")
        outputs += [f"{own}/kind=pending"] if "kind=pending" in there else []
    if not outputs:
        return spark.createDataFrame([], f"`{version}` bigint, `{key}` string, reason string")
    rows = spark.read.schema("path string, reason string, batch bigint").parquet(*outputs)
    # repeated rows of a listing are one record; of its reasons the greatest counts
    return rows.groupBy(F.col("batch").alias(version), F.col("path").alias(key)).agg(F.max("reason").alias("reason"))

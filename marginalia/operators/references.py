"""References to records that do not exist: one-pass classification and incrementally kept state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.commits import CommitLog, Overtaken  # noqa: F401
from marginalia.operators.skew import skew_join
from marginalia.session import own_path, release, stored

REFS = "id bigint, ref_table string, key string, period string, at timestamp_ntz"
INDEX = "ref_table string, key string, live boolean, born timestamp_ntz, undated boolean, removed boolean"
REF_COLUMNS, INDEX_COLUMNS = ([c.split(" ")[0] for c in ddl.split(", ")] for ddl in (REFS, INDEX))


def ref_key(c: Column) -> Column:
    """An identifier without case, blanks and hyphens; null if nothing is left."""
    bare = F.regexp_replace(F.lower(c), r"[\s\-]+", "")
    return F.when(bare != "", bare)


def references(records: DataFrame, columns: dict[str, str], id_col: str = "id", at: str = "created_at") -> DataFrame:
    """One row per distinct record and non-blank reference; ``columns`` maps parent table to referring column."""
    period = F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))
    pairs = F.array(*[F.struct(F.lit(t).alias("ref_table"), ref_key(F.col(c)).alias("key")) for t, c in columns.items()])
    rows = records.select(F.col(id_col).cast("bigint").alias("id"), F.explode(pairs).alias("r"), period.alias("period"), F.col(at).cast("timestamp_ntz").alias("at"))
    return rows.select("id", "r.ref_table", "r.key", "period", "at").where(F.col("key").isNotNull()).distinct()


def parent_events(parents: dict[str, tuple[DataFrame, str, str]], removals: DataFrame | None) -> DataFrame:
    """Index rows of ``parents`` (table: frame, id column, birth column) and of a removal log (ref_table, ref_id)."""
    out = None
    for name, (df, key, born) in parents.items():
        part = df.select(
            F.lit(name).alias("ref_table"), ref_key(F.col(key)).alias("key"), F.lit(True).alias("live"),
            F.col(born).cast("timestamp_ntz").alias("born"), F.col(born).isNull().alias("undated"), F.lit(False).alias("removed"),
        )
        out = part if out is None else out.unionByName(part)
    if removals is not None:
        gone = removals.select(
            F.lower(F.trim("ref_table")).alias("ref_table"), ref_key(F.col("ref_id")).alias("key"), F.lit(False).alias("live"),
            F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(False).alias("undated"), F.lit(True).alias("removed"),
        )
        out = gone if out is None else out.unionByName(gone)
    return fold(out.where(F.col("key").isNotNull() & F.col("ref_table").isNotNull()))


def fold(index: DataFrame) -> DataFrame:
    """One index row per key: live if any is, the earliest birth, removed if any says so."""
    return index.groupBy("ref_table", "key").agg(
        F.max("live").alias("live"), F.min("born").alias("born"), F.max("undated").alias("undated"), F.max("removed").alias("removed")
    )


def classify(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Probe the parent index: id, ref_table, key, period, at, reason (null where the reference is in order).

    ``deleted``: no live parent and the log names the key; ``missing``: no live parent and it doesn't; ``late``: the
    parent was born after the referring record. With a null time on either side a live parent is in order. A key
    that many references share is split (``skew_join``).
    """
    joined = skew_join(refs, index, ["ref_table", "key"], "left")
    live = F.coalesce(F.col("live"), F.lit(False))
    reason = (
        F.when(~live & F.coalesce(F.col("removed"), F.lit(False)), "deleted")
        .when(~live, "missing")
        .when(~F.coalesce(F.col("undated"), F.lit(False)) & (F.col("born") > F.col("at")), "late")
    )
    return joined.select("id", "ref_table", "key", "period", "at", reason.alias("reason"))


def orphans(records: DataFrame, columns: dict[str, str], parents: dict[str, tuple[DataFrame, str, str]], removals: DataFrame | None) -> DataFrame:
    """Orphan references as (id, ref_table, period, reason), each once.

    Null and blank references are no case; repeated rows count once; a null time gives the period ``unknown``;
    empty tables give an empty result, an empty parent table makes every reference to it an orphan. Other columns
    are ignored, whatever their names.
    """
    found = classify(references(records, columns), parent_events(parents, removals)).where(F.col("reason").isNotNull())
    return found.select("id", "ref_table", "period", "reason").distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """The report: references by parent table, period and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("refs"))


class OrphanState:
    """Keyed state that follows references, parents and removals batch by batch: the parent index and the references that wait.

    Both are logs of changes. A batch appends, in a folder of its own, the index rows of the keys it touches and the
    references whose state it changes (with their reason, or null where they wait no longer); the commit that names the folder is made
    last and is never replaced (see ``CommitLog``), so a batch that dies leaves the state as it was and is applied again, and
    of two overlapping batches the later one's commit fails. Of several rows of a key those of the newest batch count. Every ``every`` batches the logs are
    written anew without what was replaced, so reading needs so many folders at most.
    References in order are not kept: a removal looks for those it reopens in ``known``, the table of all references so far.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 8):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every
        self.log = CommitLog(spark, f"{self.folder}/log")

    def _read(self, kind: str, schema: str, upto: int, *more: str) -> DataFrame:
        folders = list(more)
        for n in range(upto, 0, -1):
            found = self.log.get(n)
            folders.append(f"{found['folder']}/{kind}")
            if "merged" in found:
                folders.append(f"{found['merged']}/{kind}")
                break
        shape = T.StructType.fromDDL(schema + ", batch bigint")
        return self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)

    def _index(self, upto: int, *more: str) -> DataFrame:
        fields = [c for c in INDEX_COLUMNS if c not in ("ref_table", "key")]
        rows = self._read("index", INDEX, upto, *more).groupBy("ref_table", "key").agg(F.max_by(F.struct(*fields), "batch").alias("v"))
        return rows.select("ref_table", "key", *[f"v.{c}" for c in fields])

    def _refs(self, upto: int) -> DataFrame:
        rows = self._read("refs", REFS + ", reason string", upto)
        return rows.groupBy("id", "ref_table", "key", "period", "at").agg(F.max_by("reason", "batch").alias("reason")).where(F.col("reason").isNotNull())

    def apply(self, refs: DataFrame, arrived: DataFrame, removed: DataFrame, known: DataFrame | None = None) -> int:
        """Take a batch: removed keys and arrived parents (both ``INDEX``), then new references (``REFS``); the batch's number.

        The removals of a batch come before its arrivals. ``known`` (``REFS``) has the references of earlier
        batches; it is read only if there are removals, and without it a removal reopens waiting references only.
        Repeating a batch changes nothing. New references probe the index, arriving parents resolve or reclassify the
        waiting ones, removals reopen.
        """
        done = self.log.last()
        batch, own = done + 1, f"{self.folder}/batches/{uuid.uuid4().hex}"
        number = F.lit(batch).cast("bigint").alias("batch")
        lost = removed.select("ref_table", "key").distinct()
        ends = removed.withColumn("live", F.lit(False)).withColumn("removed", F.lit(True))
        touched = fold(arrived.select(*INDEX_COLUMNS).unionByName(ends.select(*INDEX_COLUMNS)))
        if done:  # with what the index knew of these keys; a removal ends their life, an arrival begins one
            old = self._index(done).join(touched.select("ref_table", "key"), ["ref_table", "key"], "left_semi")
            old = old.join(lost.withColumn("__lost", F.lit(True)), ["ref_table", "key"], "left").withColumn("live", F.col("live") & F.col("__lost").isNull())
            touched = fold(touched.unionByName(old.select(*INDEX_COLUMNS)))
        touched.select(*INDEX_COLUMNS, number).write.parquet(f"{own}/index")
        fresh = refs.select(*REF_COLUMNS)
        if done:
            changed = self.spark.read.schema(INDEX).parquet(f"{own}/index").select("ref_table", "key")
            fresh = fresh.unionByName(skew_join(self._refs(done).select(*REF_COLUMNS), changed, ["ref_table", "key"], "left_semi"))
        if known is not None and not lost.isEmpty():
            fresh = fresh.unionByName(skew_join(known.select(*REF_COLUMNS), lost, ["ref_table", "key"], "left_semi"))
        fresh = stored(fresh.distinct(), "references")
        found = classify(fresh, self._index(done, f"{own}/index"))
        if not done:  # nothing waits yet, so references in order need no row
            found = found.where(F.col("reason").isNotNull())
        found.select(*REF_COLUMNS, "reason", number).write.parquet(f"{own}/refs")
        release(fresh)
        what = {"folder": own}
        if batch % self.every == 0:
            what["merged"] = f"{own}/merged"
            self._index(done).withColumn("batch", F.lit(done).cast("bigint")).write.parquet(f"{own}/merged/index")
            self._refs(done).withColumn("batch", F.lit(done).cast("bigint")).write.parquet(f"{own}/merged/refs")
        self.log.commit(batch, what)
        return batch

    def waiting(self) -> DataFrame:
        """References that are orphans now."""
        return self._refs(self.log.last())

    def snapshot(self) -> DataFrame:
        """Counts by table, period and reason."""
        return orphan_counts(self.waiting().select("id", "ref_table", "period", "reason").distinct())


def followed(records: DataFrame, columns: dict[str, str], parents: dict[str, tuple[DataFrame, str, str]], removals: DataFrame | None, batches: int = 2) -> OrphanState:
    """The state after the records, parents and removals have come in ``batches`` slices of time.

    Slices are bounded by quantiles of the records' times. What was removed is known from the start (a row that is there counts more than
    the log), records and parents without a time come first. A reference waits until the batch that brings its parent.
    """
    spark = records.sparkSession
    refs = stored(references(records, columns), "all")
    bounds = refs.agg(F.percentile_approx(F.unix_micros(F.col("at").cast("timestamp")), [i / batches for i in range(1, batches)])).first()[0] or []
    part = lambda c: sum((F.coalesce((F.unix_micros(c.cast("timestamp")) > b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
    index = stored(parent_events(parents, None), "parents")
    gone = parent_events({}, removals) if removals is not None else index.limit(0)
    state = OrphanState(spark, own_path(spark, "orphans"))
    for i in range(batches):
        state.apply(refs.where(part(F.col("at")) == i), index.where(part(F.col("born")) == i), gone if i == 0 else index.limit(0))
    release(refs, index)
    return state

"""Runs over notes and stores: indexing with hooks, embedding runs, synchronisation, jobs, batches with error rows."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.errors import RunFailed
from marginalia.functions import text as X
from marginalia.operators import markdown, upkeep
from marginalia.operators.commits import CommitLog
from marginalia.operators.incremental import Manifest, committed_output, run_batch

#: A hook: gets the event (``indexed``, ``removed``, ``complete``) and the rows concerned.
Hook = Callable[[str, DataFrame], None]


def call_hooks(hooks: list[Hook], event: str, rows: DataFrame) -> list[str]:
    """Call every hook; one that fails does not keep the others from being called. The errors."""
    errors = []
    for hook in hooks:
        try:
            hook(event, rows)
        except Exception as e:  # noqa: BLE001
            errors.append(f"{getattr(hook, '__name__', hook)}: {str(e)[:500]}")
    return errors


# ---- indexing


def index_notes(notes: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Section rows of notes (path, section_no, level, header, lines, content, preview, word_count, file_hash)."""
    rows = markdown.with_section_fields(markdown.sections(notes, path_col, text_col))
    return rows.join(notes.select(path_col, F.md5(text_col).alias("file_hash")), path_col) if text_col in notes.columns else rows


def reindex(index: DataFrame, stored: DataFrame, current: DataFrame, scope: str | None = None, hooks: list[Hook] | None = None, path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, dict]:
    """The index after a look at the notes as they are: untouched notes keep their rows, new and changed ones are cut anew, removed ones go.

    ``stored`` has (path, hash) of what is indexed, ``current`` the notes. Removals stay below ``scope``. Repeating a run changes nothing. The
    figures: updated, removed, same notes and hook errors.
    """
    fresh = current.select(path_col, text_col, F.md5(text_col).alias("hash"))
    plan = upkeep.delta_plan(stored, fresh, path_col, "hash", scope)
    gone = plan.where("action IN ('changed', 'removed')").select(path_col)
    cut = index_notes(fresh.drop("hash").join(plan.where("action IN ('new', 'changed')").select(path_col), path_col, "left_semi"), path_col, text_col)
    out = index.join(gone, path_col, "left_anti").unionByName(cut.select(*index.columns))
    counts = {r[0]: r[1] for r in plan.groupBy("action").count().collect()}  # four actions at most
    errors = call_hooks(hooks or [], "indexed", cut) + call_hooks(hooks or [], "removed", plan.where("action = 'removed'").select(path_col)) + call_hooks(hooks or [], "complete", out)
    return out, {"updated": counts.get("new", 0) + counts.get("changed", 0), "removed": counts.get("removed", 0), "same": counts.get("same", 0), "errors": errors}


def index_folders(spark: SparkSession, roots: list[str], sink: str, manifest: Manifest, glob: str = "*.md", hooks: list[Hook] | None = None) -> dict:
    """Index new and changed notes below several roots, each by a run of its own; the added figures of all."""
    total = {"files": 0, "sections": 0, "errors": []}

    def cut(files: DataFrame) -> DataFrame:
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots).select("path", F.decode("content", "UTF-8").alias("content"))
        return markdown.with_section_fields(markdown.sections(texts.join(files.select("path"), "path", "left_semi"), "path", "content"))

    for root in roots:
        number = run_batch(spark, root, sink, manifest, cut, glob)
        if number is not None:
            done = committed_output(spark, sink, manifest).where(F.col("batch") == number)
            row = done.agg(F.countDistinct("path"), F.count("*")).first()
            total["files"] += row[0]
            total["sections"] += row[1]
            total["errors"] += call_hooks(hooks or [], "indexed", done)
    return total


# ---- vectors


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The vector table after new rows replaced those of their keys; of several new rows of a key the greatest ``mark`` counts."""
    return upkeep.upsert_latest(old, new, [key], [F.col("mark")])


def delete_vectors(vectors: DataFrame, ids: DataFrame | None = None, files: DataFrame | None = None, key: str = "id", file_col: str = "file_id") -> DataFrame:
    """The vector table without rows of these ids or of these files."""
    if ids is not None:
        vectors = vectors.join(ids.select(key).distinct(), key, "left_anti")
    if files is not None:
        vectors = upkeep.cascade(files, vectors, file_col)
    return vectors


def embed(rows: DataFrame, model: Callable[[Column], Column], dim: int) -> DataFrame:
    """(id, file_id, mark, embedding, failed) of rows (id, file_id, text, mark); a text the model has no vector for gets zeros and is marked."""
    vector = model(F.col("text"))
    return rows.select("id", "file_id", "mark", vector.alias("v")).select("id", "file_id", "mark", X.or_zeros(F.col("v"), dim).alias("embedding"), F.col("v").isNull().alias("failed"))


def offline_model(dim: int = 64) -> Callable[[Column], Column]:
    """The deterministic embedding of hashed words, for use without a model."""
    return lambda text: F.when(text.isNotNull(), X.hashed_vector(X.words(text), dim))


def embedding_run(sections: DataFrame, vectors: DataFrame, model: Callable[[Column], Column], dim: int, mode: str = "incremental") -> DataFrame:
    """The vector table (id, file_id, mark, embedding, failed) after a run over sections (id, file_id, header, content, keywords).

    ``full`` embeds every section whose text has more than 10 characters and keeps vectors of others; ``reload`` starts from an empty table;
    ``incremental`` embeds only sections whose text has no vector of its own mark, or a failed one. The mark is the hash of the embedded text.
    """
    text = X.embedding_text(F.col("header"), F.col("content"), F.col("keywords"))
    rows = sections.where(F.length("content") > 10).select("id", "file_id", text.alias("text")).withColumn("mark", F.substring(F.md5("text"), 1, 16)).distinct()
    if mode == "reload":
        return embed(rows, model, dim)
    if mode == "incremental":
        rows = rows.join(vectors.where(~F.col("failed")).select("id", "mark"), ["id", "mark"], "left_anti")
    elif mode != "full":
        raise ValueError(f"no mode {mode}")
    return upsert_vectors(vectors, embed(rows, model, dim).select(*vectors.columns))


def queue_once(events: DataFrame, at: str = "at", lateness: str = "1 hour") -> DataFrame:
    """Requests to embed, each file once: on a stream within the watermark, else over all rows the earliest."""
    if events.isStreaming:
        return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["file_id"])
    return events.groupBy("file_id").agg(F.min(at).alias(at))


# ---- synchronisation


def sync_plan(sections: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """(key, action) for sections (key, mark) and vectors (key, mark): embed, update, delete or keep. Of repeated keys the greatest mark counts."""
    one = lambda df, n: df.groupBy(key).agg(F.max("mark").alias(n), F.lit(True).alias(f"has_{n}"))
    both = one(sections, "here").join(one(vectors, "there"), key, "full_outer")
    action = F.when(F.col("has_there").isNull(), "embed").when(F.col("has_here").isNull(), "delete").when(F.col("here").eqNullSafe(F.col("there")), "keep").otherwise("update")
    return both.where(F.col(key).isNotNull()).select(key, action.alias("action"))


def sync(sections: DataFrame, vectors: DataFrame, model: Callable[[Column], Column], dim: int, mode: str = "stats", file: str | None = None) -> DataFrame:
    """Bring the vector table in line with the sections (see ``embedding_run`` for their columns).

    ``stats`` counts the plan's actions, ``dry-run`` lists them; ``delta`` embeds what is missing or outdated and deletes orphans, ``file`` does so for
    one file, ``full`` embeds everything anew, ``delete-orphans`` only deletes. The last four give the new table.
    """
    if mode == "full":
        return embedding_run(sections, vectors, model, dim, "reload")
    if mode == "file":
        rest = vectors.where(~F.col("file_id").eqNullSafe(F.lit(file)))
        mine = sync(sections.where(F.col("file_id") == file), vectors.where(F.col("file_id") == file), model, dim, "delta")
        return rest.unionByName(mine.select(*rest.columns))
    if mode in ("delta", "delete-orphans"):
        kept = vectors.join(sections.where(F.length("content") > 10).select("id").distinct(), "id", "left_semi")
        return kept if mode == "delete-orphans" else embedding_run(sections, kept, model, dim, "incremental")
    text = X.embedding_text(F.col("header"), F.col("content"), F.col("keywords"))
    wanted = sections.where(F.length("content") > 10).select(F.col("id").alias("key"), F.substring(F.md5(text), 1, 16).alias("mark"))
    plan = sync_plan(wanted, vectors.select(F.col("id").alias("key"), "mark"))
    if mode == "dry-run":
        return plan
    if mode == "stats":
        return plan.groupBy("action").agg(F.count("*").alias("n"))
    raise ValueError(f"no mode {mode}")


def postings_status(docs: DataFrame, postings: DataFrame, key: str, length: Column) -> DataFrame:
    """(status, n) of the documents against the inverted table: in_sync, missing (not in it), stale (another length), orphan (only in it)."""
    there = postings.groupBy(F.col(key).alias("__key")).agg(F.max("length").alias("__n"))
    here = docs.select(F.col(key).alias("__key"), length.alias("__len")).where(F.col("__len") > 0)
    both = here.join(there, "__key", "full_outer")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__len").isNull(), "orphan").when(F.col("__n") == F.col("__len"), "in_sync").otherwise("stale")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---- batches and jobs


def in_batches(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, each: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Rows of ``work`` over Arrow batches, with columns ``schema`` and ``error`` (added if ``schema`` lacks it). A batch that fails is done row by row (by ``each``, else ``work``), so only the
    rows that fail themselves are error rows: their columns are null but for those the input has under the same name and type."""
    fields = T.StructType([f for f in T.StructType.fromDDL(schema) if f.name != "error"])
    shared = [f.name for f in fields if dict(df.dtypes).get(f.name) == f.dataType.simpleString()]

    def failed(part: pd.DataFrame, e: Exception) -> pd.DataFrame:
        return pd.DataFrame({n: part[n].values if n in shared else [None] * len(part) for n in fields.names}).assign(error=str(e)[:500])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield work(pdf)[fields.names].assign(error=None)
            except Exception:  # noqa: BLE001
                for i in range(len(pdf)):
                    part = pdf.iloc[i : i + 1]
                    try:
                        yield (each or work)(part)[fields.names].assign(error=None)
                    except Exception as e:  # noqa: BLE001
                        yield failed(part, e)

    return df.mapInPandas(run, T.StructType([*fields.fields, T.StructField("error", T.StringType())]))


def rates(rows: DataFrame, group: list[str], ok: Column) -> DataFrame:
    """(group, total, success, failed, rate): the share that succeeded in percent, null statuses as failures."""
    good = F.coalesce(ok, F.lit(False))
    return rows.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), F.round(100 * F.count_if(good) / F.count("*"), 4).alias("rate"))


def recent_errors(log: DataFrame, job: str, error: str, at: str, n: int = 5) -> DataFrame:
    """(job, errors, last_error, last_at, recent): how often a job failed, its newest error and the newest ``n``, cut to what is stored. Jobs without errors have no row."""
    bad = log.where(F.col(error).isNotNull()).select(F.col(job), X.cut(F.col(error), "error").alias("e"), F.col(at).alias("t"))
    top = bad.groupBy(job, "e").agg(F.max("t").alias("t"), F.count("*").alias("k"))  # as many rows per job as it has different errors
    last = F.sort_array(F.collect_list(F.struct("t", "e")), False)
    return top.groupBy(job).agg(F.sum("k").alias("errors"), last.alias("l")).select(
        job, "errors", F.get("l", F.lit(0))["e"].alias("last_error"), F.get("l", F.lit(0))["t"].alias("last_at"), F.array_join(F.transform(F.slice("l", 1, n), lambda x: x["e"]), " | ").alias("recent"))


def due(minutes: DataFrame, at: str, jobs: dict[str, str], last: dict[str, dt.datetime] | None = None, apart: int = 120) -> DataFrame:
    """(minute, job): the jobs whose cron fields match a minute and which have not run less than ``apart`` seconds before (``last``)."""
    from marginalia.operators.knowledge import cron_matches

    out = None
    for name, spec in jobs.items():
        part = minutes.where(cron_matches(F.col(at), spec))
        if last and name in last:
            part = part.where(F.col(at) >= F.lit(last[name] + dt.timedelta(seconds=apart)).cast(dict(minutes.dtypes)[at]))
        part = part.select(F.col(at).alias("minute"), F.lit(name).alias("job"))
        out = part if out is None else out.unionByName(part)
    return out


def with_retries(run: Callable[[], object], attempts: int = 3, delay: float = 1.0, wait: Callable[[float], None] = time.sleep):
    """The result of ``run``; after a failure it is tried again, each time after twice the delay. ``RunFailed`` with the last error in the end."""
    for attempt in range(attempts):
        try:
            return run()
        except Exception as e:  # noqa: BLE001
            if attempt == attempts - 1:
                raise RunFailed(f"{attempts} attempts failed: {e}") from e
            wait(delay * 2**attempt)


class SyncState:
    """Times of the last synchronisation by name, kept as commits (``CommitLog``), so that two runs never overwrite each other's."""

    def __init__(self, spark: SparkSession, folder: str):
        self.log = CommitLog(spark, folder)

    def last(self, name: str) -> dt.datetime | None:
        for n in reversed(self.log.numbers()):
            if self.log.get(n)["name"] == name:
                return dt.datetime.fromisoformat(self.log.get(n)["at"])
        return None

    def set(self, name: str, at: dt.datetime) -> None:
        self.log.commit(self.log.last() + 1, {"name": name, "at": at.isoformat()})


@dataclass
class Engines:
    """Generators by name. A generator maps a frame of prompts (id, prompt) to (id, answer); ``primary`` is used by default."""

    known: dict[str, Callable[[DataFrame], DataFrame]]
    primary: str

    def register(self, name: str, engine: Callable[[DataFrame], DataFrame]) -> None:
        self.known[name] = engine

    def run(self, prompts: DataFrame, strategy: str = "primary_first", second: str | None = None) -> DataFrame:
        """(id, answer, engine) by strategy: ``primary_first`` asks the second engine only what the first left unanswered, ``aggregate`` joins
        both answers, ``compare`` gives a row for each engine with an answer."""
        first = self.known[self.primary](prompts).select("id", F.col("answer").alias("a"))
        if second is None:
            return first.where(F.col("a").isNotNull()).select("id", F.col("a").alias("answer"), F.lit(self.primary).alias("engine"))
        other = self.known[second](prompts if strategy != "primary_first" else prompts.join(first.where(F.col("a").isNotNull()), "id", "left_anti")).select("id", F.col("answer").alias("b"))
        both = first.join(other, "id", "full_outer")
        if strategy == "primary_first":
            return both.where("a IS NOT NULL OR b IS NOT NULL").select("id", F.coalesce("a", "b").alias("answer"), F.when(F.col("a").isNotNull(), self.primary).otherwise(second).alias("engine"))
        if strategy == "aggregate":
            return both.where("a IS NOT NULL OR b IS NOT NULL").select("id", F.concat_ws("\n\n", "a", "b").alias("answer"), F.concat_ws("+", F.when(F.col("a").isNotNull(), self.primary), F.when(F.col("b").isNotNull(), second)).alias("engine"))
        if strategy == "compare":
            pair = F.array(F.struct(F.col("a").alias("answer"), F.lit(self.primary).alias("engine")), F.struct(F.col("b").alias("answer"), F.lit(second).alias("engine")))
            return both.select("id", F.explode(pair).alias("x")).select("id", "x.answer", "x.engine").where(F.col("answer").isNotNull())
        raise ValueError(f"no strategy {strategy}")


def schema_issues(df: DataFrame, wanted: dict[str, str]) -> list[tuple[str, str]]:
    """(column, issue) where a table lacks a column or has it in another type."""
    there = dict(df.dtypes)
    return [(c, "missing" if c not in there else f"{there[c]} instead of {t}") for c, t in wanted.items() if there.get(c) != t]


def warm(*tables: DataFrame) -> int:
    """Keep tables in memory and disk of the executors for the searches to come; how many rows they have in all."""
    return sum(df.persist().count() for df in tables)

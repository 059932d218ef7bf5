"""Keeping stores consistent: deltas, upserts, orphans, ghosts, conflicts, audits and job state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import safe_name
from marginalia.operators.skew import skew_join


def delta_plan(stored: DataFrame, current: DataFrame, key: str = "path", mark: str = "hash", scope: str | None = None) -> DataFrame:
    """(key, action) with action new, changed, same or removed.

    Rows are compared by their mark, null-safe. With ``scope`` only stored keys that are that folder or below it can be removed, so a run
    over one root leaves the others alone. Of several rows of a key the one with the greatest mark counts.
    """
    one = lambda df, n: df.groupBy(key).agg(F.max(mark).alias(f"__{n}"), F.lit(True).alias(f"__has_{n}"))
    old, new = one(stored, "old"), one(current, "new")
    both = old.join(new, key, "full_outer")
    action = F.when(F.col("__has_old").isNull(), "new").when(F.col("__has_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    out = both.select(key, action.alias("action"))
    if scope is None:
        return out
    folder = scope.rstrip("/")
    return out.where((F.col("action") != "removed") | (F.col(key) == folder) | F.col(key).startswith(folder + "/"))


def apply_delta(old: DataFrame, fresh: DataFrame, plan: DataFrame, key: str = "path") -> DataFrame:
    """The table after the plan: untouched rows of ``old`` and the rows of ``fresh`` for new and changed keys."""
    touched = plan.where("action <> 'same'").select(key)
    rebuilt = fresh.join(plan.where("action IN ('new', 'changed')").select(key), key, "left_semi")
    return old.join(touched, key, "left_anti").unionByName(rebuilt)


def cascade(parents_gone: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent was not removed."""
    return skew_join(children, parents_gone.select(key).distinct(), [key], "left_anti")


def without_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with a key that no parent has; null keys refer to nothing and are left out."""
    return skew_join(children.where(F.col(key).isNotNull()), parents.select(key).distinct(), [key], "left_anti")


def missing_and_orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ``missing`` in the right store, ``orphan`` in it without a left one."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("orphan")))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """INSERT OR REPLACE: the last row of each key in ``order``, rows of ``new`` before those of ``old``.

    ``max_by`` over a struct: partial maxima are built before the shuffle, so a key with many rows is no hot task.
    """
    columns = old.columns
    both = old.select(*columns, F.lit(0).alias("__new")).unionByName(new.select(*columns, F.lit(1).alias("__new")))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("__new", *order)).alias("__r"))
    return last.select("__r.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR IGNORE; of several new rows of a key the greatest (column by column) is inserted."""
    rest = [c for c in old.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else new.select(*keys).distinct()
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert_counter(old: DataFrame, seen: DataFrame, key: str, counter: str = "scan_count") -> DataFrame:
    """ON CONFLICT DO UPDATE: the counter grows by how often the key was seen, new keys start there."""
    n = seen.groupBy(key).agg(F.count("*").alias("__n"))
    return old.select(key, F.col(counter).alias("__c")).join(n, key, "full_outer").select(key, (F.coalesce("__c", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias(counter))


def conflict_plan(kb: DataFrame, vault: DataFrame, last_sync: Column, strategy: str = "keep_both") -> DataFrame:
    """(title, action) for both sides' entries (title, modified), matched ignoring case.

    Both changed after the last sync: what the strategy says (kb_wins, vault_wins, keep_both, manual); on one side only:
    insert or kb_to_vault; else vault_to_kb. Of entries with equal titles the newest counts.
    """
    side = lambda df, n: df.groupBy(F.lower("title").alias("title")).agg(F.max("modified").alias(n))
    both = side(kb, "k").join(side(vault, "v"), "title", "full_outer")
    clash = {"kb_wins": "kb_to_vault", "vault_wins": "vault_to_kb", "keep_both": "keep_both", "manual": "manual"}[strategy]
    action = F.when(F.col("k").isNull(), "insert").when(F.col("v").isNull(), "kb_to_vault").when((F.col("k") > last_sync) & (F.col("v") > last_sync), clash).otherwise("vault_to_kb")
    return both.select("title", action.alias("action"), safe_name(F.col("title")).alias("file_name"))


def issues(df: DataFrame, checks: list[tuple[str, str, Column]], id_col: str) -> DataFrame:
    """(issue, severity, id) for every row and check that fails; one pass over the rows."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, c in checks]))
    return df.select(F.col(id_col).cast("string").alias("id"), F.explode(failed).alias("i")).select("i.issue", "i.severity", "id")


def job_state(log: DataFrame, job: str, status: str, at: str, unique: str) -> DataFrame:
    """(job, runs, failed, last_status): counts and the status of the newest run, ties by the greatest ``unique``."""
    return log.groupBy(job).agg(
        F.count("*").alias("runs"), F.count_if(F.col(status).isin("error", "failed")).alias("failed"), F.max_by(status, F.struct(at, unique)).alias("last_status")
    )

"""A log of numbered commits, each of which appears whole or not at all and belongs to one writer."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from marginalia.session import files_of

# Schemes of object stores, where an object appears as a whole when its writer closes it and a rename is a copy.
OBJECT_STORES = set("s3 s3a s3n gs abfs abfss wasb wasbs oss cosn obs".split())


class Overtaken(RuntimeError):
    """Another run has committed this number."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``; False, and nothing changed, if it is there already.

    Local files are linked under their name, which fails if the name is taken. Elsewhere a finished hidden file is
    renamed without overwriting, which HDFS does atomically. On object stores the object is created
    without overwriting: there two writers are kept apart only if the store's connector makes that conditional
    (as S3A does with ``fs.s3a.create.conditional.enabled``).
    """
    fs, to = files_of(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(to.getParent())
    scheme = fs.getUri().getScheme()
    if scheme == "file":
        target = unquote(urlparse(str(to)).path) if "://" in str(to) else str(to).removeprefix("file:")
        hidden = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(hidden, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(hidden, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
        return True
    taken = jvm.java.lang.Class.forName("org.apache.hadoop.fs.FileAlreadyExistsException")
    try:
        if scheme in OBJECT_STORES:
            _write(fs, to, text)
        else:
            _, hidden = files_of(spark, f"{to.getParent()}/.{uuid.uuid4().hex}")
            _write(fs, hidden, text)
            try:
                plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                FILE_CONTEXT.of(spark, fs).rename(hidden, to, plain)
            finally:
                fs.delete(hidden, False)
    except Exception as e:  # noqa: BLE001
        cause = getattr(e, "java_exception", None)
        if (cause is not None and taken.isInstance(cause)) or (cause is None and fs.exists(to)):
            return False
        raise
    return True


class FILE_CONTEXT:
    """Renames that never replace."""

    @staticmethod
    def of(spark: SparkSession, fs):
        return spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())


def _write(fs, path, text: str) -> None:
    out = fs.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()


class CommitLog:
    """Commits 1, 2, ... of a folder; each is a small JSON object that names what its writer wrote.

    Writers work in folders of their own and name them in the commit, so an attempt that failed or was overtaken
    never touches what another one committed; its folder is merely never named.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._seen: dict[int, dict] = {}

    def numbers(self) -> list[int]:
        fs, p = files_of(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[7:]) for n in names if n.startswith("commit-"))

    def last(self) -> int:
        return max(self.numbers(), default=0)

    def get(self, number: int) -> dict:
        """A commit's object; commits never change, so each is read once."""
        if number not in self._seen:
            fs, p = files_of(self.spark, f"{self.folder}/commit-{number:012d}")
            reader = self.spark.sparkContext._jvm.java.io.BufferedReader(self.spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
            try:
                self._seen[number] = json.loads(reader.readLine())
            finally:
                reader.close()
        return self._seen[number]

    def commit(self, number: int, what: dict) -> None:
        """Commit under ``number``, the one after the last; ``Overtaken`` if another run did."""
        if not put_if_absent(self.spark, f"{self.folder}/commit-{number:012d}", json.dumps(what)):
            raise Overtaken(f"commit {number} was made by another run")
        self._seen[number] = what

"""Readers of note folders and documents, and writers of results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import SourceError
from marginalia.functions.text import cut, essence_body, file_category, frontmatter_text, safe_name, suffix
from marginalia.operators.markdown import body, front_fields
from marginalia.session import drop_folder, files_of, stored

HIDDEN = r"(^|/)\.[^/]"


def read_notes(spark: SparkSession, *roots: str, glob: str = "*.md", since: str | None = None) -> DataFrame:
    """(path, name, content, size, modified, hash, lines) of all notes below the roots, hidden folders left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if since:
        reader = reader.option("modifiedAfter", since)
    files = reader.load(list(roots)).where(~F.regexp_replace("path", "^[a-z]+:/+", "/").rlike(HIDDEN))
    text = F.decode("content", "UTF-8")
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("content"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.md5("content").alias("hash"), F.size(F.split(text, "\n")).alias("lines"), file_category(F.col("path")).alias("category"),
    )


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of every file below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"))


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """Notes with their frontmatter as a map, title and body; a note without title is named by its file."""
    n = read_notes(spark, root).withColumn("front", front_fields(F.col("content")))
    return n.withColumn("title", F.coalesce(F.try_element_at("front", F.lit("title")), F.regexp_replace("name", r"\.md$", ""))).withColumn("body", body(F.col("content")))


def read_essences(spark: SparkSession, root: str) -> DataFrame:
    """Summaries from ``essence.json`` files; unreadable ones have null fields."""
    schema = (
        "version string, source_hash string, source_path string, extracted_at string, model string, essence struct<title:string,summary:string,key_points:array<string>,"
        "entities:array<string>,relationships:array<struct<from:string,to:string,type:string>>,keywords:array<string>,confidence:double>"
    )
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "essence.json").json(root)
    return rows.withColumn("extracted_at", F.try_to_timestamp("extracted_at"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page_no, text) of (path, content); needs pypdf on the workers. An unreadable file gives one row with page 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, p.extract_text() or "") for i, p in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string")


def ocr_pages(images: DataFrame, languages: str = "deu+eng", seconds: int = 60) -> DataFrame:
    """(path, text) of (path, content) by the tesseract program, where it is installed; else a null text. One task per partition of images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import shutil
        import subprocess

        there = shutil.which("tesseract")
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                try:
                    done = subprocess.run([there, "stdin", "stdout", "-l", languages, "--psm", "6"], input=content, capture_output=True, timeout=seconds) if there else None
                    texts.append(done.stdout.decode("utf-8", "replace") if done else None)
                except subprocess.TimeoutExpired:
                    texts.append(None)
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return images.select("path", "content").mapInPandas(run, "path string, text string")


def needs_ocr(text, least: int = 5):
    """Whether extracted text has fewer than ``least`` words of four letters or more."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{L}{4,})"), F.lit(1))) < least


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite", form: str = "parquet") -> None:
    """Write parquet, json or csv; csv has a header."""
    writer = df.write.mode(mode).format(form)
    if form == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition) if partition else writer).save(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save as a table bucketed and sorted by ``key``, so that later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_notes(df: DataFrame, folder: str, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Write each row as a file below ``folder``; (path, written) with paths outside refused.

    A file is written under a hidden name, synced and renamed, so a reader sees the old text or the new one and a task that runs again replaces its
    own work. The files are written where the rows are: ``folder`` must be one that all executors share (a mounted path), which on a cluster is the
    caller's to see to. An action of its own: the result is what was written.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid
        from pathlib import Path

        root = Path(folder.removeprefix("file://")).resolve()
        for pdf in batches:
            done = []
            for path, text in zip(pdf[path_col], pdf[text_col]):
                to = None if path is None or "\x00" in str(path) else (root / str(path)).resolve()
                ok = to is not None and root in to.parents
                if ok:
                    to.parent.mkdir(parents=True, exist_ok=True)
                    hidden = to.parent / f".{uuid.uuid4().hex}"
                    with open(hidden, "w", encoding="utf-8") as f:
                        f.write(text or "")
                        f.flush()
                        os.fsync(f.fileno())
                    os.replace(hidden, to)
                done.append(ok)
            yield pd.DataFrame({"path": pdf[path_col], "written": done})

    return stored(df.mapInPandas(run, "path string, written boolean"), "written")


# Endings of files that may be worth adding, and of images that can be read.
KNOWN = (".pdf .txt .md .html .xml .doc .docx .odt .rtf .epub .mobi .azw3 .jpg .jpeg .png .tiff .webp .py .sh .js .ts .java .c .cpp .go .json .yaml .yml .csv .tsv .log .rst .tex").split()
PICTURES = ".jpg .jpeg .png .tiff .tif .webp .bmp".split()


def ghost_scan(listing: DataFrame, known: DataFrame, endings: list[str] | None = None, excluded: tuple[str, ...] = (), least: int = 0, most: int | None = None, path_col: str = "path", size_col: str = "size") -> DataFrame:
    """(path, size) of listed files that are not known, by ending (``KNOWN`` by default), outside excluded folders and within the sizes; null paths are left out."""
    ending = F.concat(F.lit("."), suffix(F.col(path_col)))
    keep = ending.isin([e.lower() for e in (KNOWN if endings is None else endings)]) & (F.col(size_col) >= least)
    if most is not None:
        keep = keep & (F.col(size_col) <= most)
    for name in excluded:
        keep = keep & ~F.concat(F.lit("/"), F.col(path_col)).contains(f"/{name}/")
    return listing.where(keep).select(F.col(path_col).alias("path"), F.col(size_col).alias("size")).distinct().join(known.select(F.col(path_col).alias("path")), "path", "left_anti")


def images(spark: SparkSession, folder: str, endings: list[str] | None = None) -> DataFrame:
    """(path, content) of the images below ``folder``, by their endings (``PICTURES`` by default)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.concat(F.lit("."), suffix(F.col("path"))).isin(PICTURES if endings is None else endings)).select("path", "content")


def ocr_documents(pages: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(path, pages, text) of page images (path, page_no, content): pages are read each by itself, over all tasks, and put together in their order.

    ``read`` is the engine: it maps (path, content) to (path, text), by default ``ocr_pages``; pages it has no text for are empty.
    """
    named = pages.select(F.concat_ws("\u0001", "path", F.col("page_no").cast("string")).alias("path"), "content")
    texts = (read or ocr_pages)(named).select(F.split("path", "\u0001").alias("p"), "text").select(F.col("p")[0].alias("path"), F.col("p")[1].cast("int").alias("page_no"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))["text"]
    return texts.groupBy("path").agg(F.count("*").alias("pages"), F.array_join(ordered, "\n\n").alias("text"))


def first_engine(*engines: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An engine that asks each given one in turn for the pages that those before it have no text for."""

    def read(files: DataFrame) -> DataFrame:
        left, out = files, None
        for engine in engines:
            got = stored(engine(left).select("path", "text").where(F.trim(F.coalesce("text", F.lit(""))) != ""), "read")
            out = got if out is None else out.unionByName(got)
            left = left.join(got.select("path"), "path", "left_anti")
        return out.unionByName(left.select("path", F.lit(None).cast("string").alias("text")))

    return read


def drop_folder_stream(spark: SparkSession, folder: str, archive: str, glob: str = "*.md") -> DataFrame:
    """(path, text) of the files that are put into a drop folder; once they are processed Spark moves them below ``archive``."""
    reader = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", glob)
    return reader.option("cleanSource", "archive").option("sourceArchiveDir", archive).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class Incoming:
    """A folder that files wait in: what waits, adding to it and clearing it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def waiting(self) -> DataFrame:
        """(path, size, modified), oldest first; contents are not read."""
        fs, p = files_of(self.spark, self.folder)
        if not fs.exists(p):
            return self.spark.createDataFrame([], "path string, size bigint, modified timestamp")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("modified", "path")

    def add(self, path: str) -> str:
        """Copy a file into the folder; its path there. A file of the same name is not replaced."""
        fs, source = files_of(self.spark, path)
        to_fs, to = files_of(self.spark, f"{self.folder}/{source.getName()}")
        if to_fs.exists(to):
            raise SourceError(f"{to} is there already")
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, to, False, self.spark.sparkContext._jsc.hadoopConfiguration())
        return str(to)

    def clear(self) -> None:
        drop_folder(self.spark, self.folder)


def export_json(df: DataFrame, path: str, name: str = "files") -> None:
    """One JSON object {timestamp, count, <name>: path of the rows}, beside the rows as JSON lines: the list itself may be of any length."""
    rows = f"{path}/{name}"
    df.write.mode("overwrite").json(rows)
    n = df.sparkSession.read.json(rows).count() if df.columns else 0
    head = df.sparkSession.range(1).select(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(n).alias("count"), F.lit(rows).alias(name))).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def append_log(df: DataFrame, path: str, error_col: str = "error") -> None:
    """Append rows to a log, with the time they were logged at; errors are cut to what is stored."""
    out = df.withColumn("logged_at", F.current_timestamp())
    if error_col in df.columns:
        out = out.withColumn(error_col, cut(F.col(error_col), "error"))
    out.write.mode("append").parquet(path)


def audit_lines(counts: DataFrame) -> DataFrame:
    """(line): an audit's counts (severity, issue, n) as the lines of a Markdown table, worst first; a row per issue, however many records have it."""
    rank = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    return counts.select(rank.alias("r"), "issue", F.concat(F.lit("| "), "severity", F.lit(" | "), "issue", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line")).orderBy("r", "issue").select("line")


def essence_notes(essences: DataFrame) -> DataFrame:
    """(path, content) of two files for each summary (hash, title, summary, key_points, connections, contradictions, questions): its Markdown and its JSON."""
    items = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    text = F.concat(F.lit("---\ntitle: "), F.to_json(F.array("title")).substr(F.lit(2), F.length(F.to_json(F.array("title"))) - 2), F.lit("\nhash: "), "hash", F.lit("\n---\n\n# "), "title", F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n"),
                    items(F.col("key_points")), F.lit("\n\n"), essence_body(none("connections"), none("contradictions"), none("questions")), F.lit("\n"))
    whole = F.to_json(F.struct(*[c for c in essences.columns]))
    both = F.array(F.struct(F.concat("hash", F.lit("/essence.md")).alias("path"), text.alias("content")), F.struct(F.concat("hash", F.lit("/essence.json")).alias("path"), whole.alias("content")))
    return essences.select(F.explode(both).alias("f")).select("f.path", "f.content")


def graph_files(nodes: DataFrame, edges: DataFrame, folder: str) -> dict[str, int]:
    """Write a graph as JSON lines of nodes and of edges; how many there are of each."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").json(f"{folder}/{name}")
    spark = nodes.sparkSession
    return {name: spark.read.text(f"{folder}/{name}").count() for name in ("nodes", "edges")}


def note_exports(entries: DataFrame, vault: DataFrame, title: str = "title", text: str = "content") -> DataFrame:
    """(path, content) of entries that the vault (titles) lacks by their file name, as notes with frontmatter; of equal file names the greatest title counts."""
    name = lambda df: df.where(F.col(title).isNotNull()).select(safe_name(F.col(title)).alias("name"), *([F.struct(title, text).alias("e")] if df is entries else []))
    there = name(vault).select(F.lower("name").alias("k")).distinct()
    rows = name(entries).withColumn("k", F.lower("name")).join(there, "k", "left_anti").groupBy("k").agg(F.max(F.struct("e", "name")).alias("r"))
    front = F.create_map(F.lit("title"), F.to_json(F.array(F.col(f"r.e.{title}"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(f"r.e.{title}")))) - 2))
    return rows.select(F.concat("r.name", F.lit(".md")).alias("path"), F.concat(frontmatter_text(front), F.lit("\n"), F.coalesce(F.col(f"r.e.{text}"), F.lit(""))).alias("content"))


def report_markdown(title: str, front: dict[str, str], lines: list[str]) -> str:
    """A report's file: frontmatter, title and body."""
    return "---\n" + "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in front.items()) + f"---\n\n# {title}\n\n" + "\n".join(lines) + "\n"


def backup(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Copy tables below ``folder``; (table, rows) as read back from the copy."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    counts = [(name, spark.read.parquet(f"{folder}/{name}").count()) for name in tables]
    return spark.createDataFrame(counts, "table string, rows bigint")

"""Files as tables: discovery with ignore rules, size caps before content, lenient text, JSON lines.

A folder is listed where the job starts - names and sizes only, folders that are ruled out aren't
entered - and the files that are left are read by the executors, each once.  Spark's own readers
can't be used for source trees: they leave out names that begin with a dot or an underscore.
Any file system that Arrow knows by its address will do.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, glob_regex, ignore_lines, ignored, language, plain_path

# Paths that are never indexed.
EXCLUDED = (
    "*.min.js", "vendor/**", "node_modules/**", "*.lock", "*.generated.*", "__pycache__/**", "*.pyc", ".git/**", "*.Designer.vb", "*.Designer.cs",
    "**/My Project/**", "**/Web References/**", "**/Crystal Reports Backup Files/**",
)

#: Bytes of text after which a reader hands on what it has.
BATCH = 8 << 20


def decoded(content: Column) -> Column:
    """Text of bytes; what isn't UTF-8 becomes a replacement character, a byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


class Rules:
    """Ignore rules in order: the last that matches decides, ``!`` takes in again, those of a deeper folder come later."""

    def __init__(self, patterns: list[str]):
        self.rules: list[tuple[str, re.Pattern, bool]] = []
        self.add("", patterns)

    def add(self, folder: str, patterns: list[str]) -> None:
        for p in patterns:
            self.rules.append((f"{folder}/" if folder else "", re.compile(glob_regex(p.lstrip("!"))), not p.startswith("!")))

    def ignored(self, path: str) -> bool:
        for folder, rule, out in reversed(self.rules):
            if path.startswith(folder) and rule.search(path[len(folder) :]):
                return out
        return False


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(root))


def listing(root: str, patterns: list[str], ignore_files: tuple[str, ...], wanted: Callable[[str], bool]) -> list[tuple[str, int]]:
    """(path below root, bytes) of the files that are wanted and not ignored; ignore files count in their own folder and below."""
    from pyarrow import fs

    system, base = _file_system(root.rstrip("/"))
    rules, out, todo = Rules(patterns), [], [""]
    while todo:
        folder = todo.pop(0)
        found = sorted(system.get_file_info(fs.FileSelector(posixpath.join(base, folder) if folder else base)), key=lambda f: f.base_name)
        for name in ignore_files:  # in the order of the settings
            for f in found:
                if f.base_name == name and f.is_file:
                    with system.open_input_file(f.path) as stream:
                        rules.add(folder, ignore_lines(stream.read().decode("utf-8", "replace")))
        for f in found:
            path = f"{folder}/{f.base_name}" if folder else f.base_name
            if f.type == fs.FileType.Directory:
                if f.base_name != ".git" and not rules.ignored(path):
                    todo.append(path)
            elif wanted(path) and not rules.ignored(path):
                out.append((path, f.size))
    return out


def read_files(spark: SparkSession, root: str, files: list[tuple[str, int]]) -> DataFrame:
    """(file_path, length, hash, text) of files below root, read by the executors; hash is the SHA-256 of the bytes."""
    schema = "file_path string, length bigint, hash string, text string"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(root.rstrip("/"))
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["file_path", "length", "hash", "text"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_file(posixpath.join(base, path)) as stream:
                        raw = stream.read()
                except OSError:
                    continue  # gone since it was listed
                rows.append((path, len(raw), hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace").removeprefix("﻿")))
                size += len(raw)
                if size > BATCH:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    parts = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4, sum(n for _, n in files) // BATCH + 1))
    return spark.createDataFrame(files, "file_path string, length bigint").repartition(parts).select("file_path").mapInArrow(run, schema)


def suffix(path: str) -> str:
    m = re.search(r"[^.](\.[^.]+)$", path.rsplit("/", 1)[-1])
    return m[1].lower() if m else ""


def discover(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = 2_000_000, repo: str = "", ignore_files: tuple[str, ...] = (".gitignore", ".indexignore")) -> DataFrame:
    """(repo, file_path, length, hash, text) of the files below root that are code, not excluded and not too large (0: any size)."""
    found = listing(root, [*EXCLUDED, *(patterns or [])], ignore_files, lambda p: suffix(p) in LANGUAGES)
    kept = [(p, n) for p, n in found if not max_bytes or n <= max_bytes]
    return read_files(spark, root, kept).select(F.lit(repo).alias("repo"), "file_path", "length", "hash", "text")


def documents_below(spark: SparkSession, root: str, globs: tuple[str, ...], patterns: list[str] | None = None, ignore_files: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, hash, text) of the documents that any glob takes, each once."""
    any_of = re.compile("|".join(f"(?:{glob_regex(g)})" for g in globs))
    found = listing(root, patterns or [], ignore_files, lambda p: bool(any_of.search(p)))
    return read_files(spark, root, found).select("file_path", "hash", "text")


def code_of(paths: DataFrame, patterns: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Of a landed listing (file_path) what is code and not excluded, paths in one spelling, with language."""
    p = paths.withColumn("file_path", plain_path(F.col("file_path"))).filter(~ignored(F.col("file_path"), list(patterns)))
    return p.withColumn("language", language(F.col("file_path"))).filter("language is not null")


def documents_of(paths: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """Of a landed listing (file_path) the documents that any glob takes, each once."""
    p = paths.withColumn("file_path", plain_path(F.col("file_path")))
    return p.filter(F.col("file_path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))).distinct()


def sized(df: DataFrame, text: str, most: int) -> DataFrame:
    """Rows whose text has at most so many bytes, without a byte order mark."""
    return df.filter(F.octet_length(text) <= most).withColumn(text, decoded(F.col(text)))


def json_lines(spark: SparkSession, path: str, modified_after: str | None = None, names: str = "*.jsonl") -> DataFrame:
    """(file, block, line_no, entry VARIANT) of the lines that are JSON; files older than modified_after aren't opened.

    A file of any size is read in splits; (block, line_no) grow along it.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    m = F.col("_metadata")
    lines = reader.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line_no"), F.try_parse_json("value").alias("entry"))
    return lines.filter("entry is not null")

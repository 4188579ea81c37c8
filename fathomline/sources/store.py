"""Chunks and state on any file system: segments that are only ever added, and tombstones.

    rows/segment=<n>/collection=<name>/   what one merge brought
    gone/segment=<n>/                     keys whose rows in earlier segments are dead
    <derived>/segment=<n>/collection=<name>/bucket=<b>/   what is computed from the rows of a segment
    commits/<n>                           the segment counts; <n>.base: and those before it don't

A merge writes its own rows and the keys of those it replaces, a delete keys alone: neither
rewrites what is there.  Readers take committed segments and leave out rows with a tombstone
in a later segment, so a run that dies leaves the old state, and started again it writes the
same.  ``compact`` folds all segments into one; a merge does it by itself once there are
``compact_at``.  Routing a query to collections prunes partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import lookup

#: Partitions of a derived table by the hash of its term.
BUCKETS = 16


class ChunkStore:
    """derived: name -> (schema, rows -> table with the key, collection and bucket)."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, key: str = "chunk_id", compact_at: int = 32, derived: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None):
        self.spark, self.root, self.key, self.compact_at = spark, root.rstrip("/"), key, compact_at
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.names = self.schema.fieldNames()
        self.derived = derived or {}

    # ---- files

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _remove(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def segments(self) -> list[int]:
        """Segments that count, in order."""
        marks = self._names("commits")
        base = max((int(m.removesuffix(".base")) for m in marks if m.endswith(".base")), default=0)
        return sorted({int(m.removesuffix(".base")) for m in marks} - {n for n in range(base)})

    def _next(self) -> int:
        used = [int(x.partition("=")[2]) for t in ("rows", "gone", *self.derived) for x in self._names(t) if x.startswith("segment=")]
        return max([*used, *[int(m.removesuffix(".base")) for m in self._names("commits")]], default=0) + 1

    def _commit(self, n: int, base: bool = False) -> None:
        fs, path = self._path(f"commits/{n}{'.base' if base else ''}")
        fs.mkdirs(path)

    def _load(self, table: str, schema: T.StructType, segments: list[int]) -> DataFrame:
        """Rows of a table with their segment."""
        there = set(self._names(table))
        paths = [f"{self.root}/{table}/segment={n}" for n in segments if f"segment={n}" in there]
        full = T.StructType([*schema.fields, T.StructField("segment", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*paths)

    # ---- reading

    def _gone(self, segments: list[int]) -> DataFrame | None:
        if not any(f"segment={n}" in self._names("gone") for n in segments):
            return None
        return self._load("gone", T.StructType([self.schema[self.key], T.StructField("collection", T.StringType())]), segments)

    def _alive(self, df: DataFrame, segments: list[int]) -> DataFrame:
        gone = self._gone(segments)
        if gone is None:
            return df
        g = gone.groupBy("collection", self.key).agg(F.max("segment").alias("segment"))
        return df.join(g, (df[self.key] == g[self.key]) & (df["collection"] == g["collection"]) & (df["segment"] < g["segment"]), "left_anti")

    def read(self, *collections: str) -> DataFrame:
        """Rows of the given collections, of all without one; a collection that isn't there has none."""
        segments = self.segments()
        df = self._load("rows", self.schema, segments)
        df = df.filter(F.col("collection").isin(*collections)) if collections else df
        return self._alive(df, segments).select(*self.names)

    def read_derived(self, name: str, *collections: str, where: Column | None = None) -> DataFrame:
        """Rows of a derived table; where is applied to the scan."""
        segments, schema = self.segments(), T._parse_datatype_string(self.derived[name][0])
        df = self._load(name, schema, segments)
        df = df.filter(F.col("collection").isin(*collections)) if collections else df
        df = df.filter(where) if where is not None else df
        return self._alive(df, segments).select(*schema.fieldNames())

    def get(self, ids: DataFrame, *collections: str) -> DataFrame:
        """Rows by id."""
        return lookup(self.read(*collections), ids, self.key)

    def count(self) -> DataFrame:
        return self.read().groupBy("collection").agg(F.count("*").alias("n_chunks"))

    # ---- writing

    def _add(self, n: int, rows: DataFrame) -> DataFrame:
        """Writes a segment's rows and what is derived from them; the rows as written."""
        rows.select(*self.names).hint("rebalance", "collection").write.mode("overwrite").partitionBy("collection").parquet(f"{self.root}/rows/segment={n}")
        new = self._load("rows", self.schema, [n]).drop("segment")
        for name, (schema, compute) in self.derived.items():
            table = compute(new).select(*T._parse_datatype_string(schema).fieldNames())
            table.hint("rebalance", "collection", "bucket").sortWithinPartitions("collection", "bucket", "term").write.mode("overwrite").partitionBy("collection", "bucket").parquet(f"{self.root}/{name}/segment={n}")
        return new

    def merge(self, new: DataFrame) -> None:
        """Puts rows in by id, in place of rows with the same id; of equal ids in new one is taken."""
        n, old = self._next(), self.segments()
        rows = self._add(n, new.select(*self.names).dropDuplicates([self.key, "collection"]))
        if old:
            keys = rows.select(self.key, "collection")
            stale = self.read().select(self.key, "collection").join(keys, [self.key, "collection"], "left_semi")
            self._bury(n, stale)
        self._commit(n)
        if len(self.segments()) > self.compact_at:
            self.compact()

    def _bury(self, n: int, keys: DataFrame) -> None:
        keys.select(self.key, "collection").write.mode("overwrite").parquet(f"{self.root}/gone/segment={n}")

    def delete(self, ids: DataFrame) -> None:
        """Takes rows out by (collection, id); ids that aren't there change nothing."""
        if not self.segments():
            return
        n = self._next()
        self._bury(n, self.read().select(self.key, "collection").join(ids.select(self.key, "collection").distinct(), [self.key, "collection"], "left_semi"))
        self._commit(n)

    def drop(self, collection: str) -> None:
        for table in ("rows", *self.derived):
            for segment in self._names(table):
                self._remove(f"{table}/{segment}/collection={collection}")

    def compact(self) -> None:
        """All rows alive in one segment; dead files go."""
        n = self._next()
        self._add(n, self.read())
        self._commit(n, base=True)
        for table in ("rows", "gone", *self.derived):
            for segment in self._names(table):
                if segment != f"segment={n}":
                    self._remove(f"{table}/{segment}")
        for mark in self._names("commits"):
            if mark != f"{n}.base":
                self._remove(f"commits/{mark}")

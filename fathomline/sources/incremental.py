"""Processing only new or changed records: a manifest of inputs, idempotent batches, a commit at the end.

``Ledger`` keeps three things on any file system Spark can reach:

    manifest/<batch>   one row per input file that a committed batch has processed:
                       path, size, modified, checksum
    output/batch=<id>  what the batch wrote
    pending            the id of a run that has begun and isn't committed

A run (``Ledger.run``)
 1. lists the input files (the file listing only, no content),
 2. anti-joins the listing against the manifest by path, size and time, and computes a
    checksum of the content of the files left only; files whose checksum is known
    (rewritten or touched, but equal) drop out,
 3. takes the id of a run that died before, or else a new one, and overwrites the output of that id -
    whatever arrived in between, the records of the dead run are written once,
 4. commits the manifest rows of the batch.
Whatever dies before 4 leaves the manifest as it was; nothing is skipped or repeated.  ``output``
reads batches that are in the manifest, never one that was left behind.

``seen_edits`` and ``due`` decide on records: what committed batches have seen of a record, and whether new versions
of it are newer.  ``due_records`` is both at once, for sources that keep their own cut-off.

Defined results: an empty listing, or one without news, is an empty batch that is not
committed; a file that vanished stays in the manifest; a null record key is no record;
repeated rows count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import tidied, written

FILE = "path string, size bigint, modified timestamp, checksum bigint, rows bigint"
#: Pending files named in a filter, which prunes the listing; more are joined.
NAMED = 10_000


def row_hash(df: DataFrame) -> Column:
    """A checksum of a row over all its columns, equal for equal rows in any session."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def listing(df: DataFrame) -> DataFrame:
    """(path, size, modified) of the files behind df, from the file system; no content is read."""
    files = df.inputFiles()
    m = F.col("_metadata")
    names = [m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified")]
    if not files:
        return df.sparkSession.createDataFrame([], "path string, size bigint, modified timestamp")
    return df.sparkSession.read.format("binaryFile").load(files).select(*names)


def of_files(df: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """Rows of df out of the n files (path)."""
    if n <= NAMED:
        return df.filter(F.col("_metadata.file_path").isin([r[0] for r in files.select("path").collect()]))
    named = df.withColumn("__path", F.col("_metadata.file_path"))
    return named.join(files.select(F.col("path").alias("__path")), "__path", "left_semi").drop("__path")


def checksums(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (path, size, modified) with a checksum of their rows, whatever the order, and their number."""
    m = F.col("_metadata")
    found = of_files(df, candidates, candidates.count())
    rows = found.select(m["file_path"].alias("path"), row_hash(df).alias("h"))
    # two independent 31-bit sums, so that nothing overflows; equal rows don't cancel out
    lo, hi = F.pmod("h", F.lit(2147483647)), F.pmod(F.shiftright("h", 17), F.lit(2147483647))
    sums = rows.groupBy("path").agg(F.xxhash64(F.sum(lo.cast("decimal(20,0)")), F.sum(hi.cast("decimal(20,0)")), F.count("*")).alias("checksum"), F.count("*").alias("rows"))
    return candidates.join(sums, "path").select("path", "size", "modified", "checksum", "rows")


class Ledger:
    """State of one incremental job below ``where``; one run at a time."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        """Ids of committed batches; a folder without Spark's success mark doesn't count."""
        fs, p = self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [n for n in names if fs.exists(self._path(f"manifest/{n}/_SUCCESS")[1])]

    def manifest(self) -> DataFrame:
        """What committed batches have processed."""
        names = [f"{self.where}/manifest/{n}" for n in self.committed()]
        return self.spark.read.schema(FILE).parquet(*names) if names else self.spark.createDataFrame([], FILE)

    def output(self, schema: str) -> DataFrame:
        """What committed batches wrote."""
        names = [f"{self.where}/output/batch={n}" for n in self.committed()]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def pending(self, df: DataFrame) -> DataFrame:
        """Input files that no committed batch has processed, with checksums."""
        done = self.manifest()
        fresh = written(listing(df).join(done, ["path", "size", "modified"], "left_anti"), "fresh")
        return checksums(df, fresh).join(done.select("path", "checksum"), ["path", "checksum"], "left_anti").select("path", "size", "modified", "checksum", "rows")

    def _begin(self) -> str:
        """The id of a run that died before its commit, or a new one, noted before anything is written."""
        fs, p = self._path("pending")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        left = sorted(set(names) - set(self.committed()))
        if left:
            return left[0]
        run = uuid.uuid4().hex
        fs.mkdirs(self._path(f"pending/{run}")[1])
        return run

    @tidied
    def run(self, inputs: dict[str, DataFrame], work: Callable[[dict[str, DataFrame]], DataFrame], before_commit: Callable[[], None] | None = None) -> DataFrame | None:
        """One run over the pending files of all inputs. None: nothing to do.

        work gets, for each input, the rows of its pending files.  before_commit is called
        between writing and committing (tests kill a run there).
        """
        files = {k: written(self.pending(df), f"pending-{k}") for k, df in inputs.items()}
        counts = {k: f.count() for k, f in files.items()}
        if not any(counts.values()):
            return None
        run = self._begin()
        target = f"{self.where}/output/batch={run}"
        work({k: of_files(df, files[k], counts[k]) for k, df in inputs.items()}).write.mode("overwrite").parquet(target)
        if before_commit:
            before_commit()
        reduce(DataFrame.unionByName, files.values()).write.mode("overwrite").parquet(f"{self.where}/manifest/{run}")
        fs, p = self._path(f"pending/{run}")
        fs.delete(p, True)
        return self.spark.read.parquet(target)


def cutoffs(runs: DataFrame) -> DataFrame:
    """(source_type, source_key, cutoff): the greatest committed_until of a source's runs in state ok."""
    ok = runs.filter((F.lower(F.trim("run_state")) == "ok") & F.col("committed_until").isNotNull())
    return ok.groupBy("source_type", "source_key").agg(F.max("committed_until").alias("cutoff"))


KEYS = ["source_type", "source_key", "record_key"]
SEEN = "source_type string, source_key string, record_key string, seen bigint"


def marked(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows (KEYS, fetched_at, edit_us) with ``done``: fetched at or before the cut-off of their source."""
    c = cutoffs(runs)
    rows = rows.select(*KEYS, "fetched_at", "edit_us")
    on = [rows["source_type"] == c["source_type"], rows["source_key"].eqNullSafe(c["source_key"])]
    done = F.coalesce(F.col("fetched_at") <= F.col("cutoff"), F.lit(False))
    return rows.join(c, on, "left").select(rows["source_type"], rows["source_key"], "record_key", "edit_us", done.alias("done")).filter("record_key is not null")


def seen_edits(done: DataFrame) -> DataFrame:
    """(KEYS, seen): the latest edit time among the versions done of a record, null if none can be read."""
    return done.groupBy(*KEYS).agg(F.max("edit_us").alias("seen"))


def due(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Records of which a new version has no readable edit time, or a later one than what is seen (or nothing is seen).

    Repeated versions collapse on the map side before the shuffle on the record's key; a hot source is spread over its records.
    """
    per = new.groupBy(*KEYS).agg(F.max("edit_us").alias("newest"), F.max(F.col("edit_us").isNull()).alias("unread"))
    known = seen.groupBy(*KEYS).agg(F.max("seen").alias("seen"))
    on = [per["source_type"] == known["source_type"], per["source_key"].eqNullSafe(known["source_key"]), per["record_key"] == known["record_key"]]
    joined = per.join(known, on, "left").filter(F.col("unread") | F.col("seen").isNull() | (F.col("newest") > F.col("seen")))
    return joined.select(*[per[k] for k in KEYS])


def due_records(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """due() of the versions after each source's cut-off against those done.

    rows: source_type, source_key, record_key, fetched_at, edit_us (null: unreadable).  A source without a good run has no done versions.
    """
    m = marked(rows, runs)
    return due(m.filter("not done"), seen_edits(m.filter("done")))

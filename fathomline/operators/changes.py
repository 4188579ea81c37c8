"""Relational forms of keeping an index up to date: what is new, changed, stale or gone, and merging it in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last one in the order."""
    flipped = [c.desc_nulls_last() if isinstance(c, Column) else F.col(c).desc() for c in order]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*flipped))).filter("__k = 1").drop("__k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """df without the keys of gone; keys that aren't there change nothing."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def file_changes(previous: DataFrame, current: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """(keys, change): added, changed or removed; files with an equal mark are left out. One full join on the keys."""
    a = previous.select(*keys, F.col(mark).alias("__old"), F.lit(True).alias("__was"))
    b = current.select(*keys, F.col(mark).alias("__new"), F.lit(True).alias("__is"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


COUNTERS = ("files_scanned", "files_indexed", "files_skipped", "files_removed", "files_empty", "files_failed", "chunks_created")


def run_stats(changes: DataFrame, scanned: DataFrame, chunks: DataFrame | None = None, keys: tuple[str, ...] = ("repo", "file_path")) -> DataFrame:
    """One row of COUNTERS of an indexing run.

    chunks: (keys, error) of what was cut; a file without a chunk is empty, one with an error failed, neither counts as indexed.
    """
    label = lambda df, what: df.select(F.lit(what).alias("w"))
    each = label(scanned, "scanned").unionByName(changes.select(F.col("change").alias("w")))
    if chunks is not None:
        files = changes.filter("change <> 'removed'").select(*keys)
        cut = chunks.groupBy(*keys).agg(F.max(F.col("error").isNotNull()).alias("failed"))
        got = files.join(cut, list(keys), "left").select(F.when(F.col("failed").isNull(), "empty").when(F.col("failed"), "failed").alias("w")).filter("w is not null")
        each = each.unionByName(got).unionByName(label(chunks.filter("error is null"), "chunk"))
    n = lambda *whats: F.count_if(F.col("w").isin(*whats))
    touched = n("added", "changed")
    return each.agg(
        n("scanned").alias("files_scanned"), (touched - n("empty", "failed")).alias("files_indexed"), (n("scanned") - touched).alias("files_skipped"), n("removed").alias("files_removed"),
        n("empty").alias("files_empty"), n("failed").alias("files_failed"), n("chunk").alias("chunks_created"),
    )


def not_before(rows: DataFrame, seen: DataFrame, key: str, time: str, strict: bool = False, since: str | None = None) -> DataFrame:
    """Rows not before their source's cursor (after it if strict), or since where it has none; rows without a time always.

    seen: source_key, last_synced; times are compared as text, so they must be of one form.
    """
    cursor = seen.select(F.col("source_key").alias("__k"), F.col("last_synced").alias("__last"))
    joined = rows.join(cursor, F.col(key).cast("string") == F.col("__k"), "left").withColumn("__from", F.coalesce("__last", F.lit(since)))
    at = F.coalesce(F.col(time).cast("string"), F.lit(""))
    newer = F.when(F.col("__last").isNotNull() & F.lit(strict), at > F.col("__last")).otherwise(at >= F.col("__from"))
    return joined.filter((at == "") | F.col("__from").isNull() | newer).drop("__k", "__last", "__from")


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with the ids asked for, once each however often an id is asked for."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def files_known(state: DataFrame, by: str) -> DataFrame:
    """Number of different files of each collection or repository."""
    return state.groupBy(by).agg(F.countDistinct("repo", "file_path").alias("n_files"))

"""Texts cut by field limits or broken transfers.

For each source, histograms of the text lengths - in characters and in bytes, different
texts counted once - are tested for a spike at their maximum: a limit.  A text at a
source's limit that doesn't end like a complete one was cut there.  Away from a limit a
text counts as cut if it bears a mark of a cut, ends in a broken character, or breaks off in
prose, in an open code block or in a table's row.

The scan reduces each text to a few numbers before anything is shuffled; histograms
are aggregated on the map side, and the limits (two rows a source at most) join by their
measured size.

Defined results: null and blank texts are no cases; a null source is a source of its own;
repeated rows are found again, but count once in a histogram; a text is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

#: A limit is met by this many different texts at least, and by this many times the
#: number that the lengths of the fifth below it have on average.
LEAST, PEAK = 3, 15.0

BLANKS = " \t\n\x0b\f\r\u200b\ufeff"
#: Marks that tools leave where they cut.
MARK = (
    r"(?i)(?:\.\.\.|…)\s{0,20}[\[(<](?:truncated|cut|clipped|shortened|snip(?:ped)?|more|continued)[^\])>]{0,40}[\])>]$"
    r"|[\[(<](?:truncated|text truncated|message truncated|message clipped|clipped|content cut|cut off|snip(?:ped)?|output truncated)[^\])>]{0,40}[\])>]$"
    r"|\[(?:\.\.\.|…)\]$"
)
#: No mark is longer (3 + 20 + 1 + 17 + 40 + 1), so no more of a text's end is searched for one.
MARK_LENGTH = 100
#: What ends a complete text, and what may close after it.
STOPS, CLOSERS = ".!?。！？…．؟।", "\"'”’»」』)]*_`~"
DOTS = r"(?:\.\.\.|…)$"
#: Last lines that end without punctuation in complete texts: lists, headings, fences, links, chat, signatures, rows of data, key and value.
LINE = (
    r"^(?:[-*+•]|\d+[.)])\s+\S"
    r"|^#{1,6}\s+\S"
    r"|^(?:```|~~~)"
    r"|^\|.*\|$"
    r"|(?:https?|ftp)://\S+[)>\]]?$"
    r"|^<?@[\w.<>-]+:\s"
    r"|^(?:—|–|--)\s*\S"
    r"|^[^\s,;]+(?:[,;][^,;]+){2,}+$"  # possessive: a line may have any number of cells
    r"|^[\w .-]{1,24}:\s\S.{0,60}$"
    r"|^[{\[<].*[}\]>]$"
)
CHAT = r"^<?@[\w.<>-]+:\s"


def _shape(text: Column) -> Column:
    """mark, dots, end, line, broken, other: how a text ends."""
    t = F.rtrim(text, F.lit(BLANKS))
    tail = F.substring(t, -MARK_LENGTH, MARK_LENGTH)
    last = F.trim(F.substring_index(F.translate(t, "\r", "\n"), "\n", -1))
    fences = (F.length(t) - F.length(F.replace(t, F.lit("```"), F.lit("")))) / 3
    stop = F.right(F.rtrim(t, F.lit(CLOSERS)), F.lit(1))
    return (
        F.when(tail.rlike(MARK), "mark")
        .when(t.endswith("�"), "broken")
        .when(F.pmod(fences.cast("long"), F.lit(2)) == 1, "open")
        .when(tail.rlike(DOTS), "dots")
        .when((stop != "") & F.lit(STOPS).contains(stop), "end")
        .when(last.rlike(r"^\|") & ~last.endswith("|"), "open")
        .when(last.rlike(CHAT), "chat")
        .when(last.rlike(LINE), "line")
        .otherwise("prose")
    )


def limits(measured: DataFrame) -> DataFrame:
    """(source, max_chars, max_bytes): the length limits of each source, null where there is none.

    One histogram for both units; the lengths of a source stay spread until their sums.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n"))))
    texts = measured.filter("shape != 'broken'").select("source", "hash", units.alias("u")).select("source", "u.unit", "u.n", "hash").distinct()
    hist = texts.groupBy("source", "unit", "n").agg(F.count("*").alias("texts"))
    # one row for each length of a source and unit, sorted by length: the top and what lies in the fifth below it
    lengths = hist.groupBy("source", "unit").agg(F.max_by("texts", "n").alias("at_top"), F.max("n").alias("top"))
    on = hist["source"].eqNullSafe(lengths["source"]) & (hist["unit"] == lengths["unit"]) & (hist["n"] < lengths["top"]) & (hist["n"] >= lengths["top"] * 0.8)
    below = lengths.join(hist, on, "left").groupBy(lengths["source"], lengths["unit"], "top", "at_top").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("below"))
    spike = (F.col("at_top") >= LEAST) & (F.col("at_top") >= PEAK * F.col("below") / F.greatest(F.col("top") * 0.2, F.lit(1.0)))
    at = lambda unit: F.max(F.when(F.col("unit") == unit, F.col("top")))
    return below.filter(spike).groupBy("source").agg(at("chars").alias("max_chars"), at("bytes").alias("max_bytes"))


def measure(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Each text that isn't blank as a few numbers; written once, as histogram and flags both need it."""
    t = F.col(text)
    df = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), t.alias("text")).filter(F.col("text").rlike("[^\\s​﻿]"))
    df = df.select(
        "key", "source", F.length("text").cast("int").alias("chars"), F.octet_length("text").cast("int").alias("bytes"), F.xxhash64("text").alias("hash"),
        _shape(F.col("text")).alias("shape"),
    )
    return written(df, "cuts")


def flagged(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """measure() with ``cut``."""
    m = measure(docs, key, text, source)
    lim = limits(m).withColumnRenamed("source", "__source")
    df = m.join(lim, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    at = F.coalesce(F.col("chars") == F.col("max_chars"), F.lit(False)) | F.coalesce(F.col("bytes") == F.col("max_bytes"), F.lit(False))
    cut = F.col("shape").isin("mark", "broken", "open", "prose") | (at & F.col("shape").isin("dots", "line", "chat"))
    return df.select("key", "source", "chars", "bytes", "shape", at.alias("at_limit"), cut.alias("cut"))


def share(marked: DataFrame) -> DataFrame:
    """How often each source cuts."""
    return marked.groupBy("source").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_at_limit"),
        F.round(F.count_if("cut") / F.count("*"), 6).alias("share_cut"),
    )

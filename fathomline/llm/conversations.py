"""Conversations from message rows: ordered entries with speakers, broken sessions dropped.

Rows of one export may repeat rows of another, come late and in any order.  Copies of an
entry meet by (session, entry, hash of the message); what is left is cut into fragments, the runs of a
session inside one range partition, ordered by (session, time, entry).  A fragment is
folded in one pass into its turns and a summary (first and last speaker, users so far,
whether it is sound).  A session inside one partition is decided there; of one that
spans several, the summaries - one row for each partition - are joined along their order
into a path, and a path that doesn't fit (a user not answered across the border, a broken entry
anywhere) drops the session.  So a session with a third of all rows is never in one task.

Defined results
---------------
* Null session or null entry id, types other than user and assistant: ignored.
* Unreadable message, role unlike the type, no time: the session is dropped.
* Elements <system-reminder> and <local-command-...> are no words; an entry with a
  tool_result has none, thinking and tool calls have none.
* Of an entry delivered again (same session and id) one row counts; if copies differ,
  each different copy is an entry of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

NOISE = r"(?s)<(system-reminder|local-command-[A-Za-z0-9-]+)\b[^>]*>.*?</\1>"
OUT = "session_id string, turn_no int, speaker string, entry_id bigint"
_ROW = "kind byte, session_id string, part int, seq bigint, turn_no int, speaker string, entry_id bigint, first byte, last byte, users bigint, sound boolean"
FINAL, ENTRY, FRAGMENT = 0, 1, 2
SPEAKERS = ("user", "assistant")


def with_words(df: DataFrame, message: str) -> DataFrame:
    """Adds __readable, __role, __words."""
    df = df.select("*", F.explode(F.array(F.try_parse_json(F.col(message)))).alias("__v"))
    v = F.col("__v")
    df = df.select(
        "*",
        F.try_variant_get(v, "$.content", "array<variant>").alias("__blocks"),
        F.when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING", F.try_variant_get(v, "$.content", "string")).alias("__plain"),
    )
    kind = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit(""))
    result = F.exists("__blocks", lambda b: kind(b) == "tool_result")
    texts = F.transform(F.filter("__blocks", lambda b: kind(b) == "text"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    clean = lambda x: F.regexp_replace(x, NOISE, "")
    words = F.when(F.col("__blocks").isNotNull(), F.when(~result, F.array_join(F.transform(texts, clean), "\n"))).otherwise(clean(F.col("__plain")))
    return df.select(
        *[c for c in df.columns if c not in ("__v", "__blocks", "__plain")],
        v.isNotNull().alias("__readable"),
        F.lower(F.trim(F.try_variant_get(v, "$.role", "string"))).alias("__role"),
        F.coalesce(words.rlike(r"\S"), F.lit(False)).alias("__words"),
    )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries -> final rows of inner sessions; entries and a summary for the first and last session."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in _ROW.split(", ")]
    types = [pa.int8(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int8(), pa.int8(), pa.int64(), pa.bool_()]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in names]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def close(border: bool) -> None:
        # users: user entries so far; an assistant's turn is twice that, a user's one less
        turns = [(2 * u - (s == 0), s, e) for u, s, e in rows]
        if not border:
            if sound and rows and rows[0][1] == 0 and rows[-1][1] == 1:
                out.extend((FINAL, session, part, 0, t, SPEAKERS[s], e, None, None, None, None) for t, s, e in turns)
            return
        out.extend((ENTRY, session, part, i, t, SPEAKERS[s], e, None, None, None, None) for i, (t, s, e) in enumerate(turns))
        out.append((FRAGMENT, session, part, 0, None, None, None, rows[0][1] if rows else None, rows[-1][1] if rows else None, users, sound))

    session, first, rows, users, sound = None, None, [], 0, True
    for batch in batches:
        for sid, entry, speaker, words, bad in zip(*[c.to_pylist() for c in batch.columns]):
            if sid != session:
                if session is not None:
                    close(session == first)
                else:
                    first = sid
                session, rows, users, sound = sid, [], 0, True
            if bad:
                sound = False
            if words:
                if speaker == 0:
                    users += 1
                    if rows and rows[-1][1] == 0:
                        sound = False
                rows.append((users, speaker, entry))
        if len(out) > 20000:
            yield flush()
    if session is not None:
        close(True)
    yield flush()


def _path(key, pdf):
    """The fragments of one session, in the order of their partitions -> where each begins, if they make a path."""
    import pandas as pd

    pdf = pdf.sort_values("part")
    ok, users, last, bases = bool(pdf["sound"].all()), 0, None, []
    for part, first, end, n in zip(pdf["part"], pdf["first"], pdf["last"], pdf["users"]):
        bases.append((key[0], part, users))
        if pd.notna(first):
            ok &= first == 0 if last is None else not (last == 0 and first == 0)
            last = end
        users += int(n)
    ok &= last == 1
    return pd.DataFrame(bases if ok else [], columns=["session_id", "part", "base"])


def conversations(rows: DataFrame, session: str, entry: str, kind: str, message: str, us: str) -> DataFrame:
    """(session_id, turn_no, speaker, entry_id): the entries with words in kept conversations."""
    t = F.lower(F.trim(F.col(kind)))
    df = rows.select(
        F.col(session).cast("string").alias("session_id"), F.col(entry).cast("long").alias("entry_id"), t.alias("kind"),
        F.col(message).alias("message"), F.col(us).alias("us"),
    ).filter(F.col("session_id").isNotNull() & F.col("entry_id").isNotNull() & F.col("kind").isin(*SPEAKERS))
    df = with_words(df, "message")
    bad = ~F.col("__readable") | ~F.coalesce(F.col("__role") == F.col("kind"), F.lit(False)) | F.col("us").isNull()
    entries = df.select(
        "session_id", "us", "entry_id", F.when(F.col("kind") == "user", 0).otherwise(1).cast("byte").alias("speaker"),
        F.col("__words").alias("words"), bad.alias("bad"), F.xxhash64("message").alias("hash"),
    ).distinct()
    ordered = entries.repartitionByRange("session_id", "us", "entry_id").sortWithinPartitions("session_id", F.col("us").asc_nulls_first(), "entry_id", "hash")
    folded = written(ordered.select("session_id", "entry_id", "speaker", "words", "bad").mapInArrow(_fold, _ROW), "conversations")
    final = folded.filter(F.col("kind") == FINAL).select("session_id", "turn_no", "speaker", "entry_id")
    base = folded.filter(F.col("kind") == FRAGMENT).select("session_id", "part", "first", "last", "users", "sound")
    base = base.groupBy("session_id").applyInPandas(_path, "session_id string, part int, base bigint")
    spread = folded.filter(F.col("kind") == ENTRY).join(base, ["session_id", "part"])
    return final.unionByName(spread.select("session_id", (F.col("turn_no") + 2 * F.col("base")).cast("int").alias("turn_no"), "speaker", "entry_id"))

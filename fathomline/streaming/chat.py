"""Chat as a stream: windows cut at gaps and at a number of messages, and idempotent merging of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = "channel_id string, start_us bigint, end_us bigint, n_messages bigint"
_STATE = "start_us bigint, end_us bigint, n bigint"


def gap_windows(messages: DataFrame, gap_s: int = 1800, cap: int = 50, delay: str = "10 minutes") -> DataFrame:
    """Windows of a stream of (channel_id, ts TIMESTAMP) as they close.

    The state of a channel is three numbers, whatever its traffic.  A window closes when a message
    comes after a gap or beyond the cap, and by event-time timeout when the watermark has passed its
    gap.  Within a micro-batch messages are put in order; those behind the watermark are dropped,
    as are nulls.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (channel,) = key
        out = []
        start, end, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            out.append((channel, start, end, n))
            state.remove()
        else:
            times = pd.concat([f["ts"] for f in frames]).dropna().astype("datetime64[us]").astype("int64").sort_values()
            for t in times.tolist():
                if n and (t - end > gap_s * 1_000_000 or n >= cap):
                    out.append((channel, start, end, n))
                    n = 0
                start, end, n = (t if not n else start), (t if not n else max(end, t)), n + 1
            if n:
                state.update((start, end, n))
                state.setTimeoutTimestamp(max(end // 1000 + gap_s * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["channel_id", "start_us", "end_us", "n_messages"])

    watched = messages.filter("channel_id is not null and ts is not null").withWatermark("ts", delay)
    return watched.groupBy("channel_id").applyInPandasWithState(step, WINDOW, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str, once: bool = True):
    """Runs every micro-batch through an idempotent merge (ChunkStore.merge, say); a batch that is repeated changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            merge(batch)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

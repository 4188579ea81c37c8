"""Sessions of activity from a Cartesian tree over the gaps between an entity's events.

``gap_tree`` builds, for each entity, the Cartesian tree (largest gap at the root) over
the gaps between consecutive events.  Each node of the tree is the longest run of events
without a gap larger than the node's own; with its parent's gap beside it,

    ``own_gap <= t < parent_gap``

picks exactly the sessions at threshold t, so ONE tree serves any number of settings
(``cut_sessions``).

Scale
-----
Events are range-partitioned by (entity, time, id), so an entity holding a third of all
rows is spread over many tasks.  A task folds its sorted stream batch by batch and holds
one batch and a spine.  Of a run cut by a partition's border only the spines stay
open: the gaps larger than all gaps to one side.  There are about 2 ln(n) of them in n
events and, as they are strictly increasing integers that sum to at most the time span,
never more than its square root.  A second pass joins the spines of an entity.

Defined results
---------------
* Null entity or null time: no event.  Of an id delivered twice the earliest time counts.
* Equal times: gap 0, same session.  Null ids: events of one entity at one time count once, at other times by themselves.
* Empty table: empty tree.  Columns other than the three are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

INF = np.iinfo(np.int64).max
LEAF = -1  # own_gap of a single event
_COLS = ("start_us", "end_us", "n_events", "own_gap", "parent_gap")
SCHEMA = "entity string, start_us bigint, end_us bigint, n_events bigint, own_gap bigint, parent_gap bigint, state byte, seq bigint"
NODE, OPEN, OPEN_DONE = 0, 1, 2  # a finished node; an open item; an open item that was already given out


class Items:
    """Consecutive pieces of an entity's history, in order."""

    __slots__ = ("done", "end", "n", "own", "start")

    def __init__(self, start, end, n, own, done):
        self.start, self.end, self.n, self.own, self.done = start, end, n, own, done

    @classmethod
    def events(cls, t: np.ndarray) -> Items:
        k = len(t)
        return cls(t, t, np.ones(k, np.int64), np.full(k, LEAF, np.int64), np.zeros(k, bool))

    def __add__(self, other: Items) -> Items:
        return Items(*[np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("start", "end", "n", "own", "done")])

    def take(self, i) -> Items:
        return Items(self.start[i], self.end[i], self.n[i], self.own[i], self.done[i])


def _bounds(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gap the nearest one to the left that is no smaller (-1: none) and to the right that is larger (len: none)."""
    m = len(gaps)
    left, right = np.full(m, -1, np.int64), np.full(m, m, np.int64)
    stack: list[int] = []
    values = gaps.tolist()
    for i, g in enumerate(values):
        while stack and values[stack[-1]] < g:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1]
        stack.append(i)
    return left, right


def fold(items: Items, complete: bool) -> tuple[list[np.ndarray], Items | None]:
    """Nodes of the tree that no neighbour can change, and the open items (None when complete)."""
    k = len(items.start)
    gaps = items.start[1:] - items.end[:-1]
    m = len(gaps)
    left, right = _bounds(gaps)
    edge = np.concatenate([[INF], gaps, [INF]])
    sums = np.concatenate([[0], np.cumsum(items.n)])
    inner = np.arange(m) if complete else np.flatnonzero((left >= 0) & (right < m))
    lo, hi = left[inner] + 1, right[inner]  # first and last item below the node
    nodes = [
        items.start[lo], items.end[hi], sums[hi + 1] - sums[lo], gaps[inner], np.minimum(edge[left[inner] + 1], edge[right[inner] + 1]),
    ]
    own = ~items.done
    if not complete:
        own[0] = own[-1] = False
    w = np.flatnonzero(own)
    nodes = [np.concatenate(x) for x in zip(nodes, [items.start[w], items.end[w], items.n[w], items.own[w], np.minimum(edge[w], edge[w + 1])])]
    if complete:
        return nodes, None
    spine = np.flatnonzero((left < 0) | (right >= m))
    if len(spine) == m:  # nothing to contract, but inner items were given out
        rest = items.take(slice(None))
        rest.done = items.done.copy()
        rest.done[1:-1] = True
        return nodes, rest
    first, last = np.concatenate([[0], spine + 1]), np.concatenate([spine, [k - 1]])
    single = first == last
    inside = np.array([items.own[a] if a == b else gaps[a:b].max() for a, b in zip(first, last)], np.int64)
    done = ~single | items.done[first]
    done[1:-1] = True
    return nodes, Items(items.start[first], items.end[last], sums[last + 1] - sums[first], inside, done)


def fold_many(us: np.ndarray, codes: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """All nodes of the trees of several whole entities at once: codes tells whose each event is, gaps between two entities have no limit."""
    gaps, border = np.diff(us), np.diff(codes) != 0
    gaps[border] = INF
    left, right = _bounds(gaps)
    edge = np.concatenate([[INF], gaps, [INF]])
    inner = np.flatnonzero(~border)
    lo, hi = left[inner] + 1, right[inner]
    k = np.arange(len(us))
    cols = [
        np.concatenate([us[lo], us]), np.concatenate([us[hi], us]), np.concatenate([hi - lo + 1, np.ones(len(us), np.int64)]), np.concatenate([gaps[inner], np.full(len(us), LEAF)]),
        np.concatenate([np.minimum(edge[left[inner] + 1], edge[right[inner] + 1]), np.minimum(edge[k], edge[k + 1])]),
    ]
    who = np.concatenate([codes[lo], codes])
    rest = [pa.array(np.full(len(who), NODE, np.int8)), pa.array(np.arange(len(who)), pa.int64())]
    return pa.RecordBatch.from_arrays([words.take(pa.array(who)), *[pa.array(c, pa.int64()) for c in cols], *rest], names=["entity", *_COLS, "state", "seq"])


def _rows(entity: str, cols: list[np.ndarray], state: np.ndarray | int) -> pa.RecordBatch:
    k = len(cols[0])
    state = np.full(k, state, np.int8) if isinstance(state, int) else state.astype(np.int8)
    arrays = [pa.array([entity] * k, pa.string()), *[pa.array(c, pa.int64()) for c in cols], pa.array(state, pa.int8()), pa.array(np.arange(k), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["entity", *_COLS, "state", "seq"])


def _open_rows(entity: str, x: Items) -> pa.RecordBatch:
    return _rows(entity, [x.start, x.end, x.n, x.own, np.full(len(x.start), INF)], np.where(x.done, OPEN_DONE, OPEN))


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (entity, us) stream -> nodes, and open items of the partition's first and last entity."""
    carry: tuple[str, Items] | None = None
    first: str | None = None
    out: list[pa.RecordBatch] = []
    waiting = 0

    def put(x: pa.RecordBatch) -> None:
        nonlocal waiting
        if x.num_rows:
            out.append(x)
            waiting += x.num_rows

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).dictionary_encode()
        codes, words = names.indices.to_numpy(zero_copy_only=False), names.dictionary
        us = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
        # entities that begin and end in the batch, all but its first and last: one fold for all of them
        if len(cuts) > 3:
            put(fold_many(us[cuts[1] : cuts[-2]], codes[cuts[1] : cuts[-2]], words))
        for a, b in [(0, cuts[1]), *([(cuts[-2], cuts[-1])] if len(cuts) > 2 else [])]:
            entity, items = words[codes[a]].as_py(), Items.events(us[a:b])
            if carry and carry[0] == entity:
                items = carry[1] + items
            elif carry:
                nodes, rest = fold(carry[1], carry[0] != first)
                put(_rows(carry[0], nodes, NODE))
                if rest is not None:
                    put(_open_rows(carry[0], rest))
            if first is None:
                first = entity
            carry = (entity, items)
        if len(carry[1].start) > 2:  # contract what came so far
            nodes, rest = fold(carry[1], False)
            put(_rows(carry[0], nodes, NODE))
            carry = (carry[0], rest)
        if waiting > 20000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out, waiting = [], 0
    if carry:
        nodes, rest = fold(carry[1], False) if len(carry[1].start) > 2 else ([], carry[1])
        if nodes:
            put(_rows(carry[0], nodes, NODE))
        put(_open_rows(carry[0], rest))
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _join_spines(t: pa.Table) -> pa.Table:
    """All open items of one entity -> its remaining nodes."""
    t = t.sort_by([("start_us", "ascending"), ("end_us", "ascending"), ("seq", "ascending")])
    col = lambda k: t.column(k).to_numpy()
    nodes, _ = fold(Items(col("start_us"), col("end_us"), col("n_events"), col("own_gap"), col("state") == OPEN_DONE), True)
    return pa.Table.from_batches([_rows(t.column("entity")[0].as_py(), nodes, NODE)])


def gap_tree(events: DataFrame, entity: str, us: str, event_id: str) -> DataFrame:
    """(entity, start_us, end_us, n_events, own_gap, parent_gap): all nodes, single events included (own_gap -1)."""
    e = events.select(F.col(entity).cast("string").alias("entity"), F.col(us).cast("long").alias("us"), F.col(event_id).alias("id"))
    e = e.filter("entity is not null and us is not null").groupBy("id", "entity", F.when(F.col("id").isNull(), F.col("us")).alias("alone")).agg(F.min("us").alias("us"))
    ordered = e.repartitionByRange("entity", "us", "id").sortWithinPartitions("entity", "us").select("entity", "us")
    folded = written(ordered.mapInArrow(_fold_partition, SCHEMA), "gap-tree")
    nodes = folded.filter(F.col("state") == NODE)
    joined = folded.filter(F.col("state") != NODE).groupBy("entity").applyInArrow(_join_spines, SCHEMA)
    return nodes.unionByName(joined).select("entity", *_COLS)


def cut_sessions(tree: DataFrame, gap_us: int) -> DataFrame:
    """Sessions at a threshold: a gap larger than gap_us splits, an equal one doesn't."""
    return tree.filter((F.col("own_gap") <= gap_us) & (F.col("parent_gap") > gap_us)).select(
        "entity", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events"
    )

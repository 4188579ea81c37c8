import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from fathomline.operators.gap_tree import INF, Items, cut_sessions, fold, fold_many, gap_tree


def brute(times, gap):
    out, run = [], []
    for t in sorted(times):
        if run and t - run[-1] > gap:
            out.append((run[0], run[-1], len(run)))
            run = []
        run.append(t)
    return sorted([*out, *([(run[0], run[-1], len(run))] if run else [])])


def cut(nodes, gap):
    s, e, n, own, parent = (np.concatenate(x) for x in zip(*nodes))
    keep = (own <= gap) & (parent > gap)
    return sorted(zip(s[keep].tolist(), e[keep].tolist(), n[keep].tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=12))
def test_any_cutting_into_chunks_gives_the_same_tree(times, sizes):
    t = np.array(sorted(times), np.int64)
    nodes, carry, at, k = [], None, 0, 0
    while at < len(t):
        part = Items.events(t[at : at + sizes[k % len(sizes)]])
        at += sizes[k % len(sizes)]
        k += 1
        carry = part if carry is None else carry + part
        if len(carry.start) > 2:
            got, carry = fold(carry, False)
            nodes.append(got)
    last, _ = fold(carry, True)
    nodes.append(last)
    assert sum(len(x[0]) for x in nodes) == 2 * len(t) - 1  # every node once
    for gap in (0, 1, 5, 20, 500, INF - 1):
        assert cut(nodes, gap) == brute(times, gap)


def test_spread_over_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(x), i) for i, x in enumerate(rng.integers(0, 10**9, 3000))] + [(f"u{i % 7}", int(x), 10_000 + i) for i, x in enumerate(rng.integers(0, 10**9, 500))]
    rows += rows[:100] + [(None, 5, 1), ("x", None, 2)]
    df = spark.createDataFrame(rows, "user string, us bigint, id bigint").repartition(6)
    tree = gap_tree(df, "user", "us", "id").cache()
    want = {}
    for u, t, i in set(rows):
        if u and t is not None:
            want.setdefault(u, {})[i] = t
    for gap in (0, 1000, 200_000, 10**10):
        got = {}
        for r in cut_sessions(tree, gap).collect():
            got.setdefault(r.entity, []).append((r.start_us, r.end_us, r.n_events))
            assert r.duration_us == r.end_us - r.start_us
        assert {u: sorted(x) for u, x in got.items()} == {u: brute(x.values(), gap) for u, x in want.items()}


def test_empty(spark):
    assert gap_tree(spark.createDataFrame([], "user string, us bigint, id bigint, entity string"), "user", "us", "id").collect() == []


def test_null_ids_are_events_of_their_own(spark):
    s = 1_000_000
    rows = [("u", 0, None), ("u", 10_000 * s, None), ("u", 20_000 * s, None), ("u", 20_000 * s, None), ("u", 20_010 * s, 7), ("u", 30_000 * s, 7)]
    tree = gap_tree(spark.createDataFrame(rows, "e string, us bigint, id bigint"), "e", "us", "id")
    got = sorted((r.start_us // s, r.end_us // s, r.n_events) for r in cut_sessions(tree, 1800 * s).collect())
    assert got == [(0, 0, 1), (10_000, 10_000, 1), (20_000, 20_010, 2)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=15), min_size=1, max_size=8), st.sampled_from([0, 1, 7, 60, 500]))
def test_many_entities_in_one_fold(entities, gap):
    us = np.concatenate([np.sort(np.array(t, np.int64)) for t in entities])
    codes = np.repeat(np.arange(len(entities)), [len(t) for t in entities])
    t = fold_many(us, codes, pa.array([f"e{k}" for k in range(len(entities))]))
    got = {}
    for e, a, b, n, own, parent, *_ in zip(*[c.to_pylist() for c in t.columns]):
        if own <= gap < parent:
            got.setdefault(e, []).append((a, b, n))
    assert {e: sorted(x) for e, x in got.items()} == {f"e{k}": brute(t, gap) for k, t in enumerate(entities)}


def test_many_small_and_one_large_entity(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i % 4000:04d}", int(t), i) for i, t in enumerate(rng.integers(0, 10**6, 12_000))] + [("hot", int(t), 100_000 + i) for i, t in enumerate(rng.integers(0, 10**7, 20_000))]
    tree = gap_tree(spark.createDataFrame(rows, "e string, us bigint, id bigint"), "e", "us", "id")
    want = {}
    for e, t, _ in rows:
        want.setdefault(e, []).append(t)
    got = {}
    for r in cut_sessions(tree, 900).collect():
        got.setdefault(r.entity, []).append((r.start_us, r.end_us, r.n_events))
    assert {e: sorted(x) for e, x in got.items()} == {e: brute(t, 900) for e, t in want.items()}

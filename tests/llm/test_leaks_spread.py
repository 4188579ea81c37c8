"""Leaks: nothing is lost to seeds, windows or the number of items."""

import random

import numpy as np
import pytest

pytest.importorskip("fathomline.llm")

from fathomline.llm import leaks  # noqa: E402


def test_copy_without_a_whole_seed_is_found():
    item = [f"word{i}" for i in range(40)]
    index = leaks.Index({7: item, 8: [f"other{i}" for i in range(40)], 9: ["same"] * 9 + ["one"]})
    spread = " ".join(f"{w} {'between' * (i % 2)}" for i, w in enumerate(item))
    assert index.find(spread) == [7]
    assert index.find(" ".join(reversed(item))) == []
    assert index.find("same " * 9 + "end") == [9]  # half of its distinct words, nine tenths of its words


def _items(n, rng):
    """Items of which many share most of their words."""
    base = [f"b{k}" for k in range(80)]
    return {i: [w if rng.random() < 0.95 else f"own{i}x{k}" for k, w in enumerate(base)] if i % 3 == 0 else [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 90))] for i in range(n)}


def _texts(items, n, rng):
    out = []
    for _ in range(n):
        ws = list(items[rng.randrange(len(items))])
        share = rng.choice([0.1, 0.19, 0.21, 0.4])
        ws = [w if rng.random() > share else "changed" for w in ws]
        ws = [x for w in ws for x in ([w, "more"] if rng.random() < rng.choice([0, 0.3]) else [w])]
        if rng.random() < 0.2:
            at = len(ws) // 2
            ws = ws[:at] + [f"far{k}" for k in range(400)] + ws[at:]
        out.append(" ".join([f"lead{k}" for k in range(rng.randrange(9))] + ws + [f"tail{k}" for k in range(rng.randrange(9))]))
    return out


def _brute(items, text):
    """Every item against the whole text: a run of its words, or the alignment of all of it (if the text has enough of its words at all)."""
    ws = leaks.words(text)
    vocab = {w: k + 1 for k, w in enumerate({x for i in items.values() for x in i})}
    ids, there = np.array([vocab.get(w, 0) for w in ws]), set(ws)
    runs = {tuple(ws[k : k + leaks.RUN]) for k in range(len(ws) - leaks.RUN + 1)}
    enough = lambda i: sum(w in there for w in i) >= leaks.SHARE * len(i) and leaks.aligned(np.array([vocab[w] for w in i]), ids) >= leaks.SHARE * len(i)
    hit = lambda i: any(tuple(i[k : k + leaks.RUN]) in runs for k in range(len(i) - leaks.RUN + 1)) or enough(i)
    return sorted(k for k, i in items.items() if hit(i))


def test_all_items_against_brute_force():
    rng = random.Random(3)
    items = _items(1000, rng)  # a third of them share most of their words
    index = leaks.Index(items)
    texts = _texts(items, 60, rng)
    want = [_brute(items, t) for t in texts]
    assert [index.find(t) for t in texts] == want and sum(map(len, want)) > 100


def test_six_near_equal_items():
    base = [f"b{k}" for k in range(70)]
    items = {i: base + [f"own{i}x{k}" for k in range(10)] for i in range(6)}
    text = " ".join(w for k, w in enumerate(base[:65]))
    assert leaks.Index(items).find(" ".join(f"{w} x" if k % 9 == 8 else w for k, w in enumerate(text.split()))) == list(range(6))


def test_a_window_of_a_long_text():
    item = [f"w{k}" for k in range(50)]
    text = " ".join(["filler"] * 300_000 + [w for k, w in enumerate(item) if k % 6] + ["filler"] * 300_000)
    assert leaks.Index({1: item}).find(text) == [1]
    assert leaks.Index({1: item}).find(" ".join(item[:20] + ["filler"] * 2000 + item[20:40])) == ([1] if leaks.RUN <= 20 else [])


def test_result_does_not_depend_on_the_number_of_items_shipped(spark):
    rng = random.Random(8)
    items, shared = _items(200, rng), "read this passage with care and answer."
    rows = [(i, f"{shared} {' '.join(ws)}.") for i, ws in items.items()] + [(98, None), (97, shared), (None, "x")]
    docs = [(k, t) for k, t in enumerate(_texts(items, 40, rng))] + [(100, None), (101, ""), (102, shared), (1, "again")]
    its = spark.createDataFrame(rows, "item_id bigint, text string")
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string")
    got = [sorted(map(tuple, leaks.find_leaks(df, "doc_id", "text", its, "item_id", "text", block).collect())) for block in (1000, 5)]
    assert got[0] == got[1] and len(got[0]) > 40

"""Evaluation texts leaking into training text.

Rare n-grams of the test items are seeds that join passages of the corpus to items; Smith-Waterman
alignment over words then scores the passage, which finds edited copies.  There are two kinds of seeds:

* runs of ``RUN`` words, which count by themselves;
* of each item its rarest words, so many that a text without any of them lacks more than a fifth of the
  item.  A text that holds four fifths of an item's words therefore holds a seed, whatever was
  inserted or changed, and no pair is left out.

Candidates are counted word by word and aligned only where four fifths of the item lie close
enough together for an alignment (three item lengths, as every word without a partner costs half of one with).

Scale: up to ``BLOCK`` items their index travels with the function and the corpus is read in
place, without a shuffle.  Beyond, seeds are a table: the texts' words meet it by hash, pairs of text
and item are made distinct, and only they are aligned.  Both give the same rows.

Defined results: null or empty texts and items match nothing; repeated rows give
repeated pairs; a sentence shared by several items belongs to none, and an item that
has no other sentence never matches; of several items with one id one counts; case, punctuation, line layout, markup and quote
marks are no part of the words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

RUN = 15  # consecutive words of an item that count
SHARE = 0.8  # of the item's words in order, in one passage
BLOCK = 20_000  # items whose index is shipped

_DROP = dict.fromkeys(map(ord, "­​‌‍⁠﻿'’‘ʼ`"))
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:[a-z]+|#\d+);")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+")


def words(text: str) -> list[str]:
    """Words in lower case, without markup, punctuation and marks inside them."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.translate(_DROP).lower())


def own_words(items: list[tuple[int, str]]) -> dict[int, list[str]]:
    """item -> its words without the sentences that other items share."""
    parts = {i: [w for s in _SENTENCE.split(t or "") if (w := words(s))] for i, t in items}
    held = Counter(tuple(w) for ps in parts.values() for w in {tuple(p) for p in ps})
    return {i: [x for p in ps if held[tuple(p)] == 1 for x in p] for i, ps in parts.items()}


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in the best local alignment of a with b (match 2, anything else -1)."""
    n = len(b)
    score, equal = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    steps, best, hit = np.arange(n + 1), 0, 0
    for x in a:
        same = b == x
        diagonal = score[:-1] + np.where(same, 2, -1)
        up = score[1:] - 1
        s, e = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        take = diagonal >= up
        s[1:] = np.maximum(np.where(take, diagonal, up), 0)
        e[1:] = np.where(s[1:] > 0, np.where(take, equal[:-1] + same, equal[1:]), 0)
        # gaps along the row: the best of s[k] - (j - k) over k <= j
        lift = s + steps
        top = np.maximum.accumulate(lift)
        src = np.maximum.accumulate(np.where(lift == top, steps, 0))
        s, e = top - steps, e[src]
        s = np.maximum(s, 0)
        score, equal = s, e
        k = int(np.argmax(s))
        if s[k] > best or (s[k] == best and e[k] > hit):
            best, hit = int(s[k]), int(e[k])
    return hit


def needed(n: int) -> int:
    """Words of an item of n that a copy holds at least."""
    return math.ceil(SHARE * n - 1e-9)


def seeds_of(words_: list[str], held: dict[str, int]) -> list[str]:
    """The rarest words of an item (by the number of items that hold them): a text with none of them lacks too much of it."""
    times, spare, out = Counter(words_), len(words_) - needed(len(words_)), []
    for w in sorted(times, key=lambda w: (held[w], w)):
        out.append(w)
        spare -= times[w]
        if spare < 0:
            break
    return out


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return (h ^ (h >> np.uint64(29))).astype(np.int64)


def leaked(item: np.ndarray, ids: np.ndarray) -> bool:
    """Whether four fifths of the item's words lie in order in one passage; words as numbers."""
    need = needed(len(item))
    at = np.flatnonzero(np.isin(ids, item))
    if len(at) < need:
        return False
    reach = 3 * len(item)
    near = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < reach)
    if not len(near):
        return False
    first, last = at[near], at[near] + reach
    new = np.concatenate([[True], first[1:] > last[:-1]])  # overlapping windows are one
    begins, ends = first[new], last[np.concatenate([new[1:], [True]])]
    return any(aligned(item, ids[a:b]) >= need for a, b in zip(begins, ends))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those from first[1] on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """Seeds and words of a set of items."""

    def __init__(self, items: dict[int, list[str]]):
        self.vocab: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        runs: dict[int, set[int]] = {}
        held = Counter(w for ws in items.values() for w in set(ws))
        seeds: dict[int, list[int]] = {}
        for i, ws in items.items():
            if ws:
                ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64)
                self.items[i] = ids
                for w in seeds_of(ws, held):
                    seeds.setdefault(self.vocab[w], []).append(i)
                for h in grams(ids, RUN):
                    runs.setdefault(int(h), set()).add(i)
        self.seed_words = np.zeros(len(self.vocab) + 1, bool)
        self.seed_words[list(seeds)] = True
        self.run_items = {h: tuple(x) for h, x in runs.items()}
        self.run_keys = np.array(sorted(runs), np.int64)
        # the different words of all items one after another, and how often each item has them
        self.order = list(self.items)
        place = {i: k for k, i in enumerate(self.order)}
        unique = [np.unique(self.items[i], return_counts=True) for i in self.order]
        self.word = np.concatenate([u for u, _ in unique] or [np.zeros(0, np.int64)])
        self.times = np.concatenate([c for _, c in unique] or [np.zeros(0, np.int64)])
        self.size = np.array([len(u) for u, _ in unique], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.need = np.array([needed(len(self.items[i])) for i in self.order], np.int64)
        # by word: the items of which it is a seed
        posts = sorted((w, place[i]) for w, held in seeds.items() for i in held)
        at, self.seeded = np.array(posts, np.int64).reshape(-1, 2).T
        self.starts = np.searchsorted(at, np.arange(len(self.vocab) + 2))

    def _holding(self, there: np.ndarray) -> list[int]:
        """Items with a seed among the words that are there, of which four fifths are there."""
        w = np.flatnonzero(there & self.seed_words)
        if not len(w):
            return []
        items = np.unique(self.seeded[_ranges(self.starts[w], self.starts[w + 1] - self.starts[w])])
        at = _ranges(self.first[items], self.size[items])
        held = np.add.reduceat(self.times[at] * there[self.word[at]], np.cumsum(self.size[items]) - self.size[items])
        return [self.order[k] for k in items[held >= self.need[items]]]

    @staticmethod
    def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(h):
            return h[:0]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return h[keys[at] == h]

    def find(self, text: str | None) -> list[int]:
        if not text or not self.items:
            return []
        ws = words(text)
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        known = ids > 0
        if not known.any():
            return []
        found = set()
        whole = np.convolve(known, np.ones(RUN, np.int64), "valid") == RUN if len(ids) >= RUN else np.zeros(0, bool)
        if whole.any():
            for h in self._among(grams(ids, RUN)[whole], self.run_keys):
                found.update(self.run_items[int(h)])
        there = np.zeros(len(self.vocab) + 1, bool)
        there[ids] = True
        there[0] = False
        for i in self._holding(there):
            if i not in found and leaked(self.items[i], ids):
                found.add(i)
        return sorted(found)


def _own_words(items: DataFrame) -> DataFrame:
    """own_words() as a table: (item_id, ws)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, x in enumerate(_SENTENCE.split(t or "")) if (w := words(x))]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.list_(pa.string()))], names=["item_id", "k", "ws"])

    parts = written(items.mapInArrow(cut, "item_id bigint, k int, ws array<string>"), "leak-sentences")
    own = parts.groupBy("ws").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).filter("a = b").select("ws")
    return parts.join(own, "ws", "left_semi").groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ws"))), lambda x: x["ws"])).alias("ws"))


def _by_join(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """corpus: doc_id, text; items: item_id, text -> (doc_id, item_id), with the seeds as a table."""
    own = written(_own_words(items), "leak-items")
    held = own.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count("*").alias("held"))
    each = own.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w")).groupBy("item_id", "n", "w").agg(F.count("*").alias("times")).join(held, "w")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, w) for i, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in seeds_of([x["w"] for x in ws for _ in range(x["times"])], {x["w"]: x["held"] for x in ws})]
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], names=["item_id", "seed"])

    def run_seeds(ws: list[str]) -> set[str]:
        return {" ".join(ws[k : k + RUN]) for k in range(len(ws) - RUN + 1)}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, g) for i, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for g in run_seeds(ws)]
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], names=["item_id", "seed"])

    lists = each.groupBy("item_id").agg(F.collect_list(F.struct("w", "times", "held")).alias("ws"))  # as long as an item
    seeds = lists.mapInArrow(rare, "item_id bigint, seed string").unionByName(own.select("item_id", "ws").mapInArrow(runs, "item_id bigint, seed string"))
    seeds = written(seeds.select("item_id", F.xxhash64("seed").alias("seed")).distinct(), "leak-seeds")
    texts = corpus.filter("text is not null").withColumn("key", F.sha2("text", 256))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ws = words(t)
                for g in set(ws) | run_seeds(ws):
                    at.append(k)
                    out.append(g)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(out, pa.string())], names=["key", "seed"])

    once = texts.select("key", "text").dropDuplicates(["key"])
    grams_ = once.mapInArrow(keyed, "key string, seed string").select("key", F.xxhash64("seed").alias("seed"))
    pairs = written(grams_.join(seeds, "seed").select("key", "item_id").distinct(), "leak-pairs")
    full = pairs.join(own, "item_id").join(once, "key").select("key", "item_id", "ws", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(Index({0: ws}).find(t)) for ws, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["key", "item_id"]).filter(pa.array(keep, pa.bool_()))

    hits = written(full.mapInArrow(check, "key string, item_id bigint"), "leak-hits")
    return texts.join(hits, "key").select("doc_id", "item_id")


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id) of every document and test item that leaked into it."""
    asked = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).dropDuplicates(["item_id"])
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = asked.limit(block + 1).collect()
    if len(rows) > block:
        return _by_join(corpus, asked)
    shipped = docs.sparkSession.sparkContext.broadcast(Index(own_words([tuple(r) for r in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            ids, at = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for i in index.find(t):
                    at.append(k)
                    ids.append(i)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids, pa.int64())], names=["doc_id", "item_id"])

    return corpus.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id bigint")

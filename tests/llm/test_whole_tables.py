"""Queries without SQL, over all rows of the smallest tables, against plain versions of what they compute."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
queries = pytest.importorskip("fathomline.llm.queries")
from compare import SF  # noqa: E402

from fathomline.llm import leaks, personal, tokens  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_p8_equals_the_public_encoder(spark):
    import tiktoken

    entries = tokens.read_ranks()
    theirs = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={w: i for i, w in enumerate(entries)}, special_tokens={})
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, SF).collect()}
    assert got == {i: theirs.encode_ordinary(t or "") for i, t in rows(spark, "documents", "doc_id", "text")}


def test_p9_equals_the_alignment_of_every_item_with_every_text(spark):
    own = leaks.own_words(rows(spark, "benchmark", "item_id", "text"))
    vocab: dict[str, int] = {}
    number = lambda ws: np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int64)
    items = {i: number(ws) for i, ws in own.items() if ws}
    want = set()
    for doc, text in rows(spark, "documents", "doc_id", "text"):
        ids = number(leaks.words(text or ""))
        spelt = f" {' '.join(map(str, ids))} "
        for i, item in items.items():
            run = any(f" {' '.join(map(str, item[k : k + leaks.RUN]))} " in spelt for k in range(len(item) - leaks.RUN + 1))
            # in order and anywhere: no alignment can have more, so most pairs need none
            if run or (np.isin(item, ids).sum() >= leaks.SHARE * len(item) and leaks.aligned(item, ids) >= leaks.SHARE * len(item)):
                want.add((doc, i))
    got = {tuple(r) for r in queries.p9_found(spark, SF).collect()}
    assert got == want and want


def test_p5_places_are_what_they_say(spark):
    texts = {}
    for tab, key in (("documents", "doc_id"), ("slack_messages", "msg_id"), ("chunks", "chunk_id")):
        texts |= {(tab, str(k)): t for k, t in rows(spark, tab, key, "text") if t}
    found = [tuple(r) for r in queries.p5_found(spark, SF).collect()]
    # clean addresses, found by a plain expression; every one is a place
    plain = re.compile(r"(?<![\w.%+@-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-]|\.\w|:[\w~/]|@)")
    want = {(*k, m.start() + 1) for k, t in texts.items() for m in plain.finditer(t)}
    assert want <= {(a, b, s) for a, b, k, s in found if k == "email"}
    # clear identity numbers, whatever is beside them
    nino = re.compile(r"(?<![\w.#/+-])(?<!\d )[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w]|[-./]\w| \d)")
    assert {(*k, m.start() + 1) for k, t in texts.items() for m in nino.finditer(t)} <= {(a, b, s) for a, b, k, s in found if k == "idnum"}
    # what is replaced is only what was found
    for r in queries.p5_redacted(spark, SF).collect():
        if r.text is None:
            continue
        n = sum(r.text.count(p) for p in personal.PLACEHOLDER.values())
        assert n == len({x for x in found if x[:2] == (r.tab, r.row_key)}) or (r.tab, r.row_key) not in texts

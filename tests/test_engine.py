"""Operators of the retrieval engine on small fixtures."""

import hashlib
import json
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import config
from fathomline.functions import text as tx
from fathomline.operators import changes, chunkers, code, evaluate, render, router, search, windows
from fathomline.sources import files, pages
from fathomline.sources.store import ChunkStore


def test_route(spark):
    asked = [("Why did we switch from REST?", "all"), ("bug in parser", "all"), ("see #general", "all"), ("what we discussed last week", "all"), ("where is foo called", "all"), ("zzz", "all"), ("bug", "code"), ("how does it work", "nope")]
    got = [r[0] for r in spark.createDataFrame(asked, "q string, s string").select(router.route(F.col("q"), F.col("s"))).collect()]
    assert got[0] == ["pr_diffs", "pr_discussions"] and got[1][0] == "issue_descriptions" and got[2] == ["slack_messages", "code_chunks"]
    assert got[3] == ["session_logs"] and got[4] == ["code_chunks", "pr_diffs"] and got[5] == list(router.ALL) and got[6] == ["code_chunks"] and got[7] == ["code_chunks"]


def test_boost_and_cap(spark):
    hits = spark.createDataFrame([(1, "a", 0.60, 1, "x"), (1, "b", 0.55, 2, "mine"), (1, "c", 0.10, 3, "x")], "qid int, chunk_id string, score double, rank int, repo string").withColumn("prefer_repo", F.lit("mine"))
    order = [r.chunk_id for r in search.prefer_repo(hits, 0.15).orderBy("rank").collect()]
    assert order == ["b", "a", "c"]
    capped = spark.createDataFrame([(1, f"c{i}", i, "foo") for i in (1, 2, 3)] + [(1, "c4", 4, "bar")], "qid int, chunk_id string, rank int, source_key string")
    assert [(r.chunk_id, r["rank"]) for r in search.cap_sources(capped, 2).orderBy("rank").collect()] == [("c1", 1), ("c2", 2), ("c4", 3)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    rows = [("c", i, [float(x) for x in r]) for i, r in enumerate(v)] + [("c", 1000, None), ("c", 1001, [0.0] * 8), ("d", 2000, [1.0])]
    items = spark.createDataFrame(rows, "collection string, chunk_id bigint, embedding array<double>").repartition(5)
    asked = items.filter("chunk_id % 100 = 0 and chunk_id < 300").select(F.col("chunk_id").alias("qid"), "embedding")
    got = {}
    for r in search.nearest(items, asked, 7).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.chunk_id
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 100, 200):
        s = np.round(n @ n[q], 9)
        assert [got[q][k] for k in range(1, 8)] == sorted(range(300), key=lambda i: (-s[i], i))[:7]
    assert search.nearest(items.limit(0), asked, 3).count() == 0 and search.nearest(items, asked.limit(0), 3).count() == 0


def _stored(spark, root, chunks, buckets=4):
    """Chunks (collection, chunk_id, text) as a store with postings, and what search.bm25 takes of it."""
    schema = f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, collection string, text string"
    posting = search.POSTING.replace("chunk_id string", schema.split(",")[0])
    store = ChunkStore(spark, str(root), schema, derived={"postings": (posting, lambda df: search.posting_rows(df, buckets))})
    store.merge(chunks)
    sizes = store.read().withColumn("n", F.size(search.tokens(F.col("text")))).groupBy("collection").agg(F.count("*").alias("n"), F.avg("n").alias("avg_length"))
    return store, lambda asked, k: search.bm25(lambda w: store.read_derived("postings", where=w), sizes, asked, k, buckets)


def test_bm25_prefers_rare_terms_and_handles_blanks(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 1, "alpha beta beta"), ("d", 2, "beta gamma"), ("d", 3, ""), ("d", 4, None), ("d", 5, "gamma"), ("e", 6, "alpha")], "collection string, chunk_id bigint, text string")
    asked = spark.createDataFrame([(1, "Alpha BETA"), (2, ""), (3, None), (4, "nowhere")], "qid int, query string")
    store, best = _stored(spark, tmp_path / "i", chunks)
    assert [(r.qid, r.collection, r.chunk_id) for r in best(asked, 5).orderBy("qid", "collection", "rank").collect()] == [(1, "d", 1), (1, "d", 2), (1, "e", 6)]
    # routed: each query in its own collections only
    assert [(r.qid, r.chunk_id) for r in best(asked.withColumn("collection", F.lit("e")), 5).collect()] == [(1, 6)]
    assert best(asked.limit(0), 5).count() == 0
    # postings follow their chunks: replaced and deleted ones aren't found
    store.merge(spark.createDataFrame([("d", 1, "delta")], "collection string, chunk_id bigint, text string"))
    store.delete(spark.createDataFrame([("e", 6)], "collection string, chunk_id bigint"))
    assert [(r.qid, r.chunk_id) for r in best(asked, 5).collect()] == [(1, 2)]


@pytest.mark.parametrize(("queries", "held"), [(2048, 100_000), (2048, 7), (0, 7)])
def test_bm25_against_brute_force(spark, tmp_path, monkeypatch, queries, held):
    monkeypatch.setattr(search, "MATRIX_QUERIES", queries)  # as matrices, or joined
    monkeypatch.setattr(search, "HELD", held)
    import math
    import random

    rng = random.Random(7)
    docs = {i: [f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 40))] for i in range(80)}
    ask = {q: [f"t{rng.randrange(60)}" for _ in range(5)] for q in range(12)}
    _, best = _stored(spark, tmp_path / "i", spark.createDataFrame([("d", i, " ".join(t)) for i, t in docs.items()], "collection string, chunk_id bigint, text string"))
    got = {}
    for r in best(spark.createDataFrame([(q, " ".join(t)) for q, t in ask.items()], "qid int, query string"), 7).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.chunk_id
    mean = sum(map(len, docs.values())) / len(docs)

    def score(q, i):
        total = 0.0
        for t in set(ask[q]):
            df, tf = sum(t in d for d in docs.values()), docs[i].count(t)
            total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
        return round(total, 9)

    for q in ask:
        want = [i for i in sorted(docs, key=lambda i: (-score(q, i), i)) if score(q, i) > 0][:7]
        assert [got[q][k] for k in sorted(got[q])] == want


def test_infer_repo(spark):
    at = spark.createDataFrame([("/w/a/b/c",), ("/w/ab",), ("/x",)], "cwd string")
    repos = spark.createDataFrame([("/w/a", "a"), ("/w/a/b/", "b"), ("/w", "w")], "repo_path string, name string")
    assert {r.cwd: r.name for r in search.infer_repo(at, repos).collect()} == {"/w/a/b/c": "b", "/w/ab": "w"}


def test_sections_and_packing():
    assert [s[0] for s in chunkers.sections("# Top\nx\n## Middle\ny\n### Bottom\nz\n##### no\nq")] == ["Top", "Top > Middle", "Top > Middle > Bottom"]
    assert chunkers.sections("# A\n### B\nx\n### C\ny") == [("A > B", "x", 3), ("A > B > C", "y", 3)]  # a skipped level nests
    assert chunkers.paragraphs("a\n\n \n\nb\n\n\x0b\n\n\n  c\n") == [("Paragraph 1", "a", 0), ("Paragraph 2", "b", 0), ("Paragraph 3", "c", 0)]
    assert chunkers.paragraphs("\n\n a") == [("Paragraph 2", "a", 0)] and chunkers.paragraphs(" \n ") == []
    long = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(100)) for i in range(5))
    pieces = chunkers.pack(long, 400, 40)
    assert all(len(p) <= 400 + 200 for p in pieces) and all(w in " ".join(pieces) for w in long.split())
    assert chunkers.pack("short", 400, 40) == ["short"]


def test_document_chunk_ids(spark):
    df = spark.createDataFrame([(1, "# A\nx\n# B\ny", "d/f.md"), (2, None, "f.md"), (3, " ", "f.txt")], "k int, text string, path string")
    got = chunkers.document_chunks(df, "k", "text", "path").orderBy("chunk_index").collect()
    assert [(r.k, r.section_path, r.chunk_id) for r in got] == [(1, s, hashlib.sha256(f"doc:d/f.md:{s}:{i}".encode()).hexdigest()[:16]) for i, s in enumerate(("A", "B"))]


def test_code_entities():
    py = '"""A module about things that matter a lot."""\nimport os\n\n# says hello\nclass A:\n    def f(self):\n        def inner(): pass\n\n@deco\ndef g(): pass\n'
    got = {(r[5], r[6], r[11]): r[3] for r in code.chunk_file("r", "x.py", py, "python")}
    assert set(got) == {("x.py", "module_doc", None), ("A", "class_definition", None), ("f", "function_definition", "A"), ("g", "decorated_definition", None)}
    assert got["A", "class_definition", None].startswith("# says hello\nclass A") and got["f", "function_definition", "A"].startswith("# In class A\n")
    assert [r[6] for r in code.chunk_file("r", "x.yml", "a: 1", "yaml")] == ["file"] and code.chunk_file("r", "x.py", "  ", "python") == []
    assert [r[5] for r in code.chunk_file("", "m.tf", 'resource "a" "b" {\n}\nlocals {\n}\n', "terraform")] == ["resource.a.b", "locals"]
    big = code.chunk_file("r", "x.go", "package x\nfunc F() {\n" + "\tg()\n" * 1000 + "}\n", "go")
    assert big[0][3].endswith("\n# ... (truncated)") and len(big[0][3]) == 2048 + 18


def test_windows_across_buckets(spark):
    rows = [("a", t, i) for i, t in enumerate([0, 10, 99, 100, 101, 250, 260, 500])] + [("b", 7, 100)]
    df = spark.createDataFrame(rows, "k string, us bigint, id bigint").withColumn("bucket", F.floor(F.col("us") / 100))
    got = [(r.k, r.us, r.rn, r.break_rn) for r in windows.segments(df, ["k"], ["us", "id"], "bucket", gap=("us", 90)).orderBy("k", "us").collect()]
    assert got == [("a", 0, 1, 1), ("a", 10, 2, 1), ("a", 99, 3, 1), ("a", 100, 4, 1), ("a", 101, 5, 1), ("a", 250, 6, 6), ("a", 260, 7, 6), ("a", 500, 8, 8), ("b", 7, 1, 1)]
    flags = df.withColumn("f", F.col("us").isin(10, 250))
    assert [r.break_rn for r in windows.segments(flags, ["k"], ["us", "id"], "bucket", flag="f").orderBy("k", "us").collect()] == [None, 2, 2, 2, 2, 6, 6, 6, None]


def test_chat_and_sessions(spark):
    m = spark.createDataFrame(
        [("c", "gen", "1.0", 1_000_000, 1, "@a: hi", "a", None), ("c", "gen", "2.0", 2_000_000, 2, None, "b", None), ("c", "gen", "9000.0", 9_000_000_000, 3, "@a: later", "a", None),
         ("c", "gen", "3.0", 3_000_000, 4, "@a: root", "a", "3.0"), ("c", "gen", "4.0", 4_000_000, 5, "@b: reply", "b", "3.0"), ("d", "x", "1.0", 1_000_000, 6, None, "a", None)],
        "channel_id string, channel_name string, ts string, us bigint, msg_id bigint, line string, author string, root string",
    )
    got = {(r.chunk_type, r.ts): (r.text, r.participants, r.permalink_path) for r in chunkers.chat_chunks(m).collect()}
    assert got["slack_window", "1.0"] == ("[#gen] conversation:\n@a: hi", ["a", "b"], "archives/c/p10") and got["slack_thread", "3.0"][0] == "[#gen] thread:\n@a: root\n@b: reply" and len(got) == 3
    e = spark.createDataFrame(
        [("s", 1, 1, None, "before"), ("s", 2, 2, "p1", None), ("s", 3, 3, None, "a1"), ("s", 4, 4, "", None), ("s", 5, 5, None, "a2"), ("s", 6, 6, "p2", None), ("s", 86_400_000_007, 7, "p3", None), ("s", 86_400_000_008, 8, None, "a3")],
        "session_id string, us bigint, entry_id bigint, prompt string, answer string",
    )
    got = [(r.turn_index, r.text) for r in chunkers.session_chunks(e).orderBy("turn_index").collect()]
    assert got == [(0, "User: p1\n\nAssistant: a1\n\na2"), (1, "User: p3\n\nAssistant: a3")]


def test_hunks_mentions_changes(spark, rows):
    p = spark.createDataFrame([("x\n@@ a\n+1\n@@ b\n-1",), ("",), (None,)], "p string")
    assert [r[0] for r in p.select(F.size(chunkers.hunks(F.col("p")))).collect()] == [3, 0, 0]
    df = spark.createDataFrame([(1, "hi <@U1> and <@U2> <@U1>"), (2, "none"), (3, None)], "k int, t string")
    users = spark.createDataFrame([("U1", "ann")], "user_id string, name string")
    assert {r.k: r.t for r in chunkers.with_mentions(df, "t", users, ["k"]).collect()} == {1: "hi @ann and @U2 @ann", 2: "none", 3: None}
    old, new = (spark.createDataFrame(x, "k string, h string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("b", "2"), ("c", "1"), ("d", "1")]))
    assert rows(changes.file_changes(old, new, ["k"], "h")) == [("a", "removed"), ("b", "changed"), ("d", "added")]
    assert rows(changes.upsert(old, new, ["k"])) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]


def test_metrics(spark):
    cases = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"]), (3, [])], "qid int, expected array<string>")
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (3, 1, "q")], "qid int, rank int, item string")
    got = {r.qid: (round(r.precision, 3), round(r.recall, 3), r.reciprocal_rank) for r in evaluate.metrics(cases, results, 3).collect()}
    assert got == {1: (0.667, 0.667, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert evaluate.summary(evaluate.metrics(cases.limit(0), results, 3)).first().n_queries == 0


def test_render(spark):
    hits = spark.createDataFrame([(1, 1, "x\ny", "description", 7, "T", "ann", None), (1, 2, "\n".join(map(str, range(60))), None, None, None, None, "f.py")], "qid int, rank int, text string, chunk_type string, issue_number int, issue_title string, issue_author string, file_path string")
    answer = render.render(hits).first().answer
    assert answer.startswith("### 1. [Issue #7] T (by ann)\n```\nx\ny\n```\n") and "(f.py)" in answer and answer.rstrip().endswith("# ... (truncated)\n```")


def test_ids_and_text(spark):
    df = spark.createDataFrame([("a/b", "2026-03-02T12:00:00.000+0000")], "x string, t string")
    r = df.select(tx.chunk_id("doc", F.col("x"), "0").alias("i"), tx.uuid5_url(F.col("x")).alias("u"), tx.jql_date(F.col("t")).alias("d")).first()
    assert r.i == hashlib.sha256(b"doc:a/b:0").hexdigest()[:16] and r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/b")) and r.d == "2026/03/02 12:00"
    assert tx.jql_since("project = A ORDER BY x", "d").endswith('AND updated >= "d" ORDER BY x') and tx.since_days("30d") == 30
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Hello "}, {"type": "text", "text": "world"}]}, {"type": "paragraph", "content": []}, {"type": "heading", "content": [{"type": "text", "text": "H"}]}]}
    assert tx.tree_text(tree) == "Hello world\n\nH" and tx.tree_text(None) == "" and tx.tree_text("plain") == "plain"
    deep = {"type": "text", "text": "x"}
    for _ in range(5000):
        deep = {"type": "paragraph", "content": [deep]}
    assert tx.tree_text(deep) == "x"
    assert [r[0] for r in spark.createDataFrame([(json.dumps(tree),), (None,), ("raw",)], "s string").select(tx.adf_text("s")).collect()] == ["Hello world\n\nH", "", "raw"]
    p = spark.createDataFrame([("a/x.min.js",), ("vendor/a.py",), ("src/vendor/a.py",), ("k/My Project/a.vb",), ("keep.min.js",)], "p string")
    got = [r[0] for r in p.select(tx.ignored(F.col("p"), [*files.EXCLUDED, "!keep.min.js"])).collect()]
    assert got == [True, True, False, True, False]


def test_store(spark, tmp_path, rows):
    s = ChunkStore(spark, f"{tmp_path}/t", "chunk_id string, collection string, text string", compact_at=3)
    assert s.read("docs").count() == 0
    make = lambda *x: spark.createDataFrame(list(x), "chunk_id string, collection string, text string")
    s.merge(make(("a", "docs", "1"), ("b", "docs", "1"), ("a", "code", "1")))
    s.merge(make(("a", "docs", "2"), ("c", "docs", "1")))
    s.merge(make(("a", "docs", "2"), ("c", "docs", "1")))  # again: nothing changes
    assert rows(s.read()) == [("a", "code", "1"), ("a", "docs", "2"), ("b", "docs", "1"), ("c", "docs", "1")]
    s.delete(make(("b", "docs", ""), ("zz", "docs", "")).select("chunk_id", "collection"))
    assert rows(s.read("docs").select("chunk_id")) == [("a",), ("c",)]
    s.drop("code")
    assert rows(s.count()) == [("docs", 2)]
    for k in range(6):  # folded into one segment now and then, nothing changes
        s.merge(make(("a", "docs", str(k)), (f"n{k}", "docs", "1")))
        assert len(s.segments()) <= 4 and {r.chunk_id: r.text for r in s.read().collect()} == {"a": str(k), "c": "1"} | {f"n{i}": "1" for i in range(k + 1)}
    s.compact()
    assert len(s.segments()) == 1 and s.read().count() == 8 and not s._names("gone")


def test_a_small_merge_writes_little_and_a_dead_one_nothing(spark, tmp_path, rows):
    size = lambda: sum(p.stat().st_size for p in Path(tmp_path, "t").rglob("*.parquet"))
    s = ChunkStore(spark, f"{tmp_path}/t", "chunk_id string, collection string, text string")
    text = F.sha2(F.col("id").cast("string"), 256)
    s.merge(spark.range(100_000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("docs").alias("collection"), text.alias("text")))
    before = size()
    s.merge(spark.range(50, 150).select(F.col("id").cast("string").alias("chunk_id"), F.lit("docs").alias("collection"), F.lit("new").alias("text")))
    assert size() - before < 0.05 * before and s.read().count() == 100_000 and s.read().filter("text = 'new'").count() == 100
    s._add(s._next(), spark.createDataFrame([("50", "docs", "dead")], "chunk_id string, collection string, text string"))  # a run that dies before its commit
    assert s.read().count() == 100_000 and s.read().filter("text = 'dead'").count() == 0
    s.merge(spark.createDataFrame([("50", "docs", "alive")], "chunk_id string, collection string, text string"))
    assert [r.text for r in s.read().filter("chunk_id = '50'").collect()] == ["alive"] and s.read().count() == 100_000


def test_files(spark, tmp_path):
    assert files.discover(spark, str(tmp_path)).count() == 0
    for name, body in {"a.py": b"\xef\xbb\xbfx = '\xff'", "b.min.js": b"x", "node_modules/c.js": b"x", "d.bin": b"x", "big.py": b"x" * 100, "docs/e.md": b"# T", "pkg/__init__.py": b"", ".hid/_x.py": b"y", "out/gen.py": b"x", "out/keep.py": b"k", "lib/sub/tmp.py": b"x",
                       ".gitignore": b"# rules\nout/*\n!out/keep.py\n", "lib/.gitignore": b"tmp.py\n", "tmp.py": b"t", ".git/hooks.py": b"x"}.items():
        p = Path(tmp_path, name)
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(body)
    got = {r.file_path: r.text for r in files.discover(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"a.py": "x = '�'", "pkg/__init__.py": "", ".hid/_x.py": "y", "out/keep.py": "k", "tmp.py": "t"}
    assert [r.file_path for r in files.documents_below(spark, str(tmp_path), config.Documents().globs).collect()] == ["docs/e.md"]
    Path(tmp_path, "s.jsonl").write_text('{"type": "user"}\nbroken\n{"type": "x"}\n')
    assert files.json_lines(spark, str(tmp_path)).count() == 2


def test_pages(spark, tmp_path):
    Path(tmp_path, "1.json").write_text(json.dumps({"items": [{"id": 3, "updated_at": "2025-03"}, {"id": 2, "updated_at": "2025-02"}], "next": "2.json"}))
    Path(tmp_path, "2.json").write_text(json.dumps({"items": [{"id": 1, "updated_at": "2025-01"}], "next": None}))
    pages.register(spark)
    df = spark.read.format("paged_api").option("addresses", f"{tmp_path}/1.json").option("since", "2025-02").load()
    assert sorted(json.loads(r.value)["id"] for r in df.collect()) == [2, 3]
    assert pages.next_link('<http://a>; rel="prev", <http://b>; rel="next"') == "http://b" and pages.next_link(None) is None
    calls = []

    def flaky(at, options):
        calls.append(at)
        if len(calls) < 3:
            raise pages.Retry(after=0)
        return [{"id": 1}], None

    assert list(pages.walk("x", flaky, {}, pause=lambda s: None)) == [{"id": 1}] and len(calls) == 3


@pytest.fixture
def service():
    """A service that pages by link, by token and by cursor, is busy now and then, and wants a secret."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    busy = set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            at, base = urlsplit(self.path), f"http://127.0.0.1:{self.server.server_port}"
            q = {k: v[0] for k, v in parse_qs(at.query).items()}
            headers, code = {}, 200
            if self.headers.get("Authorization") != "Bearer hush":
                code, answer = 403, {}
            elif at.path == "/issues":
                n = int(q.get("page", 1))
                answer = [{"number": k, "updated_at": f"2025-0{9 - k}", "comments_url": f"{base}/comments/{k}", "state": "open" if k % 2 else "closed"} for k in (2 * n - 1, 2 * n)]
                headers = {"Link": f'<{base}/issues?page={n + 1}>; rel="next"'} if n < 3 else {}
            elif at.path.startswith("/comments/"):
                answer = [{"body": f"said on {at.path[-1]}"}]
            elif at.path == "/search":
                answer = {"issues": [{"key": q.get("nextPageToken", "first")}], "nextPageToken": {"first": "second", "second": "third"}.get(q.get("nextPageToken", "first"))}
            else:
                answer = {"messages": [{"ts": q.get("cursor", "0"), "channel": q["channel"]}], "response_metadata": {"next_cursor": "" if q.get("cursor") else "1"}}
            if code == 200 and self.path not in busy and "page=2" in self.path:
                busy.add(self.path)
                code, answer, headers = 429, {}, {"Retry-After": "0"}
            raw = json.dumps(answer).encode()
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_services(spark, service, monkeypatch):
    import urllib.error

    monkeypatch.setenv("SECRET_OF_TEST", "hush")
    read = lambda kind, at, **more: [x for a in at for x in pages.walk(f"{service}{a}", pages.http_page, pages.options_of(kind, secret="SECRET_OF_TEST", **more), pause=lambda s: None)]
    got = read("issues", ["/issues"])
    assert [x["number"] for x in got] == [1, 2, 3, 4, 5, 6] and got[3]["comments_list"] == [{"body": "said on 4"}]
    assert [x["number"] for x in read("issues", ["/issues"], only={"state": ["closed"]}, children={})] == [2, 4, 6]
    assert [x["number"] for x in read("prs", ["/issues"], children={}, since="2025-06")] == [1, 2, 3]  # the list descends: the third page isn't asked for
    assert [x["key"] for x in read("tickets", ["/search"])] == ["first", "second", "third"]
    assert [(x["channel"], x["ts"]) for x in read("messages", ["/history?channel=a", "/history?channel=b"])] == [("a", "0"), ("a", "1"), ("b", "0"), ("b", "1")]
    with pytest.raises(urllib.error.HTTPError):
        list(pages.walk(f"{service}/issues", pages.http_page, pages.options_of("issues")))
    with pytest.raises(pages.Retry):
        list(pages.walk("http://127.0.0.1:9/none", pages.http_page, {"tries": "2"}, pause=lambda s: None))
    pages.register(spark)
    df = spark.read.format("paged_api").options(**pages.options_of("messages", headers={"Authorization": "Bearer hush"}), addresses=f"{service}/history?channel=a {service}/history?channel=b").load()
    assert sorted(json.loads(r.value)["channel"] for r in df.collect()) == ["a", "a", "b", "b"] and df.rdd.getNumPartitions() == 2


def test_records_as_services_send_them(spark, tmp_path):
    from fathomline.sources import landed

    make = lambda *x: spark.createDataFrame([("r", json.dumps(v) if v is not None else "broken") for v in x], "source string, value string")
    issue = {"number": 1, "title": "T", "body": None, "state": "open", "user": {"login": "ann"}, "labels": [{"name": "bug"}], "created_at": "1", "updated_at": "2", "comments_list": [{"body": "b", "user": None, "created_at": "3"}]}
    flat, said = landed.issues(make(issue, {**issue, "number": 2, "pull_request": {"url": "x"}, "comments_list": []}, None), "source")
    assert [(r.issue_number, r.author_login, r.labels, r.pull_request) for r in flat.orderBy("issue_number").collect()] == [(1, "ann", ["bug"], None), (2, "ann", ["bug"], '{"url":"x"}')]
    assert [tuple(r) for r in said.collect()] == [("r", 1, 0, None, "b", "3")]
    prs, changed, talk = landed.changes(make({"number": 5, "title": "P", "files": [{"filename": "a.py", "status": "added", "patch": "@@"}], "comments": [{"body": "nit", "path": "a.py", "user": {"login": "bob"}}]}), "source")
    assert prs.first().pr_number == 5 and changed.first().filename == "a.py" and talk.first().user == "bob"
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "x"}]}]}
    ticket, notes = landed.tickets(make({"key": "K-1", "fields": {"summary": "S", "description": tree, "status": {"name": "open"}, "reporter": {"displayName": "Ann"}, "labels": ["l"], "updated": "u", "comment": {"comments": [{"author": {"displayName": "Bob"}, "body": tree, "created": "c"}]}}}), "source")
    assert json.loads(ticket.first().description) == tree and ticket.first().reporter == "Ann" and json.loads(notes.first().body) == tree
    assert landed.pages(make({"id": "p", "title": "T", "lastEditedAt": None})).first().last_edited_at == ""
    assert landed.messages(make({"ts": "1.0", "user": "U1", "text": "hi"}), "source").first().channel_id == "r" and landed.users(make({"id": "U1", "name": "a", "profile": {"display_name": "A"}})).first().display_name == "A"
    folder = Path(tmp_path, "proj")
    folder.mkdir()
    lines = [{"type": "user", "message": {"role": "user", "content": "go"}, "cwd": "/w"}, "broken", {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "done"}]}}, {"type": "summary"}]
    Path(folder, "s1.jsonl").write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    got = landed.session_entries(files.json_lines(spark, str(tmp_path))).orderBy("entry_id").collect()
    assert [(r.session_id, r.folder, r.entry_id, r.entry_type) for r in got] == [("s1", "proj", 1, "user"), ("s1", "proj", 2, "assistant"), ("s1", "proj", 3, "summary")] and json.loads(got[0].message)["content"] == "go"


def test_config(tmp_path):
    user, project = tmp_path / "u.yaml", tmp_path / "p.yaml"
    user.write_text("retrieval: {top_k: 7, final_k: 3, unknown: 1}\nother: 2\n")
    project.write_text("retrieval: {top_k: 9}\ncode: {exclude: ['x']}\n")
    c = config.load(str(project), str(user))
    assert (c.retrieval.top_k, c.retrieval.final_k, c.retrieval.rrf_k, c.code.exclude) == (9, 3, 60, ("x",))
    config.put(str(project), "chat.gap_minutes", "5")
    assert "gap_minutes: '5'" in project.read_text()
    c = config.load(str(project))
    assert c.chat.gap_minutes == 5 and c.retrieval.rerank is True
    for key, value, got in (("retrieval.rerank", "false", False), ("retrieval.repo_boost", "0.3", 0.3), ("issues.include_labels", "bug, perf", ("bug", "perf"))):
        config.put(str(project), key, value)
        section, name = key.split(".")
        assert getattr(getattr(config.load(str(project)), section), name) == got
    config.put(str(project), "retrieval.rerank", "perhaps")
    with pytest.raises(ValueError):
        config.load(str(project))


def test_stream_of_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    from fathomline.streaming.chat import gap_windows, merge_batches

    t0 = datetime(2025, 1, 1)
    make = lambda rows: spark.createDataFrame(rows, "channel_id string, ts timestamp")
    make([("a", t0), ("a", t0 + timedelta(seconds=60)), ("a", t0 + timedelta(seconds=4000)), ("b", t0), (None, t0)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    make([("a", t0 + timedelta(days=2)), ("b", t0 + timedelta(days=2))]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    make([("z", t0 + timedelta(days=9))]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("channel_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = merge_batches(gap_windows(stream), lambda b: b.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = sorted((r.channel_id, r.n_messages) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1)]

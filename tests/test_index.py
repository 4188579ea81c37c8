"""The engine end to end on a small folder."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomline import config
from fathomline.engine import Engine, main
from fathomline.operators import changes, encoders, evaluate


def put(root, name, body):
    p = Path(root, name)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(body)


def test_index_search_change_remove(spark, tmp_path):
    src, e = tmp_path / "src", Engine(spark, f"{tmp_path}/index")
    put(src, "auth.py", "def login(user):\n    return check_password(user)\n\ndef logout(user):\n    pass\n")
    put(src, "db.py", "class Database:\n    def connect(self):\n        return open_socket()\n")
    put(src, "guide.md", "# Guide\nHow to reset a password.\n## Deep\nNothing here.\n")
    put(src, "vendor/x.py", "def vendored(): pass\n")
    code, docs = e.index_repo(str(src), "app")
    counts = lambda **x: dict.fromkeys(changes.COUNTERS, 0) | x
    assert code.first().asDict() == counts(files_scanned=2, files_indexed=2, chunks_created=4) and docs.first().files_indexed == 1
    assert {r.collection: (r.n_chunks, r.n_files) for r in e.status().collect()} == {"code_chunks": (4, 2), "documents": (2, 1)}
    assert e.index_repo(str(src), "app")[0].first().files_indexed == 0  # nothing changed
    asked = spark.createDataFrame([(1, "check_password login password"), (2, "  "), (3, "zzzz")], "qid int, query string")
    hits = e.search(asked, scope="code", log=True).filter("rank = 1").collect()
    assert {r.qid: r.entity_name for r in hits}[1] == "login"
    answers = {r.qid: r.answer for r in e.answers(asked, scope="docs").collect()}
    assert answers[1].startswith("### 1. [Guide]") and answers[2] == "No results found."
    assert [r.file_path for r in e.search(asked, where={"file_path": "db.py"}, scope="code").filter("qid = 1").select("file_path").distinct().collect()] == ["db.py"]
    (src / "db.py").unlink()
    put(src, "auth.py", "def login(user):\n    return None\n")
    assert e.index_repo(str(src), "app")[0].first().asDict() == counts(files_scanned=1, files_indexed=1, files_removed=1, chunks_created=1)
    assert sorted(r.entity_name for r in e.chunks.read("code_chunks").collect()) == ["login"]
    cases = spark.createDataFrame([(1, "login", ["auth.py"])], "qid int, query string, expected array<string>")
    assert e.evaluate(cases).first().mrr == 1.0
    e.remove_repo("app")
    assert e.chunks.read().count() == 0 and e.state.read().count() == 0


def test_sync(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    issues = "repo string, issue_number int, title string, body string, labels array<string>, updated_at string"
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    first = [("r", 1, "Bug", "broken", ["bug"], "2025-01-01"), ("r", 2, "Old", None, [], "2025-01-02"), ("r", 1, "Bug", "older", [], "2024-01-01")]
    said = make([("r", 1, 0, "ann", "me too"), ("r", 1, 1, "bob", "same")], "repo string, issue_number int, pos int, user string, body string")
    assert e.sync_issues(make(first, issues), said) == 2
    # the second run: one is new, one at the cursor comes again, its comment is gone
    assert e.sync_issues(make([("r", 1, "Bug", "fixed", ["bug"], "2025-02-01"), ("r", 9, "Before", "x", [], "2024-05-05"), ("r", 2, "Old", None, [], "2025-01-02")], issues), said.filter("pos = 0")) == 2
    got = {(r.collection, r.issue_number): r.text for r in e.chunks.read().filter("collection = 'issue_descriptions'").collect()}
    assert got == {("issue_descriptions", 1): "[r #1] Bug\n\nfixed", ("issue_descriptions", 2): "[r #2] Old"}
    assert [r.text for r in e.chunks.read("issue_discussions").collect()] == ["Comment by ann on #1:\n\nme too"]
    pages = "page_id string, title string, url string, last_edited_at string, content string"
    assert e.sync_pages(make([("p", "T", "u", "2025-01-01", "# A\nx"), ("q", "T", "u", "", "y")], pages)) == 2
    assert e.sync_pages(make([("p", "T", "u", "2025-01-01", "# A\nx"), ("q", "T", "u", "", "y")], pages)) == 1  # at the cursor: known; without a time: again
    assert e.sync_tickets(make([("i", "K-1", "S", '{"type": "doc", "content": []}', "2025")], "instance string, ticket_key string, summary string, description string, updated string")) == 1
    prs = make([("r", 5, "P", "b", "2025")], "repo string, pr_number int, title string, body string, updated_at string")
    files = make([("r", 5, 0, "a.py", None, "@@ 1\n+x\n@@ 2\n-y"), ("r", 5, 1, "b.py", "added", None)], "repo string, pr_number int, file_pos int, filename string, status string, patch string")
    talk = make([("r", 5, 0, "ann", "a.py", "nit")], "repo string, pr_number int, pos int, user string, path string, body string")
    assert e.sync_changes(prs, files, talk) == 1
    e.views()
    counts = {r.collection: r.n_chunks for r in spark.sql("select collection, n_chunks from collections").collect()}
    assert counts == {"issue_descriptions": 2, "issue_discussions": 1, "slite_pages": 2, "jira_descriptions": 1, "pr_diffs": 3, "pr_discussions": 1}
    e.reset()
    assert e.status().count() == 0
    assert e.sync_issues(make(first, issues)) == 2  # no cursor is left


def _rows(e, *collections):
    return {r.chunk_id: r for r in e.chunks.read(*collections).collect()}.values()


def test_repositories_apart(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    schema = "repo string, file_path string, hash string, text string"
    for r in "abc":
        e.index_code(spark.createDataFrame([(r, "x.py", "1", f"def {r}():\n    return 1\n")], schema))
    assert sorted(r.repo for r in _rows(e)) == ["a", "b", "c"]
    e.index_code(spark.createDataFrame([("a", "y.py", "1", "def y():\n    return 1\n")], schema))
    assert sorted((r.repo, r.file_path) for r in _rows(e)) == [("a", "y.py"), ("b", "x.py"), ("c", "x.py")]


def test_a_file_that_fails_is_tried_again(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index", config.Config(code=config.Code(doc_comment_max_lines="none")))  # any comment above a function fails
    files = spark.createDataFrame([("a", "good.py", "1", "def good():\n    return 1\n"), ("a", "bad.go", "1", "package a\n\n// one\n// two\nfunc bad() {\n}\n"), ("a", "empty.py", "1", "  ")], "repo string, file_path string, hash string, text string")
    got = e.index_code(files).first()
    assert (got.files_scanned, got.files_indexed, got.files_failed, got.files_empty, got.chunks_created) == (3, 1, 1, 1, 1)
    again = Engine(spark, f"{tmp_path}/index").index_code(files).first()
    assert (again.files_indexed, again.files_skipped, again.files_failed) == (1, 2, 0) and sorted(r.entity_name for r in _rows(e)) == ["bad", "good"]


def test_lifecycle(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    for name in ("one", "two"):
        put(tmp_path / name, "m.py", f"def {name}():\n    return 1\n")
        e.index_repo(str(tmp_path / name), name)
    put(tmp_path / "one", "more.py", "def more():\n    return 1\n")
    (tmp_path / "two").rename(tmp_path / "away")
    assert e.refresh() == [("one", "refreshed"), ("two", "missing")]
    assert sorted(r.entity_name for r in _rows(e)) == ["more", "one", "two"]
    with pytest.raises(FileNotFoundError):
        e.reindex("two")
    with pytest.raises(ValueError):
        e.reindex("three")
    (tmp_path / "away").rename(tmp_path / "two")
    assert e.reindex("two") == [("two", "indexed")] and e.reindex() == [("one", "indexed"), ("two", "indexed")]
    assert sorted(r.entity_name for r in _rows(e)) == ["more", "one", "two"]
    assert e.remove_repo("one") == 2 and e.refresh(full=True) == [("two", "refreshed")]
    put(tmp_path / "loose", "a.md", "# A\ntext\n")
    assert e.index_docs(str(tmp_path / "loose")).first().files_indexed == 1


def test_metadata_is_stored_and_printed(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tickets = make([("https://j", "K-1", "Reset fails", '{"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "zebra"}]}]}', "2025", "open", ["a", "b"])], "instance string, ticket_key string, summary string, description string, updated string, ticket_status string, labels array<string>")
    said = make([("https://j", "K-1", 0, "Ann", '{"type": "text", "text": "quagga"}', "2025"), ("https://j", "K-1", 1, None, None, None)], "instance string, ticket_key string, pos int, author string, body string, created string")
    assert e.sync_tickets(tickets, said) == 1
    got = {r.text: r for r in _rows(e, "jira_discussions")}
    assert set(got) == {"Comment by Ann on K-1:\n\nquagga", "Comment by unknown on K-1:\n\n"} and got["Comment by Ann on K-1:\n\nquagga"].ticket_status == "open"
    e.sync_pages(make([("p", "Runbook", "https://s/p", "2025", "okapi\n## Deep\nfurther text")], "page_id string, title string, url string, last_edited_at string, content string"))
    e.sync_issues(make([("r", 7, "Crash", "bongo", [], "2025", "ann")], "repo string, issue_number int, title string, body string, labels array<string>, updated_at string, author_login string"))
    asked = make([(1, "ticket quagga"), (2, "wiki okapi"), (3, "bug bongo")], "qid int, query string")
    text = {r.qid: r.answer for r in e.answers(asked).collect()}
    assert "[Jira K-1] Comment by Ann" in text[1] and "[Slite] Runbook" in text[2] and "*URL: https://s/p*" in text[2] and "[Issue #7] Crash (by ann)" in text[3]
    assert e.remove_source("https://j:K-1", "jira_descriptions", "jira_discussions") == 3


def test_a_sweep_stops_and_goes_on(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    page = "page_id string, title string, url string, last_edited_at string, content string, status int"
    rows = [("a", "2025-01-01", 200), ("b", "2025-01-02", 200), ("c", "2025-01-02", 200), ("d", "2025-01-03", 404), ("e", "2025-01-04", 200), ("f", "2025-01-04", 503), ("g", "2025-01-05", 200), ("h", "", 200)]
    sweep = lambda rows: e.sync_pages(spark.createDataFrame([(k, "T", "u", t, f"text {k}", s) for k, t, s in rows], page))
    at = lambda: [r.last_synced for r in e.cursor("slite").collect()]
    assert sweep(rows) == 5 and at() == ["2025-01-02"]  # e came before the stop, but f has its time
    assert sweep([(k, t, 200 if s == 503 else s) for k, t, s in rows]) == 4 and at() == ["2025-01-05"]
    assert sorted(r.page_id for r in _rows(e)) == ["a", "b", "c", "e", "f", "g", "h"]


def test_chat_and_sessions_have_cursors(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    chat = "msg_id bigint, channel_id string, ts string, text string, user_id string, thread_ts string, reply_count int, subtype string"
    said = [(1, "c", "1700000000.0", "hello <@U2>", "U1", None, 0, None), (2, "d", "1700000000.0", "other", "U2", None, 0, None)]
    users = spark.createDataFrame([("U1", "ann", None, None), ("U2", "bob", None, None)], "user_id string, handle string, real_name string, display_name string")
    assert e.sync_chat(spark.createDataFrame(said, chat), users) == 2 and e.sync_chat(spark.createDataFrame(said, chat), users) == 0
    assert e.sync_chat(spark.createDataFrame([*said, (3, "c", "1700000060.0", "more", "U2", None, 0, None)], chat), users) == 1
    assert sorted(r.text for r in _rows(e, "slack_messages")) == ["[#c] conversation:\n@ann: hello @bob\n@bob: more", "[#d] conversation:\n@bob: other"]
    log = "session_id string, entry_id bigint, entry_type string, message string, us bigint, cwd string, git_branch string"
    use = '{"role": "assistant", "content": [{"type": "thinking", "thinking": "x"}, {"type": "tool_use", "name": "Read", "input": {"path": "it\'s.py", "n": 3, "deep": {}, "more": 1}}, {"type": "text", "text": "done"}]}'
    entries = [("s", 1, "user", '{"role": "user", "content": "<system-reminder>a</system-reminder> fix it "}', 10**15, "/w/app", "main"), ("s", 2, "assistant", use, 10**15 + 1, "/w/app", "main")]
    assert e.sync_sessions(spark.createDataFrame(entries, log)) == 1 and e.sync_sessions(spark.createDataFrame(entries, log)) == 0
    [r] = _rows(e, "session_logs")
    assert r.text == "User: fix it\n\nAssistant: [tool:Read(path=\"it's.py\", n=..., deep=...)]\n\ndone" and (r.project_dir, r.git_branch) == ("app", "main")


def test_models_take_the_place_of_stand_ins(spark, tmp_path):
    import numpy as np

    cfg = config.Config(embedding=config.Embedding(max_tokens=2, batch_size=2, dim=3))
    seen = lambda texts: np.array([[float(len(t)), "x" in t, 1.0] for t in texts])
    e = Engine(spark, f"{tmp_path}/index", cfg, encoders.model_embedder(lambda: seen, cfg.embedding), encoders.model_reranker(lambda: lambda pairs: [float("pick" in t) for _, t in pairs]))
    files = spark.createDataFrame([("a", f"{n}.md", "1", t) for n, t in (("one", "some words here"), ("two", "pick these words"), ("three", "x"))], "repo string, file_path string, hash string, text string")
    e.index_documents(files)
    assert {r.file_path: list(r.embedding) for r in _rows(e)} == {"one.md": [8.0, 0.0, 1.0], "two.md": [8.0, 0.0, 1.0], "three.md": [1.0, 1.0, 1.0]}
    assert e.search(spark.createDataFrame([(1, "words")], "qid int, query string"), scope="docs").filter("rank = 1").first().file_path == "two.md"

    def broken():
        raise OSError("no model here")

    with pytest.raises(Exception, match="no model here"):
        encoders.model_embedder(broken, cfg.embedding)(files, ["file_path"], "text").collect()
    assert encoders.model_embedder(encoders.or_else(broken, lambda: seen), cfg.embedding)(files, ["file_path"], "text").count() == 3


def test_log_and_files_of_evaluation(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    assert e.metrics().first().total_queries == 0
    e.index_code(spark.createDataFrame([("a", "x.py", "1", "def login():\n    return 1\n"), ("a", "y.py", "1", "def other():\n    return 1\n")], "repo string, file_path string, hash string, text string"))
    e.search(spark.createDataFrame([(1, "where is login called"), (2, "zzz")], "qid int, query string"), log=True)
    m = e.metrics().first()
    assert m.total_queries == 2 and m.avg_total_ms >= m.avg_vector_ms > 0 and m.avg_bm25_ms > 0 and m.avg_rerank_ms > 0 and e.logged(1).count() == 1
    (tmp_path / "cases.jsonl").write_text('{"query": "login", "expected_files": ["x.py"]}\nbroken\n{"query": "other", "expected_files": ["y.py", "z.py"], "expected_prs": [4]}\n')
    cases = evaluate.load_cases(spark, str(tmp_path / "cases.jsonl"))
    found = e.results(cases.select("qid", "query"))
    got = {r.qid: (r.recall, r.reciprocal_rank) for r in evaluate.of_cases(cases, found, 5).collect()}
    assert sorted(got.values()) == [(1 / 3, 1.0), (1.0, 1.0)]
    evaluate.save_results(found, f"{tmp_path}/a"), evaluate.save_results(found.filter("query = 'login' and rank = 1"), f"{tmp_path}/b")
    a, b = evaluate.load_results(spark, f"{tmp_path}/a"), evaluate.load_results(spark, f"{tmp_path}/b")
    assert {r.query: r["items"] for r in a.collect()}["login"][0] == "x.py" and [r.query for r in evaluate.compare(a, b).collect()] == ["login"] and a.count() == 2


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path / "src", "auth.py", "def login(user):\n    return user\n")
    root = ["--root", f"{tmp_path}/index"]
    main([*root, "index", str(tmp_path / "src"), "--repo", "app"])
    assert "Scanned 1 files. Indexed 1 files (1 chunks). Skipped 0 unchanged files." in capsys.readouterr().out
    main([*root, "search", "where is login called"])
    assert "login (auth.py:1-2)" in capsys.readouterr().out
    main([*root, "refresh"])
    main([*root, "set", "retrieval.top_k", "7", "--file", f"{tmp_path}/c.yaml"])
    assert "app: refreshed" in capsys.readouterr().out and config.load(f"{tmp_path}/c.yaml").retrieval.top_k == 7
    with pytest.raises(SystemExit):
        main([*root, "search", "  "])
    main([*root, "remove", "app"])
    assert "1 chunks removed" in capsys.readouterr().out

"""The engine as one object, and a command line over it.

    engine = Engine(spark, "/data/index")
    engine.index_repo("/src/app", "app")          # a folder: code and documents
    engine.index_code(files)                      # repo, file_path, hash, text; only the repos in it
    engine.sync_issues(issues, comments)          # landed rows of a source, from its cursor on
    engine.search(queries, scope="all")           # qid, query -> ranked hits
    engine.evaluate(cases, k=5)
    engine.refresh(), engine.reindex("app"), engine.status(), engine.metrics()

What is searched is encoded once, when it is indexed: a chunk is stored with its vector and number of
terms, its postings lie in a table of their own.  ``embed`` and ``rescore`` take a model's place (operators.encoders).
"""

from __future__ import annotations

import argparse
import os
import time
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Config, load, put
from .functions.shared import exists, tidied, written
from .functions.text import adf_text, chunk_id, iso_before
from .operators import changes, chunkers, code, encoders, evaluate, messages, render, router, search, windows
from .sources import files, landed, pages
from .sources.store import BUCKETS, ChunkStore

CHUNK = (
    "chunk_id string, collection string, text string, chunk_type string, repo string, file_path string, language string, entity_name string, entity_type string, section_path string, signature string, parent_entity string, "
    "line_range string, line_start int, line_end int, pr_number int, pr_title string, pr_state string, pr_author string, pr_labels string, merged_at string, reviewer string, "
    "issue_number int, issue_title string, issue_state string, issue_author string, issue_labels string, comment_author string, comment_created_at string, "
    "jira_instance string, ticket_key string, ticket_summary string, ticket_status string, ticket_type string, reporter string, assignee string, priority string, labels string, "
    "page_id string, page_title string, page_url string, channel_id string, channel_name string, ts string, participants array<string>, permalink_path string, "
    "session_id string, project_dir string, turn_index int, timestamp string, cwd string, git_branch string, created_at string, updated_at string, source_key string, n_terms int, embedding array<float>"
)
STATE = "key string, collection string, repo string, file_path string, hash string"
REPO = "name string, collection string, path string"
METRIC = "query string, collections string, vector_ms double, bm25_ms double, rerank_ms double, total_ms double, result_count bigint, classification string, at timestamp"
EMPTY_PARTS = ("n_terms", "embedding")


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embed: encoders.Embedder | None = None, rescore: encoders.Reranker = encoders.lexical):
        from .shipping import ship

        ship(spark)
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.embed, self.rescore = embed or encoders.hashed(self.config.embedding), rescore
        self.chunks = ChunkStore(spark, f"{self.root}/chunks", CHUNK, derived={"postings": (search.POSTING, partial(search.posting_rows, buckets=BUCKETS))})
        self.state = ChunkStore(spark, f"{self.root}/state", STATE, key="key")
        self.repos = ChunkStore(spark, f"{self.root}/repos", REPO, key="name")

    # ---- indexing

    @tidied
    def _index(self, collection: str, listed: DataFrame, chunk, repo: str | None, remove: bool = True, full: bool = False) -> DataFrame:
        """listed: repo, file_path, hash, text. Files with a known hash are skipped unless full; the state is written last.

        Without a repo what is gone is looked for in the repositories of the listing only.  A file that can't be
        cut keeps its chunks and isn't noted, so the next run tries again; one that has no chunks any more loses them.
        """
        keyed = written(listed.select("repo", "file_path", "hash", "text").dropDuplicates(["repo", "file_path"]), "listed")
        old = self.state.read(collection)
        old = old.filter(F.col("repo") == repo) if repo is not None else old.join(keyed.select("repo").distinct(), "repo", "left_semi")
        mark = F.lit(None).cast("string") if full else F.col("hash")
        diff = written(changes.file_changes(old.withColumn("hash", mark), keyed, ["repo", "file_path"], "hash"), "diff")
        todo = keyed.join(diff.filter("change <> 'removed'"), ["repo", "file_path"], "left_semi")
        cut = chunk(todo)
        cut = written(cut if "error" in cut.columns else cut.withColumn("error", F.lit(None).cast("string")), "cut")
        failed = cut.filter("error is not null").select("repo", "file_path")
        new = self._encoded(cut.filter("error is null"), collection)
        gone = (diff if remove else diff.filter("change <> 'removed'")).join(failed, ["repo", "file_path"], "left_anti")
        stale = self.chunks.read(collection).select("chunk_id", "collection", "repo", "file_path").join(gone.select("repo", "file_path"), ["repo", "file_path"], "left_semi")
        self.chunks.delete(written(stale.join(new.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "collection"), "stale"))
        self.chunks.merge(new)
        key = F.sha2(F.concat_ws("\u0001", "repo", "file_path"), 256).alias("key")
        known = todo.join(failed, ["repo", "file_path"], "left_anti")
        self.state.merge(known.select(key, F.lit(collection).alias("collection"), "repo", "file_path", "hash"))
        if remove:
            self.state.delete(diff.filter("change = 'removed'").select(key, F.lit(collection).alias("collection")))
        stats = changes.run_stats(diff, keyed, cut.select("repo", "file_path", "error"))
        return self.spark.createDataFrame(stats.collect(), stats.schema)

    def _encoded(self, chunks: DataFrame, collection: str) -> DataFrame:
        """Chunks with all columns of CHUNK, their vectors and numbers of terms; blank texts are left out, of one id the last counts."""
        rows = _as_chunks(chunks, collection)
        vectors = self.embed(rows.select("chunk_id", "text"), ["chunk_id"], "text").withColumn("embedding", F.col("embedding").cast("array<float>"))
        full = rows.drop(*EMPTY_PARTS).withColumn("n_terms", F.size(search.tokens(F.col("text")))).join(vectors, "chunk_id", "left")
        return written(full.select(*T._parse_datatype_string(CHUNK).fieldNames()), "encoded")

    def index_repo(self, path: str, repo: str, patterns: list[str] | None = None, full: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """Code, then documents, of a folder; files that are gone leave the index. The folder is registered under its name."""
        self.repos.merge(self.spark.createDataFrame([(repo, "repos", path)], REPO))
        cfg = self.config.code
        out = [*cfg.exclude, *(patterns or [])]
        found = files.discover(self.spark, path, out, cfg.max_file_bytes, repo, cfg.ignore_files)
        done = self.index_code(found, repo, full)
        if not cfg.index_docs:
            return done, None
        docs = files.documents_below(self.spark, path, self.config.documents.globs, out, cfg.ignore_files).withColumn("repo", F.lit(repo))
        return done, self.index_documents(docs, repo, full=full)

    def index_docs(self, path: str, globs: tuple[str, ...] | None = None) -> DataFrame:
        """Documents of a folder outside any repository; those that are gone stay."""
        docs = files.documents_below(self.spark, path, globs or self.config.documents.globs).withColumn("repo", F.lit(""))
        return self.index_documents(docs, "", remove=False)

    def index_code(self, listed: DataFrame, repo: str | None = None, full: bool = False) -> DataFrame:
        return self._index("code_chunks", listed, lambda df: code.code_chunks(df, self.config.code), repo, full=full)

    def index_documents(self, listed: DataFrame, repo: str | None = None, remove: bool = True, full: bool = False) -> DataFrame:
        cfg = self.config.documents

        def chunk(df: DataFrame) -> DataFrame:
            keyed = df.withColumn("k", F.struct("repo", "file_path")).select(F.to_json("k").alias("k"), "text", "file_path")
            out = chunkers.document_chunks(keyed, "k", "text", "file_path", max_tokens=cfg.chunk_max_tokens, overlap_tokens=cfg.overlap_tokens)
            place = F.from_json("k", "repo string, file_path string")
            return out.select("*", place["repo"].alias("repo"), place["file_path"].alias("file_path"), F.lit("document").alias("chunk_type"))

        return self._index("documents", listed, chunk, repo, remove, full)

    @tidied
    def put(self, collection: str, chunks: DataFrame, source_key: Column, sources: DataFrame | None = None) -> None:
        """Chunks of synced sources: new ones replace all of the same source. sources: (source_key) of those that now may have none."""
        new = self._encoded(chunks.withColumn("source_key", source_key), collection)
        touched = new.select("source_key").unionByName(sources.select("source_key")) if sources is not None else new.select("source_key")
        stale = self.chunks.read(collection).select("chunk_id", "collection", "source_key").join(touched.distinct(), "source_key", "left_semi").join(new.select("chunk_id"), "chunk_id", "left_anti")
        self.chunks.delete(written(stale.select("chunk_id", "collection"), "stale"))
        self.chunks.merge(new)

    # ---- synced sources: landed rows in, chunks out; a cursor for each source

    def cursor(self, source: str) -> DataFrame:
        """(source_key, last_synced) of a kind of source."""
        path = f"{self.root}/cursors"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], "source_key string, last_synced string")
        rows = self.spark.read.schema("source string, source_key string, last_synced string").parquet(path).filter(F.col("source") == source)
        return rows.groupBy("source_key").agg(F.max("last_synced").alias("last_synced"))  # appended, the greatest counts

    def _fresh(self, rows: DataFrame, source: str, key: str, time_column: str, strict: bool = False, since: str | None = None) -> DataFrame:
        """changes.not_before() by the cursors of a kind of source."""
        return changes.not_before(rows, self.cursor(source), key, time_column, strict, since)

    def _commit(self, rows: DataFrame, source: str, key: str, time_column: str) -> None:
        """Moves cursors; written after the chunks, so a run that dies is repeated."""
        at = F.col(time_column).cast("string")
        last = rows.filter(F.coalesce(at, F.lit("")) != "").groupBy(F.col(key).cast("string").alias("source_key")).agg(F.max(at).alias("last_synced"))
        last.select(F.lit(source).alias("source"), "source_key", "last_synced").write.mode("append").parquet(f"{self.root}/cursors")

    def _since(self, days: int, now: str | None) -> str | None:
        """Where a source without a cursor begins: so many days before now (0 or no now: at its beginning)."""
        return iso_before(now, days) if now and days else None

    @tidied
    def sync_issues(self, issues: DataFrame, comments: DataFrame | None = None, now: str | None = None) -> int:
        """issues: repo, issue_number, title, body, labels, updated_at, state?, author?, created_at?, pull_request?; comments: repo, issue_number, pos, user, body, created_at?."""
        cfg = self.config.issues
        if "pull_request" in issues.columns:
            issues = issues.filter("pull_request is null")
        issues = chunkers.labelled(issues, "labels", cfg.include_labels, cfg.exclude_labels)
        fresh = self._fresh(issues, "issues", "repo", "updated_at", since=self._since(cfg.backfill_days, now))
        new = written(chunkers.issue_metadata(changes.latest(fresh, ["repo", "issue_number"], [F.col("updated_at")])), "issues")
        source = F.concat_ws("#", "repo", "issue_number")
        self.put("issue_descriptions", chunkers.issue_chunks(new, cfg.chunk_max_tokens), source)
        if comments is not None:
            said = _with_optional(comments, created_at="string").withColumnRenamed("created_at", "comment_created_at").join(new.drop("body", "text"), ["repo", "issue_number"])
            said = chunkers.comment_chunks(said, "repo", F.concat(F.lit("issue"), F.col("issue_number").cast("string")), F.col("user"), F.concat(F.lit("#"), F.col("issue_number").cast("string")), F.col("body"), cfg.chunk_max_tokens)
            self.put("issue_discussions", said, source, new.select(source.alias("source_key")))
        self._commit(new, "issues", "repo", "updated_at")
        return new.count()

    @tidied
    def sync_tickets(self, tickets: DataFrame, comments: DataFrame | None = None, now: str | None = None) -> int:
        """tickets: instance, ticket_key, summary, description (document tree), updated (comparable text), and what else there is; comments: instance, ticket_key, pos, author, body (document tree), created?."""
        cfg = self.config.issues
        fresh = self._fresh(tickets, "jira", "instance", "updated", since=self._since(cfg.backfill_days, now))
        new = written(chunkers.ticket_metadata(changes.latest(fresh, ["instance", "ticket_key"], [F.col("updated")])), "tickets")
        source = F.concat_ws(":", "instance", "ticket_key")
        self.put("jira_descriptions", chunkers.ticket_chunks(new, cfg.chunk_max_tokens), source)
        if comments is not None:
            said = _with_optional(comments, created="string").withColumnRenamed("created", "comment_created_at").join(new.drop("text"), ["instance", "ticket_key"])
            said = chunkers.comment_chunks(said, "instance", F.col("ticket_key"), F.col("author"), F.col("ticket_key"), adf_text(F.col("body")), cfg.chunk_max_tokens)
            self.put("jira_discussions", said, source, new.select(source.alias("source_key")))
        self._commit(new, "jira", "instance", "updated")
        return new.count()

    @tidied
    def sync_pages(self, pages: DataFrame) -> int:
        """pages: page_id, title, url, last_edited_at, content, updated_at?, status? (of fetching the page, as windows.sweep takes it).

        Pages at the cursor are known, pages without a time are always taken; the cursor moves as far as the sweep is whole.
        """
        keyed = _with_optional(pages, status="int", updated_at="string").withColumn("__source", F.lit("default"))
        due = written(changes.latest(self._fresh(keyed, "slite", "__source", "last_edited_at", strict=True), ["page_id"], [F.col("last_edited_at")]), "pages")
        taken, at = windows.sweep(due, "page_id", "last_edited_at", "status")
        new, cfg = written(taken, "taken"), self.config.documents
        about = new.select("page_id", F.col("title").alias("page_title"), F.col("url").alias("page_url"), "updated_at")
        rows = chunkers.document_chunks(new, "page_id", "content", "page_id", "slite", cfg.chunk_max_tokens, cfg.overlap_tokens, markdown=True)
        self.put("slite_pages", rows.withColumn("chunk_type", F.lit("slite_page")).join(about, "page_id"), F.col("page_id"), new.select(F.col("page_id").alias("source_key")))
        self._commit(at.withColumn("__source", F.lit("default")), "slite", "__source", "cursor")
        return new.count()

    @tidied
    def sync_changes(self, prs: DataFrame, files_: DataFrame, comments: DataFrame, now: str | None = None) -> int:
        """prs: repo, pr_number, title, body, updated_at, and what else there is; files_ and comments as chunkers.change_chunks takes them."""
        cfg = self.config.issues
        fresh = self._fresh(prs, "prs", "repo", "updated_at", since=self._since(cfg.backfill_days, now))
        new = written(changes.latest(fresh, ["repo", "pr_number"], [F.col("updated_at")]), "prs")
        keys = new.select("repo", "pr_number")
        of_new = lambda df: df.join(keys, ["repo", "pr_number"], "left_semi")
        rows = written(chunkers.change_chunks(new, of_new(files_), of_new(comments), cfg.chunk_max_tokens).join(chunkers.change_metadata(new), ["repo", "pr_number"]), "changes")
        source = F.concat_ws("#", "repo", "pr_number")
        for name in ("pr_diffs", "pr_discussions"):
            self.put(name, rows.filter(F.col("collection") == name), source, new.select(source.alias("source_key")))
        self._commit(new, "prs", "repo", "updated_at")
        return new.count()

    @tidied
    def sync_chat(self, landed: DataFrame, users: DataFrame) -> int:
        """landed: all messages there are of the channels (messages.chat_rows), users as messages.names takes them.

        A channel with messages after its cursor is cut anew as a whole, so nothing of its history is lost; others are skipped.
        """
        cfg = self.config.chat
        rows = landed.filter(F.col("channel_id").isin(*cfg.channels)) if cfg.channels else landed
        timed = written(messages.chat_rows(rows, messages.names(users)).withColumn("at", F.lpad(F.col("us").cast("string"), 20, "0")), "chat")
        newest = timed.groupBy("channel_id").agg(F.max("at").alias("at"))
        due = written(self._fresh(newest, "slack", "channel_id", "at", strict=True), "channels")
        self.put("slack_messages", chunkers.chat_chunks(timed.join(due.select("channel_id"), "channel_id", "left_semi"), cfg.gap_minutes * 60, cfg.window_cap, cfg.chunk_max_tokens), F.col("channel_id"), due.select(F.col("channel_id").alias("source_key")))
        self._commit(due, "slack", "channel_id", "at")
        return due.count()

    @tidied
    def sync_sessions(self, entries: DataFrame, now_us: int | None = None) -> int:
        """entries: all rows there are (messages.session_rows); sessions with entries after their cursor are cut anew, others are skipped."""
        cfg = self.config.sessions
        rows = written(messages.session_rows(entries).withColumn("at", F.lpad(F.col("us").cast("string"), 20, "0")), "sessions")
        newest = rows.groupBy("session_id").agg(F.max("at").alias("at"))
        since = f"{now_us - cfg.backfill_days * 86_400_000_000:020d}" if now_us else None
        due = written(self._fresh(newest, "sessions", "session_id", "at", strict=True, since=since), "sessions-due")
        cut = chunkers.session_chunks(rows.join(due.select("session_id"), "session_id", "left_semi"), cfg.chunk_max_tokens)
        for old, new in (("entry_timestamp", "timestamp"),):
            cut = cut.withColumnRenamed(old, new) if old in cut.columns else cut
        if "cwd" in cut.columns:
            cut = cut.withColumn("project_dir", F.element_at(F.split("cwd", "/"), -1))
        self.put("session_logs", cut, F.col("session_id"), due.select(F.col("session_id").alias("source_key")))
        self._commit(due, "sessions", "session_id", "at")
        return due.count()

    def pull(self, kind: str, addresses: dict[str, str], users: str | None = None, now: str | None = None, **options) -> int:
        """Fetches a kind of source (pages.STORES) from a service and syncs it; addresses: source (repository, instance, channel) -> where its first page is."""
        pages.register(self.spark)
        names = self.spark.createDataFrame([(a, s) for s, a in addresses.items()], "address string, source string")

        def values(what: str, at: list[str]) -> DataFrame:
            read = self.spark.read.format("paged_api").options(**pages.options_of(what, **options), addresses=" ".join(at))
            return written(read.load().join(names, "address", "left"), "fetched")

        if kind == "slack":
            return self.sync_chat(landed.messages(values("messages", list(addresses.values())), "source"), landed.users(values("users", [users])))
        rows = values({"jira": "tickets", "slite": "pages"}.get(kind, kind), list(addresses.values()))
        if kind == "slite":
            return self.sync_pages(landed.pages(rows))
        if kind == "prs":
            return self.sync_changes(*landed.changes(rows, "source"), now)
        return (self.sync_issues if kind == "issues" else self.sync_tickets)(*(landed.issues if kind == "issues" else landed.tickets)(rows, "source"), now)

    def sync_session_files(self, path: str, modified_after: str | None = None) -> int:
        """Logs of assistant sessions below a folder, a file each; files older than modified_after aren't opened."""
        return self.sync_sessions(landed.session_entries(files.json_lines(self.spark, path, modified_after)))

    # ---- keeping house

    def views(self) -> None:
        """Chunks and collections as temporary views, for spark.sql."""
        self.chunks.read().createOrReplaceTempView("chunks")
        self.status().createOrReplaceTempView("collections")

    @tidied
    def remove_repo(self, repo: str) -> int:
        """Takes a repository out of index, state and register; the number of its chunks."""
        stale = written(self.chunks.read("code_chunks", "documents").filter(F.col("repo") == repo).select("chunk_id", "collection"), "removed")
        n = stale.count()
        self.chunks.delete(stale)
        self.state.delete(written(self.state.read("code_chunks", "documents").filter(F.col("repo") == repo).select("key", "collection"), "removed"))
        self.repos.delete(self.spark.createDataFrame([(repo, "repos")], "name string, collection string"))
        return n

    @tidied
    def remove_source(self, source_key: str, *collections: str) -> int:
        """Takes the chunks of one issue, ticket, change request, page, channel or session out."""
        stale = written(self.chunks.read(*collections).filter(F.col("source_key") == source_key).select("chunk_id", "collection"), "removed")
        self.chunks.delete(stale)
        return stale.count()

    def _registered(self) -> list[tuple[str, str]]:
        return [(r["name"], r["path"]) for r in self.repos.read().orderBy("name").collect()]

    def refresh(self, full: bool = False) -> list[tuple[str, str]]:
        """Indexes every registered folder again, changed files only or all: (name, refreshed | missing). Cursors aren't touched; a missing folder stays registered."""
        out = []
        for name, path in self._registered():
            if exists(self.spark, path):
                self.index_repo(path, name, full=full)
            out.append((name, "refreshed" if exists(self.spark, path) else "missing"))
        return out

    def reindex(self, repo: str | None = None) -> list[tuple[str, str]]:
        """One repository from nothing, or, without a name, an empty index with all registered repositories in it."""
        known = self._registered()
        if repo is not None:
            known = [x for x in known if x[0] == repo]
            if not known:
                raise ValueError(f"{repo!r} isn't registered")
            if not exists(self.spark, known[0][1]):
                raise FileNotFoundError(known[0][1])
            self.remove_repo(repo)
        else:
            self.reset()
        out = []
        for name, path in known:
            there = exists(self.spark, path)
            if there:
                self.index_repo(path, name)
            out.append((name, "indexed" if there else "missing"))
        return out

    def reset(self) -> None:
        """Empties index, state, register and cursors; the log of queries stays."""
        fs, _ = self.chunks._path()
        for name in ("chunks", "state", "repos", "cursors"):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)

    # ---- search

    def _candidates(self, queries: DataFrame, scope: str, where: dict | None, staged: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Fused hits of all collections that a query is routed to, with text; and the queries that aren't blank."""
        r = self.config.retrieval
        plain = queries.filter(F.trim("query") != "").select("qid", "query")
        asked = plain.select("qid", "query", F.explode(router.route(F.col("query"), scope)).alias("collection"))
        collections = sorted(row[0] for row in asked.select("collection").distinct().collect())  # at most eleven names
        stored = self.chunks.read(*collections) if collections else self.chunks.read().limit(0)
        chunks = stored.filter(search.matching(**(where or {})))
        vectors = self.embed(plain, ["qid"], "query").join(asked.select("qid", "collection"), "qid")
        dense = search.nearest(chunks.select("collection", "chunk_id", "embedding"), vectors, r.top_k)

        def read(condition: Column | None) -> DataFrame:
            found = self.chunks.read_derived("postings", *collections, where=condition)
            return found.join(chunks.select("collection", "chunk_id"), ["collection", "chunk_id"], "left_semi") if where else found

        sizes = chunks.groupBy("collection").agg(F.count("*").alias("n"), F.avg("n_terms").alias("avg_length"))
        sparse = search.bm25(read, sizes, asked, r.top_k, BUCKETS)
        if staged is not None:  # each leg by itself, to be timed
            for name, leg in (("vector_ms", dense), ("bm25_ms", sparse)):
                began = time.perf_counter()
                staged[name] = (written(leg, name), (time.perf_counter() - began) * 1000)
            dense, sparse = staged["vector_ms"][0], staged["bm25_ms"][0]
        hits = search.merge_collections(search.fuse([dense, sparse], r.top_k, r.rrf_k), r.top_k, list(router.ALL))
        return hits.join(chunks.drop(*EMPTY_PARTS), ["collection", "chunk_id"]).join(plain, "qid"), plain

    def search(self, queries: DataFrame, scope: str = "all", where: dict | None = None, prefer_repo: str = "", log: bool = False) -> DataFrame:
        """(qid, rank, score, chunk columns): hybrid search of every query in its collections, reranked, capped by source.

        Blank queries have no hits.  With log the legs and the result are staged, timed and noted.
        """
        r, staged, began = self.config.retrieval, {} if log else None, time.perf_counter()
        full, plain = self._candidates(queries, scope, where, staged)
        rank_from = time.perf_counter()
        if r.rerank:
            full = search.rerank(self.rescore(full), F.col("rescored")).drop("rescored")
        full = search.prefer_repo(full.withColumn("prefer_repo", F.lit(prefer_repo)), r.repo_boost if prefer_repo else 0.0)
        names = ("repo", "pr_number", "issue_number", "ticket_key", "page_id", "session_id", "file_path")
        keyed = full.withColumn("source_key", search.source_key(F.col("chunk_id"), **{n: F.col(n) for n in names}))
        out = search.cap_sources(keyed, r.max_per_source).filter(F.col("rank") <= r.final_k).drop("prefer_repo")
        if log:
            out = written(out, "answers")
            ms = {k: v[1] for k, v in staged.items()} | {"rerank_ms": (time.perf_counter() - rank_from) * 1000, "total_ms": (time.perf_counter() - began) * 1000}
            self._log(plain, out, scope, ms)
        return out

    def _log(self, asked: DataFrame, hits: DataFrame, scope: str, ms: dict[str, float]) -> None:
        n = hits.groupBy("qid").agg(F.count("*").alias("n"))
        rows = asked.join(n, "qid", "left").select(
            "query", F.array_join(router.route(F.col("query"), scope), ",").alias("collections"), *[F.lit(ms[k]).alias(k) for k in ("vector_ms", "bm25_ms", "rerank_ms", "total_ms")],
            F.coalesce("n", F.lit(0)).alias("result_count"), router.intent(F.col("query")).alias("classification"), F.current_timestamp().alias("at"),
        )
        rows.write.mode("append").parquet(f"{self.root}/query_metrics")

    def logged(self, newest: int | None = None) -> DataFrame:
        """The log of queries, the newest so many."""
        path = f"{self.root}/query_metrics"
        rows = self.spark.read.schema(METRIC).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], METRIC)
        return evaluate.newest(rows, newest, "at") if newest else rows

    def metrics(self) -> DataFrame:
        """One row: number of queries and the five averages."""
        return evaluate.query_stats(self.logged())

    def answers(self, queries: DataFrame, **how) -> DataFrame:
        """(qid, answer): hits as text; queries without hits say so."""
        text = render.render(self.search(queries, **how))
        return queries.select("qid").join(text, "qid", "left").select("qid", F.coalesce("answer", F.lit(render.NOTHING)).alias("answer"))

    def results(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(qid, query, rank, file_path, pr_number): the k best after reranking, without preference and cap."""
        full, _ = self._candidates(queries, "all", None)
        if self.config.retrieval.rerank:
            full = search.rerank(self.rescore(full), F.col("rescored")).drop("rescored")
        return full.filter(F.col("rank") <= k).select("qid", "query", "rank", "file_path", "pr_number")

    def evaluate(self, cases: DataFrame, k: int = 5) -> DataFrame:
        """cases: qid, query, expected_files ARRAY<STRING>, expected_prs ARRAY<INT> (either may be null), or expected ARRAY<STRING> of both."""
        return evaluate.summary(evaluate.of_cases(cases, self.results(cases.select("qid", "query"), k), k))

    def status(self) -> DataFrame:
        """Rows of each collection and files known of each."""
        known = changes.files_known(self.state.read(), "collection")
        return self.chunks.count().join(known, "collection", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def _with_optional(df: DataFrame, **kinds: str) -> DataFrame:
    """df with the columns that it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in df.columns])


def _as_chunks(df: DataFrame, collection: str) -> DataFrame:
    """Any chunks with all columns of CHUNK; blank texts are left out."""
    have = set(df.columns)
    cols = []
    for f in T._parse_datatype_string(CHUNK).fields:
        cols.append(F.lit(collection).alias(f.name) if f.name == "collection" else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols).filter(F.trim("text") != "").dropDuplicates(["chunk_id"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="fathomline", description="index folders and landed rows, and search them")
    p.add_argument("--root", default="./fathomline-index")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="do", required=True)

    def command(do: str, /, *args: str, **options) -> None:
        c = sub.add_parser(do)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", **({"action": "store_true"} if v is False else {"default": v}))

    command("index", "path", repo=None, full=False)
    command("docs", "path", globs="")
    command("sync", "kind", "rows", comments="", files="", users="", now="")
    command("pull", "kind", "source", "address", users="", secret="", now="")
    command("sessions", "path", after="")
    command("search", "query", scope="all", prefer_repo="")
    command("remove", "repo")
    command("refresh", full=False)
    command("reindex", name=None, all=False)
    command("status")
    command("metrics")
    command("reset")
    command("eval-run", "cases", output="results.jsonl", top_k="5")
    command("eval-compare", "first", "second")
    command("set", "key", "value", file="fathomline.yaml")
    args = p.parse_args(argv)
    if args.do == "search" and not args.query.strip():
        p.error("the query is blank")
    if args.do == "index" and not args.repo:
        args.repo = os.path.basename(os.path.abspath(args.path))
    if args.do == "reindex" and not (args.name or args.all):
        p.error("name a repository, or say --all")
    if args.do == "set":
        put(args.file, args.key, args.value)
        return
    spark = SparkSession.builder.appName("fathomline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.root, load(args.config))
    read = lambda path: spark.read.json(path) if path else None
    if args.do == "index":
        for what, stats in zip((render.run_report, render.docs_report), engine.index_repo(args.path, args.repo, full=args.full)):
            if stats is not None:
                print(stats.select(what(*[F.col(c) for c in changes.COUNTERS])).first()[0])
    elif args.do == "docs":
        print(engine.index_docs(args.path, tuple(x for x in args.globs.split(",") if x) or None).select(render.folder_report(*[F.col(c) for c in changes.COUNTERS])).first()[0])
    elif args.do == "sync":
        rows, now = read(args.rows), args.now or None
        kinds = {
            "issues": lambda: engine.sync_issues(rows, read(args.comments), now), "jira": lambda: engine.sync_tickets(rows, read(args.comments), now), "prs": lambda: engine.sync_changes(rows, read(args.files), read(args.comments), now),
            "slite": lambda: engine.sync_pages(rows), "slack": lambda: engine.sync_chat(rows, read(args.users)), "sessions": lambda: engine.sync_sessions(rows),
        }
        if args.kind not in kinds:
            p.error(f"a kind is one of {', '.join(kinds)}")
        print(f"{args.kind}: {kinds[args.kind]()} taken")
    elif args.do == "pull":
        print(f"{args.kind}: {engine.pull(args.kind, {args.source: args.address}, args.users or None, args.now or None, **({'secret': args.secret} if args.secret else {}))} taken")
    elif args.do == "sessions":
        print(f"{engine.sync_session_files(args.path, args.after or None)} sessions taken")
    elif args.do == "search":
        asked = spark.createDataFrame([(1, args.query)], "qid int, query string")
        print(engine.answers(asked, scope=args.scope, prefer_repo=args.prefer_repo, log=True).first().answer)
    elif args.do == "remove":
        print(f"{engine.remove_repo(args.repo)} chunks removed")
    elif args.do in ("refresh", "reindex"):
        for name, what in engine.refresh(args.full) if args.do == "refresh" else engine.reindex(None if args.all else args.name):
            print(f"{name}: {what}")
    elif args.do == "reset":
        engine.reset()
    elif args.do == "eval-run":
        cases = evaluate.load_cases(spark, args.cases)
        found = written(engine.results(cases.select("qid", "query"), int(args.top_k)), "results")
        evaluate.summary(evaluate.of_cases(cases, found, int(args.top_k))).show()
        evaluate.save_results(found, args.output)
    elif args.do == "eval-compare":
        evaluate.compare(evaluate.load_results(spark, args.first), evaluate.load_results(spark, args.second)).show(truncate=False)
    else:
        (engine.status() if args.do == "status" else engine.metrics()).show()


if __name__ == "__main__":
    main()

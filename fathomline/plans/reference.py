"""Queries of the retrieval engine's own operators over the project's tables, with the SQL they are checked against.

A name begins with the id of the operator; each calls the operator as the engine does.  SQL stands beside the query where SQL can say the
same over whole tables, written from the operator's definition; code chunks have tests instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..config import Documents
from ..functions.instants import with_instant, with_source_instant
from ..functions.shared import exists, shared_dir, written
from ..operators import changes, chunkers, code, evaluate, messages, render, router, search, windows
from ..sources import files
from ..sources.store import BUCKETS, ChunkStore
from .problems import instants_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATH = r"regexp_replace(regexp_replace(file_path, '[\\/]+', '/', 'g'), '^(\./)+', '')"
_SUFFIX = r"lower(regexp_extract(regexp_extract(p, '([^/\\]*)$', 1), '[^.](\.[^.]+)$', 1))"
_LANGUAGE = "CASE " + " ".join(f"WHEN sfx = '{k}' THEN '{v}'" for k, v in tx.LANGUAGES.items()) + " END"
_EXCLUDED = " OR ".join(f"regexp_matches(p, '{tx.glob_regex(p)}')" for p in files.EXCLUDED)
_GLOBS = Documents().globs
_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"

# ---- sources ----------------------------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT DISTINCT repo, {_PATH} AS p FROM file_hashes), s AS (SELECT *, {_SUFFIX} AS sfx FROM p)
SELECT repo, p AS file_path, {_LANGUAGE} AS language FROM s WHERE {_LANGUAGE} IS NOT NULL AND NOT ({_EXCLUDED})""")
def src01_discover(spark, sf):
    """SRC-01..04: code files that no rule excludes, with their language."""
    return files.code_of(table(spark, sf, "file_hashes").select("repo", "file_path")).distinct()


@query(f"""
WITH p AS (SELECT DISTINCT {_PATH} AS p FROM chunks WHERE file_path IS NOT NULL)
SELECT p AS file_path FROM p WHERE {" OR ".join(f"regexp_matches(p, '{tx.glob_regex(g)}')" for g in _GLOBS)}""")
def src05_documents(spark, sf):
    """SRC-05, SET-04: documents that any glob takes, each once."""
    return files.documents_of(table(spark, sf, "chunks").select("file_path").filter("file_path is not null"), _GLOBS)


@query("""
SELECT kind, count(*) AS n_readable FROM (SELECT lower(trim(entry_type)) AS kind, message FROM session_logs WHERE message IS NOT NULL AND json_valid(message)) WHERE kind IS NOT NULL GROUP BY 1""")
def src13_json_lines(spark, sf):
    """SRC-12/13: files of lines, those that are JSON; others are dropped."""
    df = table(spark, sf, "session_logs").select(F.lower(F.trim("entry_type")).alias("kind"), F.regexp_replace("message", "[\r\n]+", " ").alias("value")).filter("kind is not null and value is not null")
    where = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    df.write.partitionBy("kind").text(where)
    lines = files.json_lines(spark, where, names="*.txt")
    return lines.groupBy(F.regexp_extract("file", "/kind=([^/]*)/", 1).alias("kind")).agg(F.count("*").alias("n_readable"))


@query("""
SELECT chunk_id, length(regexp_replace(text, '^﻿', '')) AS n_chars FROM (SELECT DISTINCT chunk_id, text FROM chunks)
WHERE strlen(text) <= 1000""")
def src15_size_cap(spark, sf):
    """SRC-15/16: texts up to a size, without a byte order mark."""
    df = files.sized(table(spark, sf, "chunks").select("chunk_id", "text").distinct(), "text", 1000)
    return df.select("chunk_id", F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def src18_newest(spark, sf):
    """SRC-18: the newest twenty rows of a log."""
    return evaluate.newest(table(spark, sf, "events").select("event_id", "ts", "event_type"), 20, "ts", "event_id")


@query(f"""SELECT repo, issue_number, max(us) AS us FROM ({instants_sql("issues", "repo, issue_number", "updated_at", "repo")})
WHERE us >= epoch_us(TIMESTAMP '2025-10-01') OR us IS NULL GROUP BY ALL""")
def src06_since(spark, sf):
    """SRC-06/07, FLT-08, FN-09: records that aren't before a cursor, by their instant; those without a time always."""
    rows = with_source_instant(table(spark, sf, "issues").select("repo", "issue_number", "updated_at"), "updated_at", table(spark, sf, "source_zones"), "issues", "repo", "us")
    none = spark.createDataFrame([], "source_key string, last_synced string")
    fresh = changes.not_before(rows.withColumn("at", F.lpad(F.col("us").cast("string"), 20, "0")), none, "repo", "at", since=f"{1_759_276_800_000_000:020d}")
    return fresh.groupBy("repo", "issue_number").agg(F.max("us").alias("us"))


# ---- filters and projections ------------------------------------------------------------------------------------


@query("SELECT chunk_id, repo, file_path FROM chunks WHERE collection = 'code_chunks' AND repo = 'forge/atlas-core'")
def flt01_equal(spark, sf):
    """FLT-01..03: equality over metadata, pushed to the scan; empty arguments filter nothing."""
    return table(spark, sf, "chunks").filter(search.matching(collection="code_chunks", repo="forge/atlas-core", chunk_id="")).select("chunk_id", "repo", "file_path")


def _case(families) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(p)}') THEN '{name}'" for name, _, p in families) + " ELSE 'all' END"


@query(f"SELECT doc_id, {_case(router.FAMILIES)} AS intent FROM documents WHERE text IS NOT NULL")
def flt05_intent(spark, sf):
    """FLT-05: the family of intent of every text."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", router.intent(F.col("text")).alias("intent"))


@query(
    "WITH c AS (SELECT item_id, "
    + _case(router.FAMILIES)
    + " AS k FROM benchmark) SELECT item_id, CASE k "
    + " ".join(f"WHEN '{n}' THEN '{','.join(c)}'" for n, c, _ in router.FAMILIES)
    + f" ELSE '{','.join(router.ALL)}' END AS collections FROM c"
)
def flt04_route(spark, sf):
    """FLT-04/05: collections that answer a query."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(router.route(F.col("text")), ",").alias("collections"))


@query("""SELECT row_id, list_aggregate(labels, 'string_agg', ',') AS labels FROM (SELECT DISTINCT row_id, labels FROM issues)
WHERE list_has_any(labels, ['bug', 'perf']) AND NOT coalesce(list_has_any(labels, ['wontfix']), FALSE)""")
def flt06_labels(spark, sf):
    """FLT-06, FN-12, SET-03: labels that take in and leave out."""
    df = chunkers.labelled(table(spark, sf, "issues").select("row_id", "labels").distinct(), "labels", ("bug", "perf"), ("wontfix",))
    return df.select("row_id", F.array_join("labels", ",").alias("labels"))


@query("""SELECT channel_id, count(*) AS n FROM slack_messages
WHERE channel_id IN (SELECT channel_id FROM slack_messages WHERE subtype = 'channel_join') GROUP BY 1""")
def flt10_channels(spark, sf):
    """FLT-10: channels that were joined; an allow-list would take their place."""
    m = table(spark, sf, "slack_messages").select("channel_id", "subtype")
    return messages.selected(m, m.filter("subtype = 'channel_join'")).groupBy("channel_id").agg(F.count("*").alias("n"))


_NOISE = ", ".join(f"'{x}'" for x in tx.NOISE_SUBTYPES)
_USERS = "u AS (SELECT user_id, coalesce(nullif(display_name, ''), nullif(real_name, ''), nullif(handle, ''), user_id) AS name FROM slack_users)"


def _lines(spark, sf):
    m = table(spark, sf, "slack_messages").select("msg_id", "channel_id", "ts", "text", "user_id", "thread_ts", "reply_count", "subtype")
    return m, messages.names(table(spark, sf, "slack_users"))


_MESSAGES = rf"""{_USERS}, m AS (SELECT DISTINCT ON (msg_id) * FROM slack_messages),
e AS (SELECT msg_id, unnest(list_distinct(regexp_extract_all(text, '<@(U[A-Z0-9]+)>', 1))) AS id FROM m WHERE text LIKE '%<@%'),
r AS (SELECT msg_id, list({{'i': id, 'n': coalesce(name, id)}}) AS ms FROM e LEFT JOIN u ON id = user_id GROUP BY 1),
s AS (SELECT m.*, coalesce(u.name, m.user_id, 'unknown') AS author, CASE WHEN (subtype IS NULL OR subtype NOT IN ({_NOISE})) AND trim(text) <> '' THEN
  '@' || coalesce(u.name, m.user_id, 'unknown') || ': ' || CASE WHEN ms IS NULL THEN trim(text) ELSE
   list_reduce(list_prepend(trim(text), list_transform(ms, lambda x: '<@' || x.i || '>' || chr(1) || '@' || x.n)), lambda a, b: replace(a, split_part(b, chr(1), 1), split_part(b, chr(1), 2))) END END AS line
 FROM m LEFT JOIN u USING (user_id) LEFT JOIN r USING (msg_id))"""


@query(f"WITH {_MESSAGES} SELECT msg_id, line FROM s WHERE line IS NOT NULL")
def flt11_lines(spark, sf):
    """FLT-11, FN-03/04, JON-04: messages as lines with names, without noise."""
    return messages.chat_lines(*_lines(spark, sf)).filter("line is not null").select("msg_id", "line")


@query("SELECT DISTINCT chunk_id FROM chunks WHERE collection = 'code_chunks' AND length(trim(text)) >= 40 AND NOT (" + " OR ".join(f"lower(text) LIKE '%{m}%'" for m in tx.LICENCE_MARKS) + ")")
def flt13_headers(spark, sf):
    """FLT-12/13: texts that say something and grant no licence."""
    df = table(spark, sf, "chunks").filter("collection = 'code_chunks'")
    return df.filter(tx.says_something(F.col("text"))).select("chunk_id").distinct()


@query("SELECT c.chunk_id, c.repo FROM chunks c WHERE chunk_id IN (SELECT chunk_id FROM chunks GROUP BY 1 HAVING count(*) > 1)")
def prj02_lookup(spark, sf):
    """PRJ-01/02, JON-07: rows by a list of ids."""
    c = table(spark, sf, "chunks").select("chunk_id", "repo")
    return changes.lookup(c, c.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1"), "chunk_id")


@query("""SELECT DISTINCT row_id, repo, issue_number, coalesce(title, '') AS issue_title, coalesce(issue_state, '') AS issue_state, coalesce(author_login, '') AS issue_author,
coalesce(list_aggregate(labels, 'string_agg', ','), '') AS issue_labels, coalesce(created_at, '') AS created_at, coalesce(updated_at, '') AS updated_at FROM issues""")
def prj03_issue_metadata(spark, sf):
    """PRJ-03, FN-12: nested rows of issues as flat metadata."""
    names = ("row_id", "repo", "issue_number", "issue_title", "issue_state", "issue_author", "issue_labels", "created_at", "updated_at")
    return chunkers.issue_metadata(table(spark, sf, "issues")).select(*names).distinct()


@query("""SELECT DISTINCT row_id, instance AS jira_instance, ticket_key, coalesce(summary, '') AS ticket_summary, coalesce(ticket_status, '') AS ticket_status, coalesce(ticket_type, '') AS ticket_type,
coalesce(reporter, '') AS reporter, coalesce(assignee, '') AS assignee, coalesce(priority, '') AS priority, coalesce(list_aggregate(labels, 'string_agg', ','), '') AS labels,
coalesce(created, '') AS created_at, coalesce(updated, '') AS updated_at FROM jira_tickets""")
def prj03_ticket_metadata(spark, sf):
    """PRJ-03: rows of tickets as flat metadata."""
    names = ("row_id", "jira_instance", "ticket_key", "ticket_summary", "ticket_status", "ticket_type", "reporter", "assignee", "priority", "labels", "created_at", "updated_at")
    return chunkers.ticket_metadata(table(spark, sf, "jira_tickets")).select(*names).distinct()


@query("""WITH l AS (SELECT DISTINCT ON (repo, issue_number) * FROM issues ORDER BY repo, issue_number, fetched_at DESC, row_id DESC)
SELECT repo, issue_number AS pr_number, coalesce(title, '') AS pr_title, coalesce(issue_state, '') AS pr_state, coalesce(author_login, '') AS pr_author,
coalesce(list_aggregate(labels, 'string_agg', ','), '') AS pr_labels, coalesce(updated_at, '') AS merged_at FROM l""")
def prj03_change_metadata(spark, sf):
    """PRJ-03: change requests (issues stand in for them) as flat metadata."""
    return chunkers.change_metadata(_changes(spark, sf)).select("repo", "pr_number", "pr_title", "pr_state", "pr_author", "pr_labels", "merged_at")


# ---- retrieval --------------------------------------------------------------------------------------------------


def _chunks(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("collection", F.col("doc_id").alias("chunk_id"), "source", "text")


_STORES: dict[tuple[str, str], ChunkStore] = {}


def _indexed(spark, sf):
    """The documents indexed once for each session: a store with vectors and postings."""
    key = (spark.sparkContext.applicationId, sf)
    store = _STORES.get(key)
    if store is None or not exists(spark, store.root):
        schema = "chunk_id bigint, collection string, text string, source string, n_terms int, embedding array<double>"
        posting = search.POSTING.replace("chunk_id string", "chunk_id bigint")
        store = ChunkStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", schema, derived={"postings": (posting, lambda df: search.posting_rows(df, BUCKETS))})
        rows = _chunks(spark, sf).withColumn("n_terms", F.size(search.tokens(F.col("text"))))
        vectors = search.hashed_vectors(rows, ["chunk_id"], "text")
        store.merge(rows.join(vectors, "chunk_id"))
        _STORES[key] = store
    return store


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


_BM25 = rf"""
t AS (SELECT doc_id, collection, {_TOKENS.format("text")} AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT collection, count(*) AS n, avg(len(ts)) AS avg_length FROM t GROUP BY 1),
q AS (SELECT item_id AS qid, unnest(list_distinct({_TOKENS.format("text")})) AS term FROM benchmark),
p AS (SELECT collection, doc_id, term, len(any_value(ts)) AS length, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT collection, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_length FROM (SELECT collection, term, count(*) AS df FROM p GROUP BY ALL) JOIN st USING (collection)),
w AS (SELECT p.collection, doc_id, term, idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avg_length)) AS w FROM p JOIN d USING (collection, term)),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, chunk_id) AS rank FROM
 (SELECT qid, collection, doc_id AS chunk_id, round(sum(w), 9) AS score FROM w JOIN q USING (term) GROUP BY ALL))"""


@query(f"WITH {_BM25} SELECT qid, collection, chunk_id, score, rank FROM bm WHERE rank <= 10")
def ret02_bm25(spark, sf):
    """RET-02, AGG-11: the ten best of each query in each collection by BM25."""
    return _sparse(spark, sf, 10)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
s AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v), 9) AS score FROM n q, n c WHERE q.vec_id % 100 = 0)
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def ret01_dense(spark, sf):
    """RET-01, JON-11: the ten nearest vectors of every hundredth, among all."""
    e = table(spark, sf, "embeddings")
    items = e.select(F.lit("vectors").alias("collection"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return search.nearest(items, asked, 10).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


_PLACE = "(('0x' || substr(sha256(t), 1, 7))::BIGINT % 64)"
_DENSE = rf"""
hv AS (SELECT doc_id AS id, collection, {_PLACE} AS d, count(*)::DOUBLE AS x FROM (SELECT doc_id, collection, unnest(ts) AS t FROM t) GROUP BY ALL),
hn AS (SELECT id, collection, d, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM hv),
qv AS (SELECT item_id AS qid, {_PLACE} AS d, count(*)::DOUBLE AS x FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS t FROM benchmark) GROUP BY ALL),
qn AS (SELECT qid, d, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS x FROM qv),
de AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, chunk_id) AS rank FROM
 (SELECT qid, collection, id AS chunk_id, round(sum(hn.x * qn.x), 6) AS score FROM hn JOIN qn USING (d) GROUP BY ALL))"""


def _sparse(spark, sf, k):
    store = _indexed(spark, sf)
    sizes = store.read().groupBy("collection").agg(F.count("*").alias("n"), F.avg("n_terms").alias("avg_length"))
    return search.bm25(lambda where: store.read_derived("postings", where=where), sizes, _queries(spark, sf), k, BUCKETS)


def _dense(spark, sf, k):
    vectors = search.hashed_vectors(_queries(spark, sf), ["qid"], "query")
    return search.nearest(_indexed(spark, sf).read().select("collection", "chunk_id", "embedding"), vectors, k, 6)


def _legs(spark, sf, k):
    return _dense(spark, sf, k), _sparse(spark, sf, k)


@query(f"WITH {_BM25}, {_DENSE} SELECT qid, collection, chunk_id, round(score, 6) AS score, rank FROM de WHERE rank <= 10")
def enc01_hashed_dense(spark, sf):
    """ENC-01..03: the deterministic embedder, searched by cosine."""
    return _dense(spark, sf, 10)


_RRF = """
f AS (SELECT qid, collection, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM
 (SELECT qid, collection, chunk_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT qid, collection, chunk_id, rank FROM de WHERE rank <= 20) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, chunk_id) AS rank FROM f)"""


def _hybrid(spark, sf, n=20):
    return search.fuse(list(_legs(spark, sf, n)), n)


@query(f"WITH {_BM25}, {_DENSE}, {_RRF} SELECT qid, collection, chunk_id, round(score, 9) AS score, rank FROM h WHERE rank <= 20")
def ret03_hybrid(spark, sf):
    """RET-03/04: both legs fused by reciprocal rank."""
    return _hybrid(spark, sf).withColumn("score", F.round("score", 9))


_ORDER = list(router.ALL)
_MERGED = f"""
mm AS (SELECT h.*, coalesce(list_position({_ORDER}, collection), 0) AS o FROM h WHERE rank <= 20),
mg AS (SELECT qid, collection, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, o, rank, chunk_id) AS rank FROM mm)"""


def _merged(spark, sf):
    return search.merge_collections(_hybrid(spark, sf), 20, _ORDER)


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_MERGED} SELECT qid, collection, chunk_id, rank FROM mg WHERE rank <= 20")
def ret05_fan_out(spark, sf):
    """RET-05/06, SRT-01, SET-01: one list of twenty over all collections."""
    return _merged(spark, sf).select("qid", "collection", "chunk_id", "rank")


def _found(spark, sf):
    """The merged list with texts and sources, reranked."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "section_path")
    hits = _merged(spark, sf).join(docs, "chunk_id").join(_queries(spark, sf), "qid")
    return search.rerank(search.with_lexical_score(hits), F.col("lexical")).drop("lexical")


_RERANKED = rf"""
rt AS (SELECT mg.qid, mg.collection, mg.chunk_id, mg.rank AS r0, d.source, d.text, d.section_path, list_distinct({_TOKENS.format("b.text")}) AS q, {_TOKENS.format("d.text")} AS t
 FROM mg JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = qid WHERE mg.rank <= 20),
rs AS (SELECT qid, collection, chunk_id, r0, source, text, section_path, round(len(list_intersect(q, list_distinct(t)))::DOUBLE / greatest(len(q), 1)
 + 0.1::DOUBLE * len(list_filter(t, lambda x: list_contains(q, x)))::DOUBLE / greatest(len(t), 1), 9) AS score FROM rt),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0) AS rank FROM rs)"""


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_MERGED}, {_RERANKED} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM rr")
def ret07_rerank(spark, sf):
    """RET-07, JON-06: the whole list scored anew."""
    return _found(spark, sf).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


_BOOSTED = """
bs AS (SELECT *, round(score + CASE WHEN source = 'forge/atlas-core' THEN 0.15::DOUBLE * CASE WHEN max(score) OVER (PARTITION BY qid) = min(score) OVER (PARTITION BY qid) THEN 1.0
 ELSE max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid) END ELSE 0 END, 9) AS adj FROM rr),
bo AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY adj DESC, rank) AS rank FROM bs)"""


def _preferred(spark, sf):
    return search.prefer_repo(_found(spark, sf).withColumn("prefer_repo", F.lit("forge/atlas-core")), 0.15, "source")


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_MERGED}, {_RERANKED}, {_BOOSTED} SELECT qid, chunk_id, rank FROM bo")
def ret08_prefer(spark, sf):
    """RET-08, AGG-10: the preferred repository moves up, scores stay."""
    return _preferred(spark, sf).select("qid", "chunk_id", "rank")


def _answer(spark, sf, final_k=5):
    keyed = _preferred(spark, sf).withColumn("source_key", search.source_key(F.col("chunk_id"), file_path=F.col("source"), repo=F.col("collection")))
    return search.cap_sources(keyed, 2).filter(F.col("rank") <= final_k)


@query(f"""WITH {_BM25}, {_DENSE}, {_RRF}, {_MERGED}, {_RERANKED}, {_BOOSTED},
cp AS (SELECT *, row_number() OVER (PARTITION BY qid, collection, source ORDER BY rank) AS k FROM bo),
fi AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM cp WHERE k <= 2)
SELECT qid, chunk_id, rank FROM fi WHERE rank <= 5""")
def ret11_search(spark, sf):
    """RET-09..11, WIN-03, SRT-04: the whole pipeline, five answers to each query."""
    return _answer(spark, sf).select("qid", "chunk_id", "rank")


@query(rf"""WITH {_BM25}, {_DENSE}, {_RRF}, {_MERGED}, {_RERANKED}, {_BOOSTED},
cp AS (SELECT *, row_number() OVER (PARTITION BY qid, collection, source ORDER BY rank) AS k FROM bo),
fi AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM (SELECT * FROM cp WHERE k <= 2)),
tx AS (SELECT *, string_split(trim(text), chr(10)) AS ls FROM fi WHERE place <= 5)
SELECT qid, string_agg('### ' || place || '. [' || coalesce(section_path, '') || '] ' || coalesce(source, 'unknown') || CASE WHEN section_path <> '' THEN chr(10) || '*Section: ' || section_path || '*' ELSE '' END
 || chr(10) || '```' || chr(10) || array_to_string(ls[1:50], chr(10)) || CASE WHEN len(ls) > 50 THEN chr(10) || '# ... (truncated)' ELSE '' END || chr(10) || '```' || chr(10), chr(10) ORDER BY place) AS answer FROM tx GROUP BY qid""")
def ret14_render(spark, sf):
    """RET-14: the answers as text."""
    return render.render(_answer(spark, sf).withColumn("chunk_type", F.lit("document")).withColumn("file_path", F.col("source")))


_TEMPLATES = (
    ("issue", dict(chunk_type="description", issue_number="7", issue_title="T", issue_author="a"), "[Issue #7] T (by a)", ""), ("issue comment", dict(chunk_type="comment", issue_number="7", comment_author="b"), "[Issue #7] Comment by b", ""),
    ("ticket", dict(chunk_type="description", ticket_key="K-1", ticket_summary="S"), "[Jira K-1] S", ""), ("ticket comment", dict(chunk_type="comment", ticket_key="K-1", comment_author="b"), "[Jira K-1] Comment by b", ""),
    ("session", dict(chunk_type="session_exchange", session_id="0123456789", project_dir="app", git_branch="main", timestamp="2025"), "[Session 01234567] app (main)", "*2025*"),
    ("thread", dict(chunk_type="slack_thread", channel_name="gen"), "[Slack #gen] thread", ""), ("window", dict(chunk_type="slack_window", channel_name="gen"), "[Slack #gen] conversation", ""),
    ("page", dict(chunk_type="slite_page", page_title="P", section_path="A > B", page_url="u"), "[Slite] P", "*Section: A > B*\n*URL: u*"), ("page without", dict(chunk_type="slite_page"), "[Slite] Untitled", ""),
    ("review", dict(chunk_type="review_comment", pr_number="5", reviewer="r", file_path="f.py"), "[PR #5] Review comment by r on f.py", ""), ("change", dict(chunk_type="description", pr_number="5", pr_title="T", pr_author="a"), "[PR #5] T (by a)", ""),
    ("diff", dict(chunk_type="diff", pr_number="5", pr_title="T", file_path="f.py"), "[PR #5] T — f.py", ""), ("code", dict(entity_name="run", file_path="f.py", line_range="1-2", language="python"), "run (f.py:1-2)", ""),
)


@query(
    "SELECT kind, '### ' || rank || '. ' || head || chr(10) || CASE WHEN notes <> '' THEN notes || chr(10) ELSE '' END || '```' || lang || chr(10) || array_to_string(string_split(trim(text), chr(10))[1:50], chr(10)) || CASE WHEN len(string_split(trim(text), chr(10))) > 50 THEN chr(10) || '# ... (truncated)' ELSE '' END"
    " || chr(10) || '```' || chr(10) AS block, rank FROM (SELECT text, doc_id AS rank FROM documents WHERE text IS NOT NULL AND collection = 'slite_pages'), (VALUES "
    + ", ".join(f"('{k}', '{head}', '{notes}', '{'diff' if 'pr_number' in c else c.get('language', '')}')" for k, c, head, notes in _TEMPLATES)
    + ") t(kind, head, notes, lang)"
)
def ret14_templates(spark, sf):
    """RET-14: the head and the preview of every kind of hit."""
    names = sorted({c for _, given, _, _ in _TEMPLATES for c in given})
    heads = spark.createDataFrame([(k, *[given.get(c) for c in names]) for k, given, _, _ in _TEMPLATES], ", ".join(["kind string", *[f"{c} string" for c in names]]))
    docs = table(spark, sf, "documents").filter("text is not null and collection = 'slite_pages'").select("text", F.col("doc_id").alias("rank"))
    kinds = [h.asDict() for h in heads.collect()]
    each = [docs.select("rank", "text", *[F.lit(h[c]).cast("string").alias(c) for c in ("kind", *names)]) for h in kinds]
    every = reduce(DataFrame.unionByName, each)
    return every.select("kind", render.hit_text(every).alias("block"), "rank")


@query("""WITH c AS (SELECT DISTINCT cwd FROM session_logs WHERE cwd IS NOT NULL), r AS (SELECT DISTINCT regexp_extract(cwd, '^(/[^/]+/[^/]+/[^/]+)', 1) AS p FROM session_logs WHERE cwd IS NOT NULL)
SELECT cwd, max(p) AS name FROM c JOIN r ON p <> '' AND (cwd = p OR starts_with(cwd, p || '/')) GROUP BY 1""")
def ret12_infer_repo(spark, sf):
    """RET-12, JON-10: the deepest registered folder above a working directory."""
    cwd = table(spark, sf, "session_logs").select("cwd").filter("cwd is not null").distinct()
    root = F.regexp_extract("cwd", r"^(/[^/]+/[^/]+/[^/]+)", 1)
    return search.infer_repo(cwd, cwd.select(root.alias("repo_path"), root.alias("name")).filter("name <> ''").distinct())


@query(rf"""WITH t AS (SELECT doc_id, collection, {_TOKENS.format("text")} AS ts FROM documents WHERE text IS NOT NULL)
SELECT collection, count(*) AS n_chunks, sum(len(list_distinct(ts)))::BIGINT AS n_postings, sum(len(ts))::BIGINT AS n_terms FROM t GROUP BY 1""")
def snk01_index(spark, sf):
    """SNK-01, ENC-04: the documents indexed anew: chunks with vectors, and their postings."""
    _STORES.pop((spark.sparkContext.applicationId, sf), None)
    store = _indexed(spark, sf)
    held = store.read_derived("postings").groupBy("collection").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_terms"))
    return store.count().join(held, "collection", "left").select("collection", "n_chunks", F.coalesce("n_postings", F.lit(0)).alias("n_postings"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


@query("SELECT collection, count(*) AS n_chunks FROM documents WHERE text IS NOT NULL GROUP BY 1")
def ret15_count(spark, sf):
    """RET-15, AGG-02: exact number of rows of a collection of the index."""
    return _indexed(spark, sf).count()


@query("SELECT doc_id AS chunk_id, collection, source FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0")
def prj02_get(spark, sf):
    """PRJ-01/02, SNK-01: rows of the index by id, every seventh asked for; ids that aren't there have none."""
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")).filter("chunk_id % 7 = 0").unionByName(spark.range(-3, 0).toDF("chunk_id"))
    return _indexed(spark, sf).get(asked).select("chunk_id", "collection", "source")


@query("""WITH n AS (SELECT doc_id, collection, text FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, collection, text || ' again' AS text FROM n WHERE collection = 'slite_pages'),
k AS (SELECT doc_id FROM n WHERE collection = 'session_logs') SELECT doc_id AS chunk_id, collection, length(text) AS n_chars FROM
 (SELECT * FROM n WHERE collection NOT IN ('slite_pages', 'session_logs', 'slack_messages') UNION ALL SELECT * FROM r)""")
def snk02_store(spark, sf):
    """SNK-02..05: rows put in, put in again with other texts, deleted by id, and a collection dropped."""
    store = ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "chunk_id bigint, collection string, text string", compact_at=2)
    rows = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("chunk_id"), "collection", "text")
    store.merge(rows)
    store.merge(rows.filter("collection = 'slite_pages'").withColumn("text", F.concat("text", F.lit(" again"))))
    store.delete(rows.filter("collection = 'session_logs'"))
    store.drop("slack_messages")
    return store.read().select("chunk_id", "collection", F.length("text").cast("bigint").alias("n_chars"))


@query(rf"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def enc04_postings(spark, sf):
    """ENC-04/05: terms with their counts."""
    p = search.postings(_chunks(spark, sf))
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query(f"""WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), b AS (SELECT vec_id, v, list_transform(v, lambda x: round(x * 127)) AS c FROM e),
n AS (SELECT vec_id, v, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS k FROM (SELECT q.vec_id AS qid, i.vec_id AS chunk_id, q.v AS qv, i.v AS iv, round(list_dot_product(q.c, i.c), 6) AS score FROM n q, n i WHERE q.vec_id % 100 = 0)),
s AS (SELECT qid, chunk_id, round(list_dot_product(qv, iv), 6) AS score FROM f WHERE k <= 40)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def snk10_quantised(spark, sf):
    """SNK-10: search over vectors as bytes, the best scored again by the vectors themselves."""
    e = table(spark, sf, "embeddings")
    items = e.select(F.lit("vectors").alias("collection"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return search.nearest_quantised(items, asked, 10, digits=6).select("qid", "chunk_id", "score", "rank")


@query("""SELECT vec_id, list_reduce(list_transform(embedding[1:32], lambda x: (x > 0)::BIGINT), lambda a, b: a * 2 + b) AS low, list_reduce(list_transform(embedding[33:64], lambda x: (x > 0)::BIGINT), lambda a, b: a * 2 + b) AS high FROM embeddings""")
def snk10_signs(spark, sf):
    """SNK-10: vectors as sign bits."""
    e = search.sign_bits(table(spark, sf, "embeddings"))
    return e.select("vec_id", F.col("signs")[0].alias("low"), F.col("signs")[1].alias("high"))


# ---- chunkers ---------------------------------------------------------------------------------------------------


_SECTIONS = r"""
p AS (SELECT DISTINCT ON (row_id) row_id, page_id, content FROM slite_pages WHERE content IS NOT NULL ORDER BY row_id),
l AS (SELECT row_id, page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT row_id, page_id, string_split(content, chr(10)) AS ls FROM p)),
h AS (SELECT *, regexp_matches(line, '^#{1,4}[ \t\r\f\v]+[^\n]+$') AS head FROM l),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY row_id ORDER BY i) AS n FROM h),
b AS (SELECT row_id, page_id, n, coalesce(max(CASE WHEN head THEN line END), '') AS line, trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM g GROUP BY ALL),
r AS (SELECT row_id, n::BIGINT AS n, []::VARCHAR[] AS open FROM b WHERE n = (SELECT min(n) FROM b x WHERE x.row_id = b.row_id) AND n = 0
 UNION ALL SELECT row_id, 0, []::VARCHAR[] FROM b WHERE n = 1 AND row_id NOT IN (SELECT row_id FROM b WHERE n = 0)
 UNION ALL SELECT b.row_id, b.n, list_append(r.open[1:length(regexp_extract(b.line, '^#+')) - 1], trim(regexp_replace(b.line, '^#+', ''), chr(32) || chr(9) || chr(13))) FROM r JOIN b ON b.row_id = r.row_id AND b.n = r.n + 1),
s AS (SELECT b.row_id, b.page_id, b.n, CASE WHEN len(open) = 0 THEN 'Document' ELSE array_to_string(open, ' > ') END AS section_path, body FROM b JOIN r USING (row_id, n) WHERE body <> '')"""


@query(f"WITH RECURSIVE {_SECTIONS} SELECT row_id, section_path, row_number() OVER (PARTITION BY row_id ORDER BY n) - 1 AS section_index, length(body) AS n_chars, sha256(body) AS hash FROM s")
def chk01_sections(spark, sf):
    """CHK-01: pages cut along headings, each section whole."""
    out = chunkers.document_chunks(_pages(spark, sf), "row_id", "content", "page_id", prefix="slite", markdown=True, max_tokens=1 << 24)
    return out.select("row_id", "section_path", F.col("section_index").cast("bigint").alias("section_index"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def _pages(spark, sf):
    return table(spark, sf, "slite_pages").select("row_id", "page_id", "content").dropDuplicates(["row_id"])


@query(f"WITH RECURSIVE {_SECTIONS} SELECT row_id, page_id, section_path, string_split(section_path, ' > ')[-1] AS entity_name, substr(sha256('slite:' || page_id || ':' || section_path || ':' || (row_number() OVER (PARTITION BY row_id ORDER BY n) - 1)), 1, 16) AS chunk_id, body AS text FROM s WHERE row_id NOT IN (SELECT row_id FROM s WHERE length(body) > 2048)")
def chk04_pages(spark, sf):
    """CHK-04/20: pages as chunks with ids, of pages without a section that has to be cut (cutting is chk03)."""
    pages = _pages(spark, sf)
    out = written(chunkers.document_chunks(pages, "row_id", "content", "page_id", prefix="slite", markdown=True), "pages")
    long = chunkers.document_chunks(pages, "row_id", "content", "page_id", prefix="slite", markdown=True, max_tokens=1 << 24).filter(F.length("text") > 2048).select("row_id").distinct()
    return out.join(long, "row_id", "left_anti").join(pages.select("row_id", "page_id"), "row_id").select("row_id", "page_id", "section_path", "entity_name", "chunk_id", "text")


_WS = r"[\t\n\v\f\r \x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"""WITH p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n{_WS}*\n') AS ps FROM documents WHERE text <> '')),
s AS (SELECT doc_id, i, regexp_replace(regexp_replace(p, '^{_WS}+', ''), '{_WS}+$', '') AS body FROM p)
SELECT doc_id, 'Paragraph ' || i AS section_path, length(body) AS n, sha256(body) AS hash FROM s WHERE body <> ''""")
def chk02_paragraphs(spark, sf):
    """CHK-02: paragraphs of plain text; blank ones count in the labels only."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit("x.txt").alias("path"))
    out = chunkers.document_chunks(docs, "doc_id", "text", "path", max_tokens=1 << 24)
    return out.select("doc_id", "section_path", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("hash"))


# a word that begins at a goes on the piece as long as its end, from where the piece's own words begin, leaves room for the tail of the piece before
_PACKED = rf"""p AS (SELECT doc_id, source, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, source, regexp_split_to_array(text, '\n{_WS}*\n') AS ps FROM documents WHERE text <> '')),
b AS (SELECT doc_id, coalesce(source || '/' || doc_id || '.txt', '') AS path, i, regexp_replace(regexp_replace(p, '^{_WS}+', ''), '{_WS}+$', '') AS body FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_index FROM b WHERE body <> ''),
w1 AS (SELECT doc_id, i, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM (SELECT doc_id, i, string_split(body, ' ') AS ws FROM c WHERE length(body) > 2048)),
w AS (SELECT doc_id, i, j, sum(length(word) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) - 1 AS e, sum(length(word) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) - 1 - length(word) AS a FROM w1),
r AS (SELECT doc_id, i, 0::BIGINT AS k, 1::BIGINT AS j, ''::VARCHAR AS tail, ''::VARCHAR AS held FROM w WHERE j = 1
 UNION ALL SELECT n.doc_id, n.i, n.k + 1, n.nj, right(n.h, 200), n.h FROM (SELECT m.*, CASE WHEN tail = '' THEN '' ELSE tail || ' ' END || substr(body, (fa + 1)::BIGINT, (le - fa)::BIGINT) AS h FROM
  (SELECT r.doc_id, r.i, r.k, r.tail, min(w.a) AS fa, max(w.e) AS le, max(w.j) + 1 AS nj FROM r JOIN w f ON f.doc_id = r.doc_id AND f.i = r.i AND f.j = r.j
   JOIN w ON w.doc_id = r.doc_id AND w.i = r.i AND w.j >= r.j AND (w.j = r.j OR w.e - f.a + length(r.tail) + CASE WHEN r.tail = '' THEN 0 ELSE 1 END <= 2048) GROUP BY r.doc_id, r.i, r.k, r.tail) m JOIN c USING (doc_id, i)) n),
o AS (SELECT doc_id, i, k, regexp_replace(regexp_replace(held, '^{_WS}+', ''), '{_WS}+$', '') AS text FROM r WHERE k > 0 UNION ALL SELECT doc_id, i, 1, body FROM c WHERE length(body) <= 2048),
q AS (SELECT o.*, path, section_index, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS chunk_index FROM o JOIN c USING (doc_id, i) WHERE text <> '')"""


@query(f"""WITH RECURSIVE {_PACKED} SELECT doc_id, substr(sha256('doc:' || path || ':Paragraph ' || i || ':' || chunk_index), 1, 16) AS chunk_id, 'Paragraph ' || i AS section_path, section_index::INT AS section_index, chunk_index::INT AS chunk_index,
text, 'Paragraph ' || i AS entity_name FROM q""")
def chk03_documents(spark, sf):
    """CHK-03: documents cut to size with overlap."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return chunkers.document_chunks(docs, "doc_id", "text", "path")


@query()
def chk05_code(spark, sf):
    """CHK-05..12: whole files cut along their entities."""
    whole = table(spark, sf, "chunks").filter("collection = 'code_chunks' and get_json_object(metadata, '$.entity_type') = 'file'")
    return code.code_chunks(whole.select("repo", "file_path", "text").distinct()).filter("error is null").drop("error")


@query("""WITH d AS (SELECT doc_id, '@@ -1 +1 @@' || chr(10) || replace(text, '## ', '@@ ') AS patch FROM documents WHERE collection = 'pr_diffs' AND text IS NOT NULL)
SELECT doc_id, 1 + len(regexp_extract_all(patch, '\n@@')) AS n_hunks FROM d""".replace("\\n", "\n"))
def chk13_hunks(spark, sf):
    """CHK-13/14: hunks of a diff."""
    d = table(spark, sf, "documents").filter("collection = 'pr_diffs' and text is not null")
    patch = F.concat(F.lit("@@ -1 +1 @@\n"), F.replace("text", F.lit("## "), F.lit("@@ ")))
    return d.select("doc_id", F.size(chunkers.hunks(patch)).cast("bigint").alias("n_hunks"))


@query("""WITH d AS (SELECT source, doc_id, 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.yml' WHEN 1 THEN '.kt' ELSE '.tar' END AS p, regexp_replace(text, '^﻿', '') AS t FROM documents WHERE source IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
SELECT substr(sha256(source || ':' || p || ':__file__:1'), 1, 16) AS chunk_id, source AS repo, p AS file_path, CASE doc_id % 3 WHEN 0 THEN 'yaml' ELSE 'kotlin' END AS language, p AS entity_name, 'file' AS entity_type,
'1-' || (1 + length(t) - length(replace(t, chr(10), ''))) AS line_range, CASE WHEN length(t) > 2048 THEN left(t, 2048) || chr(10) || '# ... (truncated)' ELSE t END AS text FROM d WHERE doc_id % 3 < 2""")
def chk11_whole_files(spark, sf):
    """CHK-11/19/20: files of languages without entities (documents stand in for them), one chunk each; unknown suffixes none."""
    kind = F.element_at(F.array(F.lit(".yml"), F.lit(".kt"), F.lit(".tar")), (F.col("doc_id") % 3 + 1).cast("int"))
    d = table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), kind).alias("file_path"), "text")
    return code.code_chunks(d).select("chunk_id", "repo", "file_path", "language", "entity_name", "entity_type", "line_range", "text")


_CUT = "CASE WHEN length(t) > 2048 THEN left(t, 2048) || chr(10) || '# ... (truncated)' ELSE t END"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"


def _changes(spark, sf):
    """Issues in the place of change requests: the version fetched last of each."""
    last = changes.latest(table(spark, sf, "issues"), ["repo", "issue_number"], [F.col("fetched_at"), F.col("row_id")])
    return last.select("repo", F.col("issue_number").alias("pr_number"), "title", "body", "labels", F.col("issue_state").alias("state"), F.col("author_login").alias("author"), F.col("updated_at").alias("merged_at"))


_PATCH = "'@@ -1 +1 @@' || chr(10) || replace(text, '. ', chr(10) || '@@ ')"


@query(f"""WITH l AS (SELECT DISTINCT ON (repo, issue_number) * FROM issues ORDER BY repo, issue_number, fetched_at DESC, row_id DESC),
h AS (SELECT repo, issue_number, trim('# PR #' || issue_number || ': ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(body, ''), {_BLANK}) AS t FROM l),
d AS (SELECT source AS repo, doc_id % 50 + 1 AS n, doc_id, unnest(hs) AS hunk, generate_subscripts(hs, 1) AS k FROM (SELECT *, string_split(regexp_replace({_PATCH}, chr(10) || '@@', chr(1) || '@@', 'g'), chr(1)) AS hs FROM documents WHERE collection = 'pr_diffs' AND text <> '')),
f AS (SELECT repo, n, row_number() OVER (PARTITION BY repo, n ORDER BY doc_id, k) - 1 AS i, 'File: f' || doc_id || '.py (modified)' || chr(10) || hunk AS t, 'f' || doc_id || '.py' AS path FROM d),
c AS (SELECT source AS repo, doc_id % 50 + 1 AS n, doc_id, 'Review comment by ' || coalesce(lang, 'unknown') || ' on ' || coalesce(section_path, '') || ':' || chr(10) || coalesce(text, '') AS t, coalesce(section_path, '') AS path, coalesce(lang, 'unknown') AS reviewer FROM documents WHERE collection = 'issue_descriptions')
SELECT substr(sha256(repo || ':pr' || issue_number || ':description:0'), 1, 16) AS chunk_id, 'pr_diffs' AS collection, repo, issue_number::INT AS pr_number, 'description' AS chunk_type, '' AS file_path, NULL AS reviewer, {_CUT} AS text FROM h
UNION ALL SELECT substr(sha256(repo || ':pr' || n || ':diff:' || i), 1, 16), 'pr_diffs', repo, n::INT, 'diff', path, NULL, {_CUT} FROM f WHERE repo IS NOT NULL
UNION ALL SELECT substr(sha256(repo || ':pr' || n || ':review_comment:' || doc_id), 1, 16), 'pr_discussions', repo, n::INT, 'review_comment', path, reviewer, {_CUT} FROM c WHERE repo IS NOT NULL""")
def chk14_changes(spark, sf):
    """CHK-13/14: change requests as chunks: issues stand in for them, documents for their patches and comments."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "collection", "lang", "section_path").filter("source is not null").withColumn("pr_number", (F.col("doc_id") % 50 + 1).cast("int"))
    patch = F.when(F.col("text") != "", F.concat(F.lit("@@ -1 +1 @@\n"), F.replace("text", F.lit(". "), F.lit("\n@@ "))))
    patches = docs.filter("collection = 'pr_diffs'").select(F.col("source").alias("repo"), "pr_number", F.col("doc_id").alias("file_pos"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"), F.lit(None).cast("string").alias("status"), patch.alias("patch"))
    said = docs.filter("collection = 'issue_descriptions'").select(F.col("source").alias("repo"), "pr_number", F.col("doc_id").alias("pos"), F.col("lang").alias("user"), F.col("section_path").alias("path"), F.col("text").alias("body"))
    prs = _changes(spark, sf).withColumn("pr_number", F.col("pr_number").cast("int"))
    return chunkers.change_chunks(prs, patches, said)


@query(f"""WITH i AS (SELECT DISTINCT row_id, repo, issue_number, title, body FROM issues),
x AS (SELECT *, trim('[' || repo || ' #' || issue_number || '] ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(body, ''), {_BLANK}) AS t FROM i)
SELECT row_id, substr(sha256(repo || ':issue' || issue_number || ':description:0'), 1, 16) AS chunk_id, {_CUT} AS text FROM x""")
def chk15_issues(spark, sf):
    """CHK-15/19/20, FN-01: issues as chunks with ids."""
    return chunkers.issue_chunks(table(spark, sf, "issues").select("row_id", "repo", "issue_number", "title", "body").distinct()).select("row_id", "chunk_id", "text")


@query(f"""WITH i AS (SELECT DISTINCT row_id, repo, issue_number, author_login, body FROM issues),
x AS (SELECT *, 'Comment by ' || coalesce(author_login, 'unknown') || ' on #' || issue_number || ':' || chr(10) || chr(10) || coalesce(body, '') AS t FROM i)
SELECT row_id, substr(sha256(repo || ':issue' || issue_number || ':comment:' || row_id), 1, 16) AS chunk_id, coalesce(author_login, 'unknown') AS comment_author, {_CUT} AS text FROM x""")
def chk15_comments(spark, sf):
    """CHK-15: comments as chunks, issues stand in for them; they aren't stripped."""
    rows = table(spark, sf, "issues").select("row_id", "repo", "issue_number", "author_login", "body").distinct().withColumn("pos", F.col("row_id"))
    number = F.col("issue_number").cast("string")
    out = chunkers.comment_chunks(rows, "repo", F.concat(F.lit("issue"), number), F.col("author_login"), F.concat(F.lit("#"), number), F.col("body"))
    return out.select("row_id", "chunk_id", "comment_author", "text")


_ADF = "array_to_string(list_filter(list_transform(json_extract(description, '$.content[*]'), lambda b: array_to_string(json_extract_string(b, '$.content[*].text'), '')), lambda t: t <> ''), chr(10) || chr(10))"


@query(f"""WITH i AS (SELECT DISTINCT ON (row_id) * FROM jira_tickets),
x AS (SELECT *, trim('[' || instance || ' ' || ticket_key || '] ' || coalesce(summary, '') || chr(10) || chr(10) || CASE WHEN description IS NULL THEN '' WHEN json_valid(description) THEN {_ADF} ELSE description END, {_BLANK}) AS t FROM i)
SELECT row_id, substr(sha256(instance || ':' || ticket_key || ':description:0'), 1, 16) AS chunk_id, {_CUT} AS text FROM x""")
def chk16_tickets(spark, sf):
    """CHK-16, FN-13: tickets, their description a document tree."""
    return chunkers.ticket_chunks(table(spark, sf, "jira_tickets").dropDuplicates(["row_id"])).select("row_id", "chunk_id", "text")


_CHAT = f"""{_MESSAGES}, ti AS (SELECT msg_id, min(us) AS us FROM ({instants_sql("slack_messages", "msg_id", "ts", None)}) WHERE us IS NOT NULL GROUP BY 1),
c AS (SELECT s.msg_id, channel_id, ts, us, line, author, CASE WHEN reply_count > 0 OR thread_ts IS NOT NULL THEN coalesce(thread_ts, ts) END AS root FROM s JOIN ti USING (msg_id)),
w1 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY channel_id ORDER BY us, msg_id) <= 1800000000 THEN 0 ELSE 1 END AS b FROM c WHERE root IS NULL),
w2 AS (SELECT *, sum(b) OVER (PARTITION BY channel_id ORDER BY us, msg_id) AS g FROM w1),
w3 AS (SELECT *, (row_number() OVER (PARTITION BY channel_id, g ORDER BY us, msg_id) - 1) // 50 AS p FROM w2),
w4 AS (SELECT *, first_value(ts) OVER (PARTITION BY channel_id, g, p ORDER BY us, msg_id) AS key FROM w3),
al AS (SELECT channel_id, 'slack_window' AS chunk_type, key, us, msg_id, line, author, ts FROM w4 UNION ALL SELECT channel_id, 'slack_thread', root, us, msg_id, line, author, ts FROM c WHERE root IS NOT NULL),
au AS (SELECT channel_id, chunk_type, key, string_agg(author, ',' ORDER BY us, msg_id) AS participants, sum(n)::BIGINT AS n_messages FROM (SELECT channel_id, chunk_type, key, author, min(al.us) AS us, arg_min(al.msg_id, (al.us, al.msg_id)) AS msg_id, count(*) AS n FROM al GROUP BY channel_id, chunk_type, key, author) GROUP BY ALL),
li AS (SELECT channel_id, chunk_type, key, '[#' || channel_id || '] ' || CASE chunk_type WHEN 'slack_thread' THEN 'thread' ELSE 'conversation' END || ':' || chr(10) || string_agg(line, chr(10) ORDER BY us, msg_id) AS t FROM al WHERE line IS NOT NULL GROUP BY channel_id, chunk_type, key)"""


@query(f"""WITH {_CHAT} SELECT substr(sha256('slack:' || channel_id || ':' || key), 1, 16) AS chunk_id, channel_id, channel_id AS channel_name, chunk_type, key AS ts, participants, n_messages,
'archives/' || channel_id || '/p' || replace(key, '.', '') AS permalink_path, CASE WHEN length(t) > 2048 THEN left(t, 2048) || chr(10) || '... (truncated)' ELSE t END AS text FROM li JOIN au USING (channel_id, chunk_type, key)""")
def chk17_chat(spark, sf):
    """CHK-17, WIN-01, AGG-05/07/08, FN-10: threads and windows of chat."""
    return chunkers.chat_chunks(messages.chat_rows(*_lines(spark, sf))).withColumn("participants", F.array_join("participants", ","))


@query(f"""WITH {_CHAT} SELECT channel_id, count(*) FILTER (chunk_type = 'slack_thread') AS n_threads, count(*) FILTER (chunk_type = 'slack_window') AS n_windows FROM li GROUP BY 1""")
def agg05_kinds(spark, sf):
    """AGG-05: threads and windows of each channel."""
    return chunkers.chat_kinds(chunkers.chat_chunks(messages.chat_rows(*_lines(spark, sf))))


@query(f"""WITH m AS (SELECT channel_id, msg_id, min(us) AS us FROM ({instants_sql("slack_messages", "channel_id, msg_id", "ts", None)}) WHERE us IS NOT NULL GROUP BY ALL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS b FROM m WINDOW w AS (PARTITION BY channel_id ORDER BY us, msg_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY channel_id ORDER BY us, msg_id) AS k FROM g),
c AS (SELECT *, (row_number() OVER (PARTITION BY channel_id, k ORDER BY us, msg_id) - 1) // 5 AS p FROM s)
SELECT channel_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM c GROUP BY channel_id, k, p""")
def win01_windows(spark, sf):
    """WIN-01, SRT-02: gap windows with a cap (five here) over all messages that have a time, in any form; a hot channel spread over its days."""
    m = with_instant(table(spark, sf, "slack_messages").select("channel_id", "msg_id", "ts"), "ts", "us").filter("us is not null").dropDuplicates(["msg_id"])
    w = windows.gap_windows(m, ["channel_id"], "us", "msg_id", 1800, 5)
    return w.groupBy("channel_id", "window").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n")).drop("window")


def _entries(spark, sf):
    rows = with_source_instant(table(spark, sf, "session_logs"), "entry_timestamp", table(spark, sf, "source_zones"), "session_logs", "host", "us")
    return messages.session_rows(rows)


_STRIP = "trim({0}, " + _BLANK + ")"
_UNNOISED = "regexp_replace(regexp_replace({0}, '(?s)<system-reminder>.*?</system-reminder>', '', 'g'), '(?s)<local-command-[^>]+>.*?</local-command-[^>]+>', '', 'g')"
_BLOCKS = "list_filter(json_extract(m, '$.content[*]'), lambda b: json_extract_string(b, '$.type') = 'text')"
_SAID = "array_to_string(list_transform(list_filter(json_extract(m, '$.content[*]'), lambda b: json_extract_string(b, '$.type') IN ('text', 'tool_use')), lambda b: CASE json_extract_string(b, '$.type') WHEN 'text' THEN coalesce(json_extract_string(b, '$.text'), '') ELSE '[tool:' || coalesce(json_extract_string(b, '$.name'), '?') || '(' || array_to_string(list_transform(json_keys(b, '$.input')[1:3], lambda k: k || '=' || CASE json_type(b, '$.input.' || k) WHEN 'VARCHAR' THEN chr(39) || left(json_extract_string(b, '$.input.' || k), 60) || chr(39) ELSE '...' END), ', ') || ')]' END), chr(10) || chr(10))"
_EXCHANGES = f"""
o AS (SELECT DISTINCT ON (session_id, entry_id) * FROM ({instants_sql("session_logs", "session_id, entry_id, entry_type, message, cwd, git_branch", "entry_timestamp", "host")}) WHERE session_id IS NOT NULL AND us IS NOT NULL),
v AS (SELECT *, lower(trim(entry_type)) AS kind, CASE WHEN json_valid(message) THEN message END AS m FROM o),
y AS (SELECT *, json_type(m, '$.content') AS ct FROM v WHERE kind IN ('user', 'assistant')),
z AS (SELECT *, CASE WHEN kind = 'user' THEN nullif({_STRIP.format(_UNNOISED.format(f"CASE ct WHEN 'VARCHAR' THEN json_extract_string(m, '$.content') WHEN 'ARRAY' THEN CASE WHEN list_contains(json_extract_string(m, '$.content[*].type'), 'tool_result') THEN NULL ELSE array_to_string(list_transform({_BLOCKS}, lambda b: coalesce(json_extract_string(b, '$.text'), '')), chr(10)) END END"))}, '') END AS prompt,
 CASE WHEN kind = 'assistant' THEN {_STRIP.format(f"CASE ct WHEN 'VARCHAR' THEN json_extract_string(m, '$.content') WHEN 'ARRAY' THEN {_SAID} ELSE '' END")} END AS answer FROM y),
n AS (SELECT *, sum((prompt IS NOT NULL)::INT) OVER (PARTITION BY session_id ORDER BY us, entry_id) AS x FROM z),
e AS (SELECT session_id, x, max(prompt) AS prompt, min(n.us) AS us, arg_min_null(cwd, (n.us, entry_id)) AS cwd, {_STRIP.format("coalesce(string_agg(nullif(answer, ''), chr(10) || chr(10) ORDER BY n.us, entry_id), '')")} AS a FROM n WHERE x > 0 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY x) - 1 AS turn_index, 'User: ' || prompt || chr(10) || chr(10) || 'Assistant: ' || a AS t FROM e WHERE a <> '')"""


@query(f"""WITH {_EXCHANGES} SELECT substr(sha256('session:' || session_id || ':' || turn_index), 1, 16) AS chunk_id, session_id, turn_index::INT AS turn_index, 'session_exchange' AS chunk_type, us, cwd,
CASE WHEN length(t) > 2048 THEN left(t, 2048) || chr(10) || '... (truncated)' ELSE t END AS text FROM t""")
def chk18_sessions(spark, sf):
    """CHK-18, WIN-02/04, FN-05..07: exchanges of assistant sessions."""
    return chunkers.session_chunks(_entries(spark, sf)).drop("git_branch", "entry_timestamp")


# ---- joins, aggregates, sets ------------------------------------------------------------------------------------


@query(f"""WITH h AS (SELECT DISTINCT repo, {_PATH} AS p FROM file_hashes), c AS (SELECT DISTINCT repo, {_PATH} AS p FROM chunks WHERE file_path IS NOT NULL AND collection = 'code_chunks')
SELECT h.repo, h.p AS file_path FROM h ANTI JOIN c USING (repo, p)""")
def jon01_removed(spark, sf):
    """JON-01, SET-02: files known before that are there no more."""
    h = table(spark, sf, "file_hashes").select("repo", tx.plain_path(F.col("file_path")).alias("file_path")).distinct()
    c = table(spark, sf, "chunks").filter("collection = 'code_chunks'").select("repo", tx.plain_path(F.col("file_path")).alias("file_path"))
    return changes.without(h, c, ["repo", "file_path"])


_LATEST = f"SELECT repo, p AS file_path, lower(arg_max(hash, (last_indexed, lower(hash)))) AS hash FROM (SELECT repo, {_PATH} AS p, hash, last_indexed FROM file_hashes WHERE hash IS NOT NULL{{}}) GROUP BY ALL"


@query(f"""WITH a AS ({_LATEST.format(" AND last_indexed < '2025-09-01'")}), b AS ({_LATEST.format("")})
SELECT repo, file_path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (repo, file_path) WHERE a.hash IS DISTINCT FROM b.hash""")
def jon02_changes(spark, sf):
    """JON-02/03, STR-05, LIF-01: what a run has to index again."""
    f = table(spark, sf, "file_hashes").filter("hash is not null").select("repo", tx.plain_path(F.col("file_path")).alias("file_path"), F.lower("hash").alias("hash"), "last_indexed")
    last = lambda df: df.groupBy("repo", "file_path").agg(F.max_by("hash", F.struct("last_indexed", "hash")).alias("hash"))
    return changes.file_changes(last(f.filter("last_indexed < timestamp_ntz'2025-09-01'")), last(f), ["repo", "file_path"], "hash")


@query("""SELECT m.thread_ts AS root, m.channel_id, count(DISTINCT m.msg_id) AS n_replies, max(r.msg_id) AS root_id FROM slack_messages m
LEFT JOIN (SELECT channel_id, ts, max(msg_id) AS msg_id FROM slack_messages GROUP BY ALL) r ON r.ts = m.thread_ts AND r.channel_id = m.channel_id WHERE m.thread_ts IS NOT NULL GROUP BY ALL""")
def jon05_threads(spark, sf):
    """JON-05: roots with their replies."""
    return messages.threads(table(spark, sf, "slack_messages").select("channel_id", "ts", "msg_id", "thread_ts"))


@query("""SELECT count(*) AS total_queries, round(coalesce(avg(value), 0), 6) AS avg_total_ms, round(avg(event_id % 7), 6) AS avg_result_count, round(avg(value / 2), 6) AS avg_vector_ms, round(avg(value / 4), 6) AS avg_bm25_ms, 0.0::DOUBLE AS avg_rerank_ms FROM events""")
def agg01_metrics(spark, sf):
    """AGG-01: number and five averages of a log of queries (events stand in for it), zero where nothing was measured."""
    v = F.col("value")
    log = table(spark, sf, "events").select(v.alias("total_ms"), (F.col("event_id") % 7).alias("result_count"), (v / 2).alias("vector_ms"), (v / 4).alias("bm25_ms"), F.lit(None).cast("double").alias("rerank_ms"))
    stats = evaluate.query_stats(log)
    return stats.select("total_queries", *[F.round(c, 6).alias(c) for c in stats.columns if c != "total_queries"])


@query(f"SELECT repo, count(DISTINCT {_PATH}) AS n_files FROM file_hashes GROUP BY 1")
def agg03_files(spark, sf):
    """AGG-03, LIF-07: files of each repository."""
    return changes.files_known(table(spark, sf, "file_hashes").select("repo", tx.plain_path(F.col("file_path")).alias("file_path")), "repo")


@query(f"SELECT channel_id, arg_max(ts, (us, ts)) AS newest FROM ({instants_sql('slack_messages', 'channel_id, ts', 'ts', None)}) WHERE us IS NOT NULL GROUP BY 1")
def agg06_newest(spark, sf):
    """AGG-06: the cursor of each channel, the ts of its newest message in the form it has (of equal times the last by spelling)."""
    return messages.newest(table(spark, sf, "slack_messages"))


@query("SELECT count(DISTINCT session_id) AS n_sessions, count(DISTINCT entry_id) AS n_entries FROM session_logs")
def agg09_sessions(spark, sf):
    """AGG-09: distinct sessions."""
    return messages.session_counts(table(spark, sf, "session_logs"))


@query("SELECT row_id, page_id, last_edited_at FROM (SELECT DISTINCT row_id, page_id, last_edited_at, fetched_at FROM slite_pages) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY fetched_at DESC, row_id DESC) = 1")
def agg12_last(spark, sf):
    """AGG-12, SNK-02/05: of rows with one id the last counts."""
    p = table(spark, sf, "slite_pages").select("row_id", "page_id", "last_edited_at", "fetched_at").distinct()
    return changes.latest(p, ["page_id"], [F.col("fetched_at"), F.col("row_id")]).select("row_id", "page_id", "last_edited_at")


def _cases(spark, sf):
    """Test items with the documents that hold their last eight words (the first are shared by many)."""
    head = lambda c: F.array_join(F.slice(search.tokens(F.col(c)), -8, 8), " ")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), head("text").alias("h")).filter("h <> ''")
    grams = table(spark, sf, "documents").select("doc_id", search.tokens(F.col("text")).alias("t")).filter(F.size("t") >= 8)
    grams = grams.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 7), lambda i: F.array_join(F.slice("t", i, 8), " "))).alias("h")).distinct()
    expected = b.join(grams, "h").groupBy("qid").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("expected"))
    return b.select("qid").join(expected, "qid", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))


_CASES = rf"""bt AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '') AS w FROM benchmark),
bh AS (SELECT qid, array_to_string(w[-8:], ' ') AS h FROM bt WHERE len(w) > 0),
dg AS (SELECT DISTINCT doc_id, array_to_string(ts[i:i + 7], ' ') AS h FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 6)) AS i FROM t WHERE len(ts) >= 8)),
wa AS (SELECT bh.qid, doc_id FROM bh JOIN dg USING (h)), wn AS (SELECT bh.qid, count(doc_id) AS wanted FROM bh LEFT JOIN wa USING (qid) GROUP BY 1),
hi AS (SELECT mg.qid, rank, (wa.doc_id IS NOT NULL) AS hit FROM mg JOIN bh USING (qid) LEFT JOIN wa ON wa.qid = mg.qid AND doc_id = chunk_id WHERE rank <= 20),
me AS (SELECT wn.qid, coalesce(count(*) FILTER (hit AND rank <= 5) / nullif(count(*) FILTER (rank <= 5), 0), 0) AS p, coalesce(count(*) FILTER (hit AND rank <= 5) / nullif(any_value(wanted), 0), 0) AS r, coalesce(1.0 / min(rank) FILTER (hit), 0) AS rr FROM wn LEFT JOIN hi USING (qid) GROUP BY 1)"""


@query(f"WITH {_BM25}, {_DENSE}, {_RRF}, {_MERGED}, {_CASES} SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS n_queries FROM me")
def agg13_quality(spark, sf):
    """AGG-13..16, JON-08: precision, recall and reciprocal rank of the merged lists."""
    results = _merged(spark, sf).select("qid", "rank", F.col("chunk_id").cast("string").alias("item"))
    return evaluate.summary(evaluate.metrics(_cases(spark, sf), results, 5))


@query(f"""WITH {_BM25}, a AS (SELECT qid, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS before FROM bm WHERE rank <= 3 AND collection = 'documents' GROUP BY 1),
b AS (SELECT qid, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS after FROM bm WHERE rank <= 3 AND collection = 'pr_diffs' GROUP BY 1)
SELECT qid AS query, before, after FROM a JOIN b USING (qid) WHERE before <> after""")
def jon09_compare(spark, sf):
    """JON-09: queries for which two runs differ."""
    hits = _sparse(spark, sf, 3)
    lists = hits.groupBy("qid", "collection").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("items"))
    run = lambda c: lists.filter(F.col("collection") == c).select(F.col("qid").alias("query"), "items")
    return evaluate.compare(run("documents"), run("pr_diffs"))


@query("""WITH p AS (SELECT DISTINCT row_id, coalesce(last_edited_at, '') AS t FROM slite_pages)
SELECT row_id, t AS last_edited_at, t <> '' AND coalesce(lead(t) OVER (ORDER BY t, row_id) > t, TRUE) AS commits FROM p""")
def win05_commits(spark, sf):
    """WIN-05, STR-02, SRT-03: rows after which the cursor may move."""
    p = table(spark, sf, "slite_pages").select("row_id", F.coalesce("last_edited_at", F.lit("")).alias("last_edited_at")).distinct()
    return windows.tie_safe(p, [], "last_edited_at").select("row_id", "last_edited_at", "commits")


# ---- scalar functions -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT chunk_id, substr(sha256('doc:' || coalesce(file_path, '') || ':x:0'), 1, 16) AS id16, sha256(coalesce(text, '')) AS id64 FROM chunks")
def fn01_ids(spark, sf):
    """FN-01, CHK-20: identifiers from hashes."""
    c = table(spark, sf, "chunks").select("chunk_id", F.coalesce("file_path", F.lit("")).alias("p"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    return c.select("chunk_id", tx.chunk_id("doc", F.col("p"), "x", "0").alias("id16"), F.sha2("t", 256).alias("id64")).distinct()


@query("""WITH c AS (SELECT DISTINCT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunks)
SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM c""")
def fn02_uuid5(spark, sf):
    """FN-02: name-based UUIDs of all chunk ids."""
    return table(spark, sf, "chunks").select("chunk_id").distinct().withColumn("uuid", tx.uuid5_url(F.col("chunk_id")))


@query("""SELECT DISTINCT row_id, CASE WHEN regexp_matches(updated, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}') THEN replace(substr(updated, 1, 10), '-', '/') || ' ' || substr(updated, 12, 5) END AS jql_date FROM jira_tickets""")
def fn08_jql_dates(spark, sf):
    """FN-08, FLT-09: wall clock to the minute for a source's own filter; null for what isn't an ISO time."""
    return table(spark, sf, "jira_tickets").select("row_id", tx.jql_date(F.col("updated")).alias("jql_date")).distinct()


@query("SELECT msg_id, 'archives/' || channel_id || '/p' || replace(ts, '.', '') AS link FROM (SELECT DISTINCT msg_id, channel_id, ts FROM slack_messages WHERE ts IS NOT NULL AND channel_id IS NOT NULL)")
def fn10_permalinks(spark, sf):
    """FN-10: links to messages."""
    m = table(spark, sf, "slack_messages").select("msg_id", "channel_id", "ts").distinct()
    return m.select("msg_id", tx.permalink(F.col("channel_id"), F.col("ts")).alias("link")).filter("link is not null")


@query("SELECT doc_id, list_extract(string_split(section_path, ' > '), -1) AS entity_name FROM documents WHERE section_path IS NOT NULL")
def fn11_entity_names(spark, sf):
    """FN-11: the last part of a section's path."""
    return table(spark, sf, "documents").filter("section_path is not null").select("doc_id", tx.entity_name(F.col("section_path")).alias("entity_name"))


@query(f"SELECT entry_id, {_UNNOISED.format('message')} AS message FROM (SELECT DISTINCT entry_id, message FROM session_logs WHERE message IS NOT NULL)")
def fn05_noise(spark, sf):
    """FN-05: texts without tagged noise."""
    m = table(spark, sf, "session_logs").filter("message is not null").select("entry_id", "message").distinct()
    return m.select("entry_id", tx.without_noise(F.col("message")).alias("message"))


_COUNTERS = """WITH n AS (SELECT repo, count(*) AS a, count(DISTINCT file_path) AS b, count(DISTINCT repo || hash) % 3 AS c, count(*) % 4 AS d, count(*) % 2 AS e, count(*) % 5 AS f, count(DISTINCT hash) AS g FROM file_hashes GROUP BY 1)"""
_IF = lambda n, *parts: f"CASE WHEN {n} > 0 THEN {' || '.join(parts)} ELSE '' END"


def _some_counters(spark, sf):
    n = lambda *c: F.countDistinct(*c)
    every = F.count("*")
    return table(spark, sf, "file_hashes").groupBy("repo").agg(
        every.alias("a"), n("file_path").alias("b"), (n(F.concat("repo", "hash")) % 3).alias("c"), (every % 4).alias("d"), (every % 2).alias("e"), (every % 5).alias("f"), n("hash").alias("g")
    )


@query(_COUNTERS + """ SELECT repo, 'Scanned ' || a || ' files. Indexed ' || b || ' files (' || g || ' chunks). Skipped ' || c || ' unchanged files' || """ + _IF("e", "'. ' || e", "' files produced no chunks'") + " || " + _IF("f", "'. ' || f", "' files failed (see logs)'") + " || " + _IF("d", "'. Removed ' || d", "' deleted files'") + """ || '.' AS code,
'Scanned ' || a || ' files. Indexed ' || b || ' files (' || g || ' chunks).' || """ + _IF("f", "' ' || f", "' files failed (see logs).'") + " AS folder, 'Docs: indexed ' || b || ' (' || g || ' chunks)' || " + _IF("c", "', skipped ' || c", "' unchanged'") + " || " + _IF("f", "', ' || f", "' failed'") + " || " + _IF("d", "', removed ' || d", "' deleted'") + """ || '.' AS docs,
'Fetched ' || a || ' PRs. Indexed ' || b || ' PRs (' || g || ' chunks)' || """ + _IF("c", "'. Skipped ' || c", "' unchanged PRs'") + " || '.' AS prs, 'Fetched ' || a || ' issues. Indexed ' || b || ' issues (' || g || ' chunks)' || " + _IF("c", "'. Skipped ' || c", "' issues (PRs or unchanged)'") + """ || '.' AS issues,
'Fetched ' || a || ' Slite pages. Indexed ' || b || ' pages (' || g || ' chunks)' || """ + _IF("c", "'. Skipped ' || c", "' pages'") + " || " + _IF("e", "'. Errored ' || e", "' pages'") + " || '.' AS pages, 'Fetched ' || a || ' Jira tickets. Indexed ' || b || ' tickets (' || g || ' chunks)' || " + _IF("c", "'. Skipped ' || c", "' tickets'") + """ || '.' AS tickets,
'Scanned ' || a || ' Slack channels. Indexed ' || b || ' threads + ' || d || ' windows (' || g || ' chunks)' || """ + _IF("c", "'. Skipped ' || c", "' channels (no new messages)'") + " || " + _IF("e", "'. Errored ' || e", "' channels'") + " || '.' AS chat, 'Scanned ' || a || ' session files. Indexed ' || b || ' files (' || d || ' sessions, ' || g || ' chunks)' || " + _IF("c", "'. Skipped ' || c", "' empty files'") + " || '.' AS sessions FROM n")
def fn17_reports(spark, sf):
    """FN-17: counters as sentences, one for each kind of run."""
    a, b, c, d, e, f, g = (F.col(k) for k in "abcdefg")
    return _some_counters(spark, sf).select(
        "repo", render.run_report(a, b, c, d, e, f, g).alias("code"), render.folder_report(a, b, c, d, e, f, g).alias("folder"), render.docs_report(a, b, c, d, e, f, g).alias("docs"),
        render.sync_report("prs", a, b, g, c).alias("prs"), render.sync_report("issues", a, b, g, c).alias("issues"), render.sync_report("slite", a, b, g, c, e).alias("pages"), render.sync_report("jira", a, b, g, c).alias("tickets"),
        render.chat_report(a, b, d, g, c, e).alias("chat"), render.session_report(a, b, d, g, c).alias("sessions"),
    )


@query(f"""WITH h AS (SELECT DISTINCT repo, {_PATH} AS p, lower(hash) AS hash FROM file_hashes WHERE hash IS NOT NULL), n AS (SELECT repo, p, min(hash) AS hash FROM h GROUP BY ALL),
o AS (SELECT repo, p, max(hash) AS hash FROM h GROUP BY ALL HAVING max(hash) > 'c'), c AS (SELECT DISTINCT chunk_id, repo, {_PATH} AS p FROM chunks WHERE file_path IS NOT NULL AND collection = 'code_chunks'),
d AS (SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.p, o.p) AS p, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN n.hash <> o.hash THEN 'changed' END AS change FROM n FULL JOIN o USING (repo, p)),
t AS (SELECT d.repo, d.p, count(chunk_id) AS k FROM d LEFT JOIN c USING (repo, p) WHERE change IN ('added', 'changed') GROUP BY ALL)
SELECT (SELECT count(*) FROM n) AS files_scanned, (SELECT count(*) FROM t WHERE k > 0) AS files_indexed, (SELECT count(*) FROM n) - (SELECT count(*) FROM t) AS files_skipped, (SELECT count(*) FROM d WHERE change = 'removed') AS files_removed,
(SELECT count(*) FROM t WHERE k = 0) AS files_empty, 0::BIGINT AS files_failed, (SELECT count(*) FROM c) AS chunks_created""")
def agg04_counters(spark, sf):
    """AGG-04, LIF-01: the counters of a run."""
    h = table(spark, sf, "file_hashes").filter("hash is not null").select("repo", tx.plain_path(F.col("file_path")).alias("file_path"), F.lower("hash").alias("hash"))
    new, old = h.groupBy("repo", "file_path").agg(F.min("hash").alias("hash")), h.groupBy("repo", "file_path").agg(F.max("hash").alias("hash")).filter("hash > 'c'")
    cut = table(spark, sf, "chunks").filter("collection = 'code_chunks' and file_path is not null").select("chunk_id", "repo", tx.plain_path(F.col("file_path")).alias("file_path")).distinct()
    return changes.run_stats(changes.file_changes(old, new, ["repo", "file_path"], "hash"), new, cut.withColumn("error", F.lit(None).cast("string")))

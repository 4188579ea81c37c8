"""Retrieval for batches of queries: BM25 and dense legs, fusion, rerank, preference, cap, top k.

All queries of a batch run as one plan.  What is searched was encoded once, when it was indexed: vectors
lie beside the chunks, postings in a table of their own, partitioned by collection and by bucket of the
term and sorted by term.  Queries are (qid, query); with a column collection each row is searched in that
one alone, so that routing comes before scoring.

Scale: the sparse leg reads the postings of the queries' terms only (partitions by bucket, row groups by term) and
joins them by term; the dense leg multiplies vectors where they lie, each batch keeps its k best for each
query, and only these are shuffled.  No leg pairs a query with all chunks in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

K1, B = 1.2, 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"
#: Queries shipped in one pass of the dense leg.
BLOCK = 4096
#: Terms and queries of a batch that are named in the scan of the postings and scored as matrices; more are joined.
NAMED_TERMS, MATRIX_QUERIES = 8192, 2048
#: Chunks in one matrix, and postings read before chunks are scored.
ROWS, HELD = 512, 100_000
#: Queries in a batch; a larger one is refused.
MOST_QUERIES = 1_000_000


def tokens(text: Column) -> Column:
    """Terms of a text in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != "")


def matching(**equal) -> Column:
    """Equality filter over metadata, AND-combined; arguments that are '', 0 or None filter nothing."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in equal.items() if v not in ("", 0, None)], F.lit(True))


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, out: str = "rank") -> DataFrame:
    """1-based rank within keys; k keeps the best (Catalyst limits each group before the shuffle)."""
    df = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return df.filter(F.col(out) <= k) if k else df


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(collection, chunk_id, term, tf, length)."""
    t = chunks.select("collection", "chunk_id", tokens(F.col(text)).alias("__t"))
    each = t.select("collection", "chunk_id", F.size("__t").alias("length"), F.explode("__t").alias("term"))
    return each.groupBy("collection", "chunk_id", "term", "length").agg(F.count("*").alias("tf"))


def _shipped(queries: DataFrame) -> list[tuple]:
    """A batch of queries as rows on the driver, block by block on the workers; its size is checked, never cut."""
    rows = [tuple(r) for r in queries.limit(MOST_QUERIES + 1).toLocalIterator()]
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch; search them in several batches")
    return rows


POSTING = "collection string, chunk_id string, term string, tf int, length int, bucket int"


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def posting_rows(chunks: DataFrame, buckets: int) -> DataFrame:
    """postings() with the bucket of each term, to be stored."""
    return postings(chunks).select("collection", "chunk_id", "term", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"), term_bucket(F.col("term"), buckets).alias("bucket"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, collection?, term): a term counts once in a query."""
    return queries.select("qid", *[c for c in ("collection",) if c in queries.columns], F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def bm25(read: Callable[[Column | None], DataFrame], sizes: DataFrame, queries: DataFrame, k: int, buckets: int, digits: int = 9) -> DataFrame:
    """(qid, collection, chunk_id, score, rank): the k best of each query in each collection.

    read(where): stored postings under a condition on term and bucket; sizes: collection, n, avg_length.
    Okapi BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over the collection.  Scores are
    rounded, so that ties don't hang on the order of sums; they break by chunk_id.
    """
    terms = asked_terms(queries)
    named = terms.select("term", term_bucket(F.col("term"), buckets)).distinct().limit(NAMED_TERMS + 1).collect()
    where = None
    if len(named) <= NAMED_TERMS:
        where = F.col("bucket").isin(sorted({r[1] for r in named})) & F.col("term").isin([r[0] for r in named]) if named else F.lit(False)
    hits = read(where)
    df = hits.groupBy("collection", "term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = df.join(sizes, "collection").select("collection", "term", idf.alias("idf"), "avg_length")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest("avg_length", F.lit(1e-9))))
    weighed = hits.join(known, ["collection", "term"]).select("collection", "chunk_id", "term", weight.alias("w"))
    routed = "collection" in terms.columns
    asked = []
    if where is not None:
        lists = terms.groupBy("qid", F.col("collection") if routed else F.lit("").alias("collection")).agg(F.collect_list("term").alias("t"))
        asked = lists.limit(MATRIX_QUERIES + 1).collect()
    if where is None or len(asked) > MATRIX_QUERIES:
        on = ["collection", "term"] if routed else ["term"]
        scored = weighed.join(terms, on).groupBy("qid", "collection", "chunk_id").agg(F.round(F.sum("w"), digits).alias("score")).filter("score > 0")
    else:
        scored = _as_matrices(weighed, {r[0]: i for i, r in enumerate(named)}, [(q, c if routed else None, t) for q, c, t in asked], queries.schema["qid"], k, digits)
    return ranked(scored, ["qid", "collection"], [F.desc("score"), F.asc("chunk_id")], k)


def _as_matrices(weighed: DataFrame, vocab: dict[str, int], asked: list[tuple], qid, k: int, digits: int) -> DataFrame:
    """(qid, collection, chunk_id, score) of weighed postings: those of a chunk meet in one place, blocks of chunks are multiplied with the queries.

    A term that most chunks hold costs its postings, not its postings times its queries.
    """
    spark = weighed.sparkSession
    schema = f"qid {qid.dataType.simpleString()}, collection string, chunk_id {weighed.schema['chunk_id'].dataType.simpleString()}, score double"
    wanted = np.zeros((len(vocab), len(asked)))
    for j, (_, _, ts) in enumerate(asked):
        wanted[[vocab[t] for t in ts], j] = 1.0
    shipped = spark.sparkContext.broadcast((pa.array([q for q, *_ in asked], to_arrow_type(qid.dataType)), np.array([c for _, c, _ in asked], object), wanted))
    codes = spark.createDataFrame(list(vocab.items()), "term string, code int")

    def score(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, routes, wanted = shipped.value
        names, keys = t.column("collection").combine_chunks(), t.column("chunk_id").combine_chunks()
        new = np.ones(len(t), bool)
        for c in (names, keys):
            x = c.to_numpy(zero_copy_only=False)
            new[1:] = (x[1:] != x[:-1]) | (new[1:] if c is keys else False)
        chunk, first = np.cumsum(new) - 1, np.flatnonzero(new)
        code, w = t.column("code").to_numpy(), t.column("w").to_numpy()
        of = np.array(names.take(pa.array(first)).to_pylist(), object)
        for name in dict.fromkeys(of.tolist()):
            mine = np.flatnonzero((routes == name) | (routes == None))  # noqa: E711
            at = np.flatnonzero(of == name)
            for part in (at[i : i + ROWS] for i in range(0, len(at), ROWS)):
                lo, hi = first[part[0]], first[part[-1] + 1] if part[-1] + 1 < len(first) else len(t)
                used, place = np.unique(code[lo:hi], return_inverse=True)
                m = np.zeros((len(part), len(used)))
                m[chunk[lo:hi] - part[0], place] = w[lo:hi]
                if len(mine):
                    yield from _best(np.round(m @ wanted[np.ix_(used, mine)], digits).T, k, ids.take(pa.array(mine)), name, keys, first[part], positive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                t = pa.Table.from_batches(held)
                last = (t.column("collection")[n - 1].as_py(), t.column("chunk_id")[n - 1].as_py())
                cut = n  # the last chunk may go on
                while cut and (t.column("collection")[cut - 1].as_py(), t.column("chunk_id")[cut - 1].as_py()) == last:
                    cut -= 1
                if cut:
                    yield from score(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    n -= cut
        if n:
            yield from score(pa.Table.from_batches(held))

    rows = weighed.join(codes, "term").select("collection", "chunk_id", "code", "w")
    return rows.repartition("collection", "chunk_id").sortWithinPartitions("collection", "chunk_id").mapInArrow(run, schema)


def _best(score: np.ndarray, k: int, ids: pa.Array, name: str | None, keys: pa.Array, at: np.ndarray, positive: bool = False) -> Iterator[pa.RecordBatch]:
    """The k best of each row of scores (queries x chunks), with all that tie with the last."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        keep = score >= edge[:, None]
    else:
        keep = np.ones(score.shape, bool)
    q, c = np.nonzero(keep & (score > 0) if positive else keep)
    if len(q):
        cols = [ids.take(pa.array(q)), pa.array([name] * len(q), pa.string()), keys.take(pa.array(at[c])), pa.array(score[q, c])]
        yield pa.RecordBatch.from_arrays(cols, names=["qid", "collection", "chunk_id", "score"])


def nearest(items: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(qid, collection, chunk_id, score, rank) by cosine similarity.

    items: collection, chunk_id, embedding; queries: qid, embedding, and collection where each is
    searched in that one.  Null and zero vectors match nothing.  Vectors stay where they are: each batch is multiplied with a block of
    queries, keeps k for each query and collection, and the few left meet in one shuffle.
    """
    routed = "collection" in queries.columns
    rows = [(i, v, c) for i, v, c in _shipped(queries.select("qid", "embedding", F.col("collection") if routed else F.lit(None))) if v and any(v)]
    qid_type, id_type = queries.schema["qid"].dataType.simpleString(), items.schema["chunk_id"].dataType.simpleString()
    schema, qid_arrow = f"qid {qid_type}, collection string, chunk_id {id_type}, score double", to_arrow_type(queries.schema["qid"].dataType)
    spark = items.sparkSession

    def one(block: list) -> DataFrame:
        q = np.array([v for _, v, _ in block], np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        shipped = spark.sparkContext.broadcast((pa.array([i for i, *_ in block], qid_arrow), q, np.array([c for *_, c in block], object)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, wanted = shipped.value
            for batch in batches:
                vectors = batch.column(2)
                keep = np.array([bool(n) for n in pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(vectors), q.shape[1]), False).to_pylist()])
                if not keep.any():
                    continue
                part = batch.filter(pa.array(keep))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                norm = np.linalg.norm(x, axis=1)
                part, x, norm = part.filter(pa.array(norm > 0)), x[norm > 0], norm[norm > 0]
                names = np.array(part.column(0).to_pylist(), object)
                for name in set(names.tolist()):
                    at = np.flatnonzero(names == name)
                    mine = np.flatnonzero(wanted == name) if routed else np.arange(len(q))
                    if len(mine):
                        s = np.round(q[mine] @ (x[at] / norm[at, None]).T, digits)
                        yield from _best(s, k, ids.take(pa.array(mine)), name, part.column(1), at)

        return items.select("collection", "chunk_id", "embedding").mapInArrow(run, schema)

    if not rows:
        return spark.createDataFrame([], schema + ", rank bigint")
    found = reduce(DataFrame.unionByName, [one(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])
    return ranked(found, ["qid", "collection"], [F.desc("score"), F.asc("chunk_id")], k)


def scalar_quantised(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """embedding as bytes: each of its parts, of length 1 as a whole, times 127."""
    norm = F.sqrt(F.aggregate(F.col(embedding), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("__n", norm).withColumn(embedding, F.transform(embedding, lambda x: F.round(x.cast("double") / F.nullif(F.col("__n"), F.lit(0.0)) * 127).cast("tinyint"))).drop("__n")


def sign_bits(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """embedding as bits, ``signs`` ARRAY<BIGINT> of 32 each: whether a part is above zero."""
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(embedding) - 1) / 32), F.lit(0)).cast("int")), lambda w: F.slice(F.col(embedding), w * 32 + 1, 32))
    packed = F.transform(words, lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0)))
    return df.withColumn("signs", packed)


def nearest_quantised(items: DataFrame, queries: DataFrame, k: int, oversample: int = 4, digits: int = 9) -> DataFrame:
    """nearest() in two steps: k * oversample of each query by their bytes, then the k best of those by the vectors themselves."""
    first = nearest(scalar_quantised(items), scalar_quantised(queries), k * oversample, 6).select("qid", "collection", "chunk_id")
    pairs = first.join(items.select("collection", "chunk_id", "embedding"), ["collection", "chunk_id"]).join(queries.select("qid", F.col("embedding").alias("__q")), "qid")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e, q = F.col("embedding"), F.col("__q")
    scored = pairs.select("qid", "collection", "chunk_id", F.round(dot(e, q) / F.sqrt(dot(e, e)) / F.sqrt(dot(q, q)), digits).alias("score"))
    return ranked(scored, ["qid", "collection"], [F.desc("score"), F.asc("chunk_id")], k)


def hashed_vectors(df: DataFrame, keys: list[str], text: str, dim: int = 64) -> DataFrame:
    """(keys, embedding): term counts in dim hashed places, length 1; a deterministic embedding without a model.

    Terms are hashed in the JVM; a batch is counted at once.  Blank and null texts give zeros.
    """
    place = lambda t: (F.conv(F.substring(F.sha2(t, 256), 1, 7), 16, 10).cast("bigint") % dim).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(len(keys))
            n = batch.num_rows
            sizes = pa.compute.fill_null(pa.compute.list_value_length(places), 0).to_numpy(zero_copy_only=False)
            flat = places.flatten().to_numpy(zero_copy_only=False)
            x = np.bincount(np.repeat(np.arange(n), sizes) * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], lists], names=[*keys, "embedding"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", embedding array<double>"
    return df.select(*keys, F.transform(tokens(F.col(text)), place).alias("p")).mapInArrow(run, schema)


def fuse(legs: list[DataFrame], n: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of legs (qid, collection, chunk_id, rank): the n best of each query and collection."""
    every = reduce(DataFrame.unionByName, [leg.filter(F.col("rank") <= n).select("qid", "collection", "chunk_id", "rank") for leg in legs])
    score = F.round(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))), 12)
    fused = every.groupBy("qid", "collection", "chunk_id").agg(score.alias("score"))
    return ranked(fused, ["qid", "collection"], [F.desc("score"), F.asc("chunk_id")], n)


def merge_collections(hits: DataFrame, top_k: int, order: list[str]) -> DataFrame:
    """One list for each query out of all collections: by score, then by order of the collections, then by rank."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("collection")), F.lit(0))
    merged = hits.withColumnRenamed("rank", "__r").withColumn("__o", place)
    return ranked(merged, ["qid"], [F.desc("score"), F.asc("__o"), F.asc("__r"), F.asc("chunk_id")], top_k).drop("__r", "__o")


def with_lexical_score(hits: DataFrame, query: str = "query", text: str = "text", out: str = "lexical") -> DataFrame:
    """The default reranker: share of the query's terms in the text, plus a little for their density.

    explode(array(x)) takes both texts apart once for each row, not once for each term.
    """
    terms = F.struct(F.array_distinct(tokens(F.col(query))).alias("q"), tokens(F.col(text)).alias("t"))
    df = hits.withColumn("__x", F.explode(F.array(terms)))
    q, t = F.col("__x.q"), F.col("__x.t")
    common, held = F.size(F.array_intersect(q, t)), F.size(F.filter(t, lambda x: F.array_contains(q, x)))
    score = common / F.greatest(F.size(q), F.lit(1)) + 0.1 * held / F.greatest(F.size(t), F.lit(1))
    return df.withColumn(out, F.round(score, 9)).drop("__x")


def rerank(hits: DataFrame, score: Column) -> DataFrame:
    """Replaces score by any column expression (a model's scorer is a pandas UDF here) and ranks anew."""
    return ranked(hits.withColumn("score", score).withColumnRenamed("rank", "__r"), ["qid"], [F.desc("score"), F.asc("__r")]).drop("__r")


def prefer_repo(hits: DataFrame, boost: float, repo: str = "repo", prefer: str = "prefer_repo") -> DataFrame:
    """Ranks anew with a bonus for the preferred repository, a share of the scores' spread; scores stay."""
    if not boost:
        return hits
    w = Window.partitionBy("qid")
    spread = F.max("score").over(w) - F.min("score").over(w)
    bonus = F.when((F.col(prefer) != "") & (F.col(repo) == F.col(prefer)), boost * F.when(spread == 0, 1.0).otherwise(spread)).otherwise(0.0)
    df = hits.withColumn("__a", F.round(F.col("score") + bonus, 9)).withColumnRenamed("rank", "__r")
    return ranked(df, ["qid"], [F.desc("__a"), F.asc("__r")]).drop("__a", "__r")


def source_key(chunk_id: Column = F.col, **columns) -> Column:
    """What a hit belongs to: the first key that it has (change request, issue, ticket, page, session, file), or itself."""
    c = lambda name: columns.get(name, F.lit(None).cast("string"))
    repo = F.coalesce(c("repo"), F.lit(""))
    keyed = lambda tag, name, *more: F.when(c(name).isNotNull(), F.concat_ws(":", F.lit(tag), *more, c(name).cast("string")))
    return F.coalesce(
        keyed("pr", "pr_number", repo), keyed("issue", "issue_number", repo), keyed("jira", "ticket_key"), keyed("slite", "page_id"), keyed("session", "session_id"),
        keyed("file", "file_path", repo), F.concat(F.lit("unknown:"), chunk_id.cast("string")),
    )


def cap_sources(hits: DataFrame, most: int, key: str = "source_key") -> DataFrame:
    """The first ``most`` hits of each source in each query; ranks close up."""
    df = hits.withColumn("__n", F.row_number().over(Window.partitionBy("qid", key).orderBy("rank"))).filter(F.col("__n") <= most)
    return ranked(df.withColumnRenamed("rank", "__r"), ["qid"], [F.asc("__r")]).drop("__n", "__r")


def infer_repo(places: DataFrame, repos: DataFrame) -> DataFrame:
    """(cwd, name): of the registered folders that hold cwd the deepest.

    A folder holds a path if it is one of the path's ancestors, so ancestors are exploded and joined by equality.
    """
    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    up = places.select("cwd", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("path")))).alias("a"))
    held = up.select("cwd", "a.depth", "a.path").join(repos.select(F.regexp_replace("repo_path", "/+$", "").alias("path"), "name"), "path")
    return held.groupBy("cwd").agg(F.max_by("name", F.struct("depth", "name")).alias("name"))

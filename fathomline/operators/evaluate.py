"""Retrieval quality over batches of queries: precision, recall, reciprocal rank, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metrics(cases: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """(qid, precision, recall, reciprocal_rank) of every case, zero for cases without results.

    cases: qid, expected ARRAY<STRING>; results: qid, rank, item.  Precision divides by the
    results there are among the k best; an item found twice counts twice.
    """
    hit, top = F.array_contains("expected", F.col("item")), F.col("rank") <= k
    each = results.join(cases.select("qid", "expected"), "qid").groupBy("qid")
    per = each.agg(F.count_if(hit & top).alias("hits"), F.count_if(top).alias("got"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    joined = cases.select("qid", F.size("expected").alias("wanted")).join(per, "qid", "left")
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return joined.select("qid", share("hits", "got").alias("precision"), share("hits", "wanted").alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(per_query: DataFrame) -> DataFrame:
    """One row: the means over all cases and their number; zeros without a case."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return per_query.agg(mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), F.count("*").alias("n_queries"))


def compare(a: DataFrame, b: DataFrame, items: str = "items") -> DataFrame:
    """(query, before, after) of the queries of both runs whose lists differ."""
    left, right = a.select("query", F.col(items).alias("before")), b.select("query", F.col(items).alias("after"))
    return left.join(right, "query").filter(~F.col("before").eqNullSafe(F.col("after")))


# ---- cases and results in files


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, expected_files, expected_prs) of JSON lines; a line that isn't JSON is left out."""
    rows = spark.read.schema("query string, expected_files array<string>, expected_prs array<int>, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path)
    return rows.filter("query is not null").select(F.sha2("query", 256).alias("qid"), "query", "expected_files", "expected_prs")


def of_cases(cases: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """metrics() of cases and results(): a hit is known by its file where the case expects files, else by its change request where it expects those; others are passed over.

    cases: qid, query, expected_files, expected_prs, or expected ARRAY<STRING> of either; found: qid, rank, file_path, pr_number.
    """
    if "expected" in cases.columns:
        want = cases.select("qid", "expected")
        item = F.coalesce("file_path", F.col("pr_number").cast("string"))
        return metrics(want, found.select("qid", "rank", item.alias("item")).filter("item is not null"), k)
    none = F.array().cast("array<string>")
    paths, prs = F.coalesce("expected_files", none), F.coalesce(F.col("expected_prs").cast("array<string>"), none)
    want = cases.select("qid", F.concat(paths, prs).alias("expected"), (F.size(paths) > 0).alias("by_file"), (F.size(prs) > 0).alias("by_pr"))
    item = F.when(F.col("by_file") & F.col("file_path").isNotNull(), F.col("file_path")).when(F.col("by_pr"), F.col("pr_number").cast("string"))
    items = found.join(want.drop("expected"), "qid").select("qid", "rank", item.alias("item")).filter("item is not null")
    # what is passed over takes no rank
    from pyspark.sql import Window

    items = items.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return metrics(want.select("qid", "expected"), items, k)


def save_results(found: DataFrame, path: str) -> None:
    """One JSON object a query and line: query and its results in order."""
    hits = F.sort_array(F.collect_list(F.struct("rank", "file_path", "pr_number")))
    found.groupBy("query").agg(F.transform(hits, lambda h: F.struct(h["file_path"].alias("file_path"), h["pr_number"].alias("pr_number"))).alias("results")).write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """(query, items): the items of each query's results in order."""
    rows = spark.read.schema("query string, results array<struct<file_path: string, pr_number: int>>").json(path)
    return rows.filter("query is not null").select("query", F.transform("results", lambda h: F.coalesce(h["file_path"], h["pr_number"].cast("string"), F.lit("?"))).alias("items"))


def query_stats(log: DataFrame) -> DataFrame:
    """One row over a log of queries: their number and five averages, zero for an empty log."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}")
    return log.agg(F.count("*").alias("total_queries"), *[mean(c) for c in ("total_ms", "result_count", "vector_ms", "bm25_ms", "rerank_ms")])


def newest(log: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest n rows of a log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)
